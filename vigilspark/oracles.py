"""SQL oracles of the surveillance library's queries."""

from vigilspark.plans.registry import ORACLES
from vigilspark.queries import QUERIES  # noqa: F401  (registers them)

__all__ = ["ORACLES"]
