"""All registered queries of the surveillance library."""

from vigilspark.plans import catalogue, cleaning, feeds, inflow, parsing, quality, search, series, surveil, text  # noqa: F401  (they register)
from vigilspark.plans.registry import QUERIES

__all__ = ["QUERIES"]
