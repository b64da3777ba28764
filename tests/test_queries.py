"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from tests.compare import assert_same
from tests.conftest import SF
from vigilspark.oracles import ORACLES
from vigilspark.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
