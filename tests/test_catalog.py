import pytest

from quarryspark.plans.catalog import ORACLES, QUERIES

from .compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    found = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert_same(found.toPandas(), duck(ORACLES[name], sf))
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
