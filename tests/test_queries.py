import pytest

from oracle import same
from quarryflow import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, folder, name):
    same(catalog.queries()[name](spark, folder), folder, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert catalog.queries()[name](spark, folder).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
