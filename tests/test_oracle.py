"""Every query with a SQL twin gives the same rows in both engines."""

import pytest
from compare import duck, duck_rows, spark_rows

from cellgauge.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, con):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(con, ORACLES[name])


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 2
    assert set(contract.oracle_sql()) <= set(contract.queries())
