"""Every registered query beside its SQL twin, over whole tables."""

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    df = driver.queries()[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["_id", "_type", "_order", "order", "n", "part", "qty", "price"]
    assert df.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
