"""Every registered query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from checks import CHECKS
from checks.compare import TABLES, compare

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    assert compare(spark, con, name, SMALL) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 8
    assert set(contract.oracle_sql()) <= set(contract.queries())
