"""Every query with SQL that no other test holds against it, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from galvane.plans import catalog
from tests import test_nowcast, test_plans, test_products
from tests.test_plans import text

SF = "/root/testdata/sf0.001"
DONE = {*test_plans.SOME, *test_products.NAMES, *test_nowcast.NEW, "event_time_settlement", "training_samples"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - DONE))
def test_matches_sql(spark, con, name):
    assert text(catalog.QUERIES[name](spark, SF).toPandas()) == text(con.execute(catalog.SQL[name]).df())
