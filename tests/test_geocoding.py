"""geocode_polygons: blocks of one ring are met once; rows that stand twice, and nulls, count as in the SQL."""

import duckdb
import pytest

from galvane.plans import products  # noqa: F401
from galvane.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.01"
BLOCKS = "SELECT * EXCLUDE (k) REPLACE (s_suppkey + k * 100 AS s_suppkey) FROM range({}) AS r(k), '{}/supplier.parquet'"


def given(folder, blocks, events="SELECT * FROM events", nations="SELECT * FROM nation"):
    """A connection to the tables, which are also written to folder."""
    con = duckdb.connect()
    for t in ("events", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t, q in (("events", events), ("supplier", blocks), ("nation", nations), ("region", "SELECT * FROM region")):
        con.execute(f"COPY ({q}) TO '{folder}/{t}.parquet'")
    for t in ("events", "supplier", "nation", "region"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same_as_sql(spark, con, folder):
    columns = "event_id, blocks, districts, first_block, population"
    want = con.execute(f"SELECT {columns} FROM ({SQL['geocode_polygons']}) ORDER BY ALL").fetchall()
    got = [tuple(r) for r in QUERIES["geocode_polygons"](spark, str(folder)).selectExpr(*columns.split(", ")).collect()]
    assert sorted(got) == want
    return want


ODD = {
    "blocks twice": {"blocks": "FROM supplier UNION ALL FROM supplier WHERE s_suppkey % 3 = 0"},
    "blocks thrice": {"blocks": "FROM supplier UNION ALL FROM supplier UNION ALL FROM supplier WHERE s_suppkey < 60"},
    "a number with two populations": {"blocks": "FROM supplier UNION ALL SELECT * REPLACE (s_acctbal + 1 AS s_acctbal) FROM supplier WHERE s_suppkey % 2 = 0"},
    "a block at two places": {"blocks": "FROM supplier UNION ALL SELECT * REPLACE ((s_nationkey + 1) % 25 AS s_nationkey) FROM supplier", "nations": "SELECT * REPLACE ('one' AS n_name) FROM nation"},
    "a nation at two places": {"blocks": "FROM supplier", "nations": "FROM nation UNION ALL SELECT * REPLACE (n_nationkey % 7 AS n_nationkey) FROM nation"},
    "events twice": {"blocks": "FROM supplier", "events": "FROM events UNION ALL FROM events WHERE event_id % 3 = 0"},
    "an event at two places": {"blocks": "FROM supplier", "events": "SELECT * REPLACE (event_id // 2 AS event_id) FROM events"},
    "nulls": {
        "blocks": "SELECT * REPLACE (CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS s_acctbal) FROM supplier",
        "events": "SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS props) FROM events",
        "nations": "SELECT * REPLACE (CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name) FROM nation",
    },
    "no blocks": {"blocks": "FROM supplier WHERE s_suppkey < 0"},
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows(spark, tmp_path, name):
    assert same_as_sql(spark, given(tmp_path, **ODD[name]), tmp_path) or name == "no blocks"


def rows_made(plan):
    """Rows that the nodes of a plan that has run gave out."""
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    below = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return ([own.get().value()] if own.isDefined() else []) + [n for p in below for n in rows_made(p)]


def test_rows_do_not_grow_with_blocks_times_events(spark, tmp_path):
    con = given(tmp_path, BLOCKS.format(60, SF))
    assert max(r[1] for r in same_as_sql(spark, con, tmp_path)) > 80
    df = QUERIES["geocode_polygons"](spark, str(tmp_path))
    df.collect()
    assert 0 < max(rows_made(df._jdf.queryExecution().executedPlan())) <= 10000  # events are the most
