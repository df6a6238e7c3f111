"""initiation_tracking: what lies at the middle between two rounded values falls as in DuckDB."""

import duckdb

from galvane.plans import nowcast
from galvane.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def test_tracked_candidates_to_the_last_place(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    columns = "frame, i, j, prev, u_kmh, v_kmh, p"
    want = con.execute(f"SELECT {columns} FROM ({SQL['initiation_tracking']}) ORDER BY frame, i, j").fetchall()
    got = QUERIES["initiation_tracking"](spark, SF).selectExpr(*columns.split(", ")).orderBy("frame", "i", "j").collect()
    assert len(got) > 600 and [tuple(r) for r in got] == want


def test_ties_and_their_neighbours(spark):
    xs = [0.9654874999999999, 0.9654875, 0.1234565, -0.1234565, 2.5e-7, 4.9999999999999996e-07, 5e-07, 0.0, 1.0, -2.0000005]
    rounded = nowcast.rounded_after_scaling("x", 6)
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(rounded).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
