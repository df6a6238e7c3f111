"""Settlement by event time: parity, a plain walk over made rows, and the stream against the batch."""

import datetime as dt

import duckdb
import pytest

from galvane.plans import catalog, stateful
from galvane.sources import store
from galvane.streaming import settlement
from tests.test_plans import text

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 5, 1)
FORECAST, FLASH = "issued timestamp, i int, j int", "time timestamp, lat double, lon double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted(((r.issued - T0).total_seconds() / 60, r.i, r.j, r.lead, r.y) for r in df.collect())


@pytest.mark.parametrize("name", ["event_time_settlement", "training_samples"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) and text(got) == text(con.execute(catalog.SQL[name]).df())
    assert set(got["y" if "y" in got else "label"]) == {0, 1}


def test_samples_of_a_cell_stay_apart_by_issue_time(spark, tmp_path):
    schema = "run_id string, issued bigint, cell string, lead int, label int, version bigint"
    for rows in ([("r1", 1, "c", 10, 0, 1), ("r1", 2, "c", 10, 1, 1)], [("r1", 2, "c", 10, 0, 2)]):
        store.append(spark.createDataFrame(rows, schema), str(tmp_path), "samples")
    assert sorted((r.issued, r.label) for r in store.scan(spark, str(tmp_path), "samples", "r1").collect()) == [(1, 0), (2, 0)]


def test_window_is_open_at_issue_and_closed_at_due(spark):
    told = spark.createDataFrame([(at(0), 2, 3), (at(0), 2, 3), (at(10), 9, 9), (None, 1, 1), (at(0), None, 1)], FORECAST)
    flashes = spark.createDataFrame([(at(0), 25.8, 84.3), (at(20), 25.8, 84.3), (at(15), None, 84.9), (None, 25.1, 84.9)], FLASH)
    assert rows(settlement.settled(told, flashes)) == [(0.0, 2, 3, 10, 0), (0.0, 2, 3, 20, 1), (0.0, 2, 3, 30, 1), (10.0, 9, 9, 10, 0), (10.0, 9, 9, 20, 0), (10.0, 9, 9, 30, 0)]


def test_box(spark):
    told = spark.createDataFrame([(at(0), 2, 3)], FORECAST)
    for lat, lon, y in ((25.9, 84.3, 1), (25.8, 84.4, 1), (25.8, 84.43, 0), (25.69, 84.3, 0), (25.6, 84.3, 0)):
        assert {r.y for r in settlement.settled(told, spark.createDataFrame([(at(5), lat, lon)], FLASH)).collect()} == {y}, (lat, lon)


def test_empty(spark):
    assert settlement.settled(spark.createDataFrame([], FORECAST), spark.createDataFrame([], FLASH)).count() == 0


def test_stream_settles_each_pair_once(spark, tmp_path):
    """Rows arrive in order of time over several batches; what is due by the watermark is what the batch form says."""
    storms, flashes, _ = stateful.settlement_inputs(spark, SF)
    wanted = settlement.settled(storms, flashes)
    told, seen, out = (str(tmp_path / x) for x in ("told", "seen", "out"))
    half = storms.selectExpr("timestamp_micros(cast(percentile(unix_micros(issued), 0.5) as bigint)) h").head().h
    schemas = (storms.schema, flashes.schema)

    def sweep():
        a, b = spark.readStream.schema(schemas[0]).parquet(told), spark.readStream.schema(schemas[1]).parquet(seen)
        q = settlement.settled(a, b).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None

    for later in (False, True):
        storms.where((storms.issued > half) == later).coalesce(1).write.mode("append").parquet(told)
        flashes.where((flashes.time > half) == later).coalesce(1).write.mode("append").parquet(seen)
        sweep()  # the second start goes on from the state of the first
    got = spark.read.parquet(out)
    edge = got.selectExpr("max(due) m").head().m
    assert rows(got) == rows(wanted.where(wanted.due <= edge)) and 0 < got.count() < wanted.count()
