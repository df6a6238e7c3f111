"""Documents out and in through files, the data source with its filters, partitions and replay, SQL functions, the training protocol."""

import datetime as dt
import json
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galvane.operators.ranks import stored
from galvane.plans import fusion, geometry, nested, surface, training
from galvane.sources import documents, frames, views

SF = "/root/testdata/sf0.001"


def test_geojson_through_files(spark, tmp_path):
    regions = geometry.regions(spark, SF)
    documents.write_documents(documents.collections(regions, "district"), str(tmp_path / "geo"), "district")
    one = next((tmp_path / "geo").rglob("part-*.txt"))
    text = json.loads(one.read_text())
    assert text["type"] == "FeatureCollection" and text["features"][0]["geometry"]["coordinates"][0][0] == text["features"][0]["geometry"]["coordinates"][0][-1]
    one.write_text(json.dumps(text, indent=2))  # a document of many lines
    for crc in (tmp_path / "geo").rglob("*.crc"):
        crc.unlink()
    back = {r["id"]: r for r in documents.read_geojson(spark, str(tmp_path / "geo")).collect()}
    want = regions.collect()
    assert len(back) == len(want)
    for r in want:
        b = back[str(r["s_suppkey"])]
        assert [(p["x"], p["y"]) for p in b["ring"]] == [(p["x"], p["y"]) for p in r["ring"]] and b["population"] == r["population"]
        assert (b["west"], b["north"]) == (min(p["x"] for p in r["ring"]), max(p["y"] for p in r["ring"]))


def test_broken_documents_are_left_out(spark):
    bad = spark.createDataFrame([("{", ), (None,), ('{"type":"FeatureCollection"}',), ('{"features":[{"id":"1","properties":{"block":"b"},"geometry":{"coordinates":[]}}]}',)], "doc string")
    assert documents.areas(documents.parsed(bad, documents.GEOJSON)).count() == 0


def test_bundles(spark):
    got = documents.parsed(nested.case_bundles(spark, SF), documents.BUNDLE).collect()
    storms = views.v_storm(spark, SF).collect()
    assert sum(len(r["cells"]) for r in got) == len(storms)
    for r in got:
        assert [tuple(c) for c in r["cells"]] == sorted(tuple(c) for c in r["cells"]) and r["first_cycle"] == r["cells"][0]["cycle"]


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """The events in two files of several row groups, in order of time."""
    where = tmp_path_factory.mktemp("frames")
    rows = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    half = len(rows) // 2
    pq.write_table(rows.slice(0, half), where / "a.parquet", row_group_size=100)
    pq.write_table(rows.slice(half), where / "b.parquet", row_group_size=100)
    return str(where)


def test_filters_reach_the_files(spark, table):
    want = {r["event_id"]: r for r in views.v_obs(spark, SF).collect()}
    got = frames.frames(spark, table)
    rows = got.collect()
    assert {r["event_id"] for r in rows} == set(want)
    assert all(r["modality"] == want[r["event_id"]]["modality"] and abs(r["lat"] - want[r["event_id"]]["lat"]) < 1e-9 and abs(r["lon"] - want[r["event_id"]]["lon"]) < 1e-9 for r in rows)
    t = dt.datetime(2024, 1, 10, 12)
    seen = frames.history(got, t, 2160).where("modality = 'radar' AND lat > 25.45")
    low, high = (t - dt.timedelta(minutes=2160) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6, (t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6
    assert [r["event_id"] for r in seen.collect()] == [i for i, r in sorted(want.items(), key=lambda x: (x[1]["us"], x[0])) if r["modality"] == "radar" and r["lat"] > 25.45 and low < r["us"] <= high]
    assert got.rdd.getNumPartitions() > 2 * got.where(F.col("time") < F.lit(dt.datetime(2024, 1, 3))).rdd.getNumPartitions()
    last = {r["modality"]: r["event_id"] for r in frames.last_before(got, t).collect()}
    assert last == {m: max((r["us"], i) for i, r in want.items() if r["modality"] == m and r["us"] <= high)[1] for m in last} and len(last) == 5
    flash = frames.flash_view(got, t).collect()
    assert all(0 <= r["offset_s"] <= 14400 and abs(r["epoch_s"] - want[r["event_id"]]["us"] / 1e6) < 1e-5 for r in flash)


def test_replay_as_a_stream(spark, table, tmp_path):
    spark.dataSource.register(frames.Frames)
    sizes = []
    stream = spark.readStream.format("galvane_frames").option("path", table).option("step_minutes", str(3 * 1440)).load()
    total = spark.read.parquet(table).count()
    q = stream.writeStream.foreachBatch(lambda df, n: sizes.append([r[0] for r in df.select("event_id").collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(120):
            if sum(map(len, sizes)) >= total or not q.isActive:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert q.exception() is None
    seen = [x for part in sizes for x in part]
    assert len(seen) == len(set(seen)) == total and len([x for x in sizes if x]) > 5
    shutil.rmtree(tmp_path / "c", ignore_errors=True)


def test_functions(spark):
    assert set(surface.register(spark)) >= {"haversine_km", "risk_band", "rings", "path"}
    r = spark.sql("SELECT risk_band(0.61D) AS b, compass(-1D, 0D) AS c, persistence(10D, 0D) AS p, exposure(0D) AS e").first()
    assert tuple(r) == ("HIGH", 270.0, 0.0, 0.0)
    assert [tuple(x) for x in spark.sql("SELECT * FROM path(25D, 84D, 0.4D, -0.2D)").collect()] == [(15, 25.1, 83.95), (30, 25.2, 83.9), (45, 25.3, 83.85), (60, 25.4, 83.8)]


def test_training_protocol(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 9).alias("day"), F.col("id").alias("cycle"), F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.rand(k).alias(f) for k, f in enumerate(training.FEATURES)])
    rows = stored(rows.withColumn("y", (F.col("f10") + 0.3 * F.rand(99) > 0.65).cast("int")))
    model, parts = training.trained(rows)
    by = {r["part"]: r["days"] for r in parts.groupBy("part").agg(F.collect_set("day").alias("days")).collect()}
    assert set(by) == {"train", "calibrate", "test"} and sum(map(len, by.values())) == 9  # whole events
    s = {r["part"]: r for r in training.scores(model.predict(parts)).collect()}
    share = parts.where("part = 'train'").agg(F.avg("y")).first()[0]
    flat = {r["part"]: r for r in training.scores(training.Climatology(share).predict(parts)).collect()}
    assert s["test"]["brier"] < 0.6 * flat["test"]["brier"] and s["test"]["pod"] > 0.75 and s["test"]["far"] < 0.25
    training.save(model, parts, str(tmp_path / "m"), note="x")
    again, meta = training.load(spark, str(tmp_path / "m"))
    assert meta["note"] == "x" and meta["calibrated"] and sum(meta["events"].values()) == 9
    a, b = ({r["cycle"]: r["p"] for r in m.predict(parts).collect()} for m in (model, again))
    assert a == b
    one, _ = training.trained(rows.withColumn("y", F.lit(0)))
    assert isinstance(one, training.Climatology) and one.available and not training.Fitted().available


def test_painted(spark):
    field = {(r["i"], r["j"]): r["p"] for r in training.painted(spark.createDataFrame([(1, 2, 3, 0.8), (1, 2, 4, 0.5), (1, 9, 9, 0.01)], "cycle int, i int, j int, p double")).collect()}
    k = 2.718281828459045 ** (-0.5 / 2.25)
    assert field[2, 3] == pytest.approx(1 - 0.95 * (1 - 0.8) * (1 - 0.5 * k)) and (9, 9) not in field and field[2, 9] < 0.06
