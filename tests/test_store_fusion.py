"""The run store, the fusion fit and the split components."""

import duckdb

from galvane.plans import catalog, fusion, stateful  # noqa: F401
from galvane.sources import store
from tests.test_plans import text

SF = "/root/testdata/sf0.01"


def test_store_upserts(spark, tmp_path):
    schema = "run_id string, alert_id bigint, version bigint, severity string"
    for rows in ([("r1", 1, 1, "WATCH"), ("r1", 2, 1, "WATCH")], [("r1", 1, 2, "WARNING"), ("r2", 1, 1, None)]):
        store.append(spark.createDataFrame(rows, schema), str(tmp_path), "alerts")
    assert sorted((r.alert_id, r.severity) for r in store.scan(spark, str(tmp_path), "alerts", "r1").collect()) == [(1, "WARNING"), (2, "WATCH")]
    assert store.scan(spark, str(tmp_path), "alerts", severity="WATCH").count() == 1


def test_fusion_scores_every_cell(spark):
    rows = fusion.tree_fusion(spark, SF).toPandas()
    assert len(rows) == fusion.features(spark, SF).count() and rows.p.between(0, 1).all()


def test_parts_of_days(spark):
    rows = fusion.tree_fusion(spark, SF).toPandas()
    assert set(rows.part) == {"train", "calibrate", "test"} and (rows.p <= rows.calibrated + 1e-9).mean() > 0.5


def test_split_keeps_days_whole(spark):
    days = fusion.split(spark.range(500).withColumnRenamed("id", "day")).unionByName(fusion.split(spark.range(500).withColumnRenamed("id", "day")))
    assert days.distinct().count() == 500


def test_watershed(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert text(catalog.QUERIES["watershed_cores"](spark, SF).toPandas()) == text(con.execute(catalog.SQL["watershed_cores"]).df())
