"""Reference operators: SQL parity on a small scale, and kernels with known answers."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from galvane.operators import kernels
from galvane.plans import catalog, products, relational, stateful  # noqa: F401
from galvane.sources import views

SF = "/root/testdata/sf0.001"
SOME = ["nowcast_verification", "flash_counts_10_20_30", "roc_auc", "reliability", "murphy", "box_blur", "cc_components", "cell_stats", "motion_heading", "exposure_rollup", "block_overlap", "buffer_retention", "mosaic_cressman", "mosaic_nearest", "geocode_polygons", "alerts", "isotonic_fit", "isotonic_apply"]


def text(df):
    cols = sorted(df.columns)
    f = lambda v: None if pd.isna(v) else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float, np.number)) else str(v)
    return sorted([tuple(f(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert text(catalog.QUERIES[name](spark, SF).toPandas()) == text(con.execute(catalog.SQL[name]).df())


def test_polygons_against_half_planes(spark):
    """A ring is the box without four corners: |dy| + |dx| from the centre stays below the side less the cut."""
    flash, block = views.v_flash(spark, SF).toPandas(), views.v_block(spark, SF).toPandas()
    want = {}
    for f in flash.itertuples():
        y, x = f.lat + (f.event_id % 97 - 48) * 0.001 + 0.00037, f.lon + (f.event_id % 89 - 44) * 0.001 + 0.00041
        dy, dx = (block.lat0 + 0.05 - y).abs(), (block.lon0 + 0.05 - x).abs()
        hit = block[(dy < 0.05) & (dx < 0.05) & (dy + dx < 0.1 - 0.02 - 0.01 * (block.s_suppkey % 3))]
        if len(hit):
            want[f.event_id] = (len(hit), hit.s_suppkey.min(), hit.population.sum())
    got = {r["event_id"]: (r["blocks"], r["first_block"], r["population"]) for r in catalog.QUERIES["geocode_polygons"](spark, SF).collect()}
    assert got and got == want


def test_cressman_against_a_loop(spark):
    radar = views.v_obs(spark, SF).where("modality = 'radar'").toPandas()
    got = {(r["cycle"], r["i"], r["j"]): r["dbz"] for r in catalog.QUERIES["mosaic_cressman"](spark, SF).collect()}
    assert len(got) == radar.groupby(["cycle", "i", "j"]).ngroups
    for key, rows in radar.groupby(["cycle", "i", "j"]):
        z = rows.groupby("station").value.max() / 6
        la, lo, sa, so = (np.radians(v) for v in (26 - 0.1 * key[1], 84 + 0.1 * key[2], 25.3 + 0.1 * z.index.to_numpy(), 84.1 + 0.1 * z.index.to_numpy()))
        d2 = (2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((la - sa) / 2) ** 2 + np.cos(la) * np.cos(sa) * np.sin((lo - so) / 2) ** 2))) ** 2
        w = (62500 - d2) / (62500 + d2 + 1e-6)
        want = z.max() if len(z) == 1 else (z * w).sum() / w.sum()
        assert got[key] == pytest.approx(0.0 if want < 5 else min(want, 75.0), abs=1e-5)


def test_pava():
    assert kernels.pava(np.array([0.1, 0.2, 0.3, 0.4]), np.ones(4), np.array([0.0, 1.0, 0.0, 1.0])) == ([0.1, 0.3, 0.4], [0.0, 0.5, 1.0])


def test_tracker_keeps_and_renews_ids():
    rows = pd.DataFrame({"cycle": [0, 1, 2], "label": [1, 1, 1], "lat": [25.0, 25.1, 35.0], "lon": [85.0, 85.05, 95.0]})
    assert kernels.track_cells(rows).cell_id.tolist() == ["C0001", "C0001", "C0002"]


def alert_rows(*rows):
    return pd.DataFrame([dict(zip(("id", "minute", "cell", "region", "blocks", "stage", "jump"), r, strict=True), event=1, preset="x") for r in rows])


def verdicts(*rows):
    return kernels.Suppressor().feed(alert_rows(*rows)).verdict.tolist()


def test_suppression_and_escalation():
    assert verdicts((1, 0, 1, "a", [], 2, 0), (2, 15, 1, "a", [], 2, 0), (3, 25, 1, "a", [], 3, 0), (4, 80, 1, "a", [], 1, 0)) == ["alert", "suppressed", "update", "alert"]


def test_suppression_by_region_block_and_jump():
    assert verdicts((1, 0, 1, "a", [7], 2, 0), (2, 10, 2, "a", [], 2, 0), (3, 20, 3, "b", [7, 8], 2, 0), (4, 30, 4, "c", [9], 2, 0)) == ["alert", "suppressed", "suppressed", "alert"]
    assert verdicts((1, 0, 1, "a", [], 3, 0), (2, 10, 1, "a", [], 3, 1), (3, 20, 1, "a", [], 3, 1)) == ["alert", "update", "suppressed"]


def test_merged_cells_are_used_up():
    rows = pd.DataFrame({"cycle": [0, 0, 1, 1], "label": [1, 2, 1, 2], "lat": [25.0, 25.1, 25.05, 25.12], "lon": [85.0] * 4})
    got = kernels.track_cells(rows)
    assert got.merged.tolist()[2:] == [True, False] and got.cell_id.tolist()[3] == "C0003"


def test_stream_buffer(spark, tmp_path):
    from galvane.streaming.buffer import buffer_stream

    views.v_obs(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = buffer_stream(stream, cap=5).writeStream.outputMode("update").format("memory").queryName("buffer").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("buffer").where("kept <= 5 and kept > 0").count() == 5
