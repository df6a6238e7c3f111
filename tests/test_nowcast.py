"""Statements of nowcast.py: parity with DuckDB, and known values on made inputs."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from galvane import api
from galvane.operators import kernels
from galvane.plans import catalog, nowcast, products, relational, stateful  # noqa: F401
from test_plans import SF, text

NEW = ["history_window", "model_cycle", "qc_frames", "modality_status", "router", "ir_kelvin", "planck_channels", "tensor_8", "resize", "lifecycle_rates", "growth_older", "acceleration", "jump_ten_bins", "gaussian_smooth", "advected", "verification_suite", "scorecard", "geocoded_cells", "cap_full", "cap_faults", "cone_ring", "initiation_clusters", "initiation_grid", "settle_anti", "fss_block", "fss_sliding", "noisy_or_field", "nwp_asof", "colocation_rate", "region_name", "baseline_matrix", "lightning_jump", "cap_polygon"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NEW)
def test_matches_sql(spark, con, name):
    assert text(catalog.QUERIES[name](spark, SF).toPandas()) == text(con.execute(catalog.SQL[name]).df())


def on(spark, monkeypatch, name, **frames):
    """The query over made views."""
    from galvane.sources import views

    for v, df in frames.items():
        monkeypatch.setitem(views.VIEWS, v, lambda spark, sf_dir, df=df: df)
    return catalog.QUERIES[name](spark, "none").collect()


def test_suite_against_plain_formulas(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([0.05, 0.25, 0.45, 0.65, 0.9]), int(rng.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame([(1, 15, p, y, 0.3) for p, y in rows], "run bigint, lead int, p double, y int, p_climo double")
    got = on(spark, monkeypatch, "verification_suite", v_pred=df)[0]
    p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits, misses, false = ((p >= 0.35) & (y == 1)).sum(), ((p < 0.35) & (y == 1)).sum(), ((p >= 0.35) & (y == 0)).sum()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    brier = ((p - y) ** 2).mean()
    assert (got["hits"], got["misses"], got["false_alarms"]) == (hits, misses, false)
    assert [got[k] for k in ("pod", "far", "csi", "brier", "roc_auc", "bss")] == pytest.approx([hits / (hits + misses), false / (hits + false), hits / (hits + misses + false), brier, np.mean(pairs), 1 - brier / ((y.mean() - y) ** 2).mean()], abs=2e-6)
    assert got["decomposed"] == pytest.approx(brier, abs=1e-5)  # exact, for one score a bin


def test_skill_of_fields(spark, monkeypatch):
    a, b = np.zeros((10, 10)), np.zeros((10, 10))
    a[2:5, 2:5], b[3:6, 3:6] = 400, 400
    pix = spark.createDataFrame([(f, i, j, float(x[i, j])) for f, x in ((1, a), (2, b), (3, b)) for i in range(10) for j in range(10)], "frame int, i int, j int, value double")
    got = {(r["frame"], r["km"]): r["fss"] for r in on(spark, monkeypatch, "fss_sliding", v_pix=pix)}
    for frame, f, o in ((2, a, b), (3, b, b)):
        for km, w in ((10, 1), (30, 3), (50, 5)):
            part = lambda x: np.array([[(np.pad(x >= 175, w // 2)[i : i + w, j : j + w]).mean() for j in range(10)] for i in range(10)])  # noqa: B023, E731
            x, z = part(f), part(o)
            assert got[frame, km] == pytest.approx(max(0, min(1, 1 - ((x - z) ** 2).mean() / (x**2 + z**2).mean())), abs=1e-6)
    assert {r["frame"]: r["fss"] for r in on(spark, monkeypatch, "fss_block", v_pix=pix)}[2] == pytest.approx(1 - 10 / 18, abs=1e-6)


def test_two_pass_smoothing(spark, monkeypatch):
    x = np.random.default_rng(1).random((10, 10))
    want = x
    for _ in range(2):
        for axis in (0, 1):
            pad = np.pad(want, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
            want = sum(np.take(pad, range(k, k + 10), axis) for k in range(5)) / 5
    pix = spark.createDataFrame([(1, i, j, float(x[i, j])) for i in range(10) for j in range(10)], "frame int, i int, j int, value double")
    for r in on(spark, monkeypatch, "gaussian_smooth", v_pix=pix):
        assert r["smooth"] == pytest.approx(want[r["i"], r["j"]], abs=1e-6)


def test_planck_goes_and_comes_back(spark, monkeypatch):
    obs = spark.createDataFrame([(1, "satellite", 80.0)], "event_id bigint, modality string, value double")
    got = {r["channel"]: r for r in on(spark, monkeypatch, "planck_channels", v_obs=obs)}
    assert all(r["back"] == pytest.approx(80.0, abs=1e-5) for r in got.values())
    t = 1.43877688 * 925.926 / math.log1p(1.19104276e-5 * 925.926**3 / 80)
    assert got["TIR1"]["kelvin"] == pytest.approx(0.45 + 0.998 * t, abs=1e-6)


def test_isotonic_walks_samples():
    rng = random.Random(7)
    samples = sorted((rng.choice([0.1, 0.2, 0.3, 0.4, 0.5]), rng.randint(0, 1)) for _ in range(60))
    blocks = []
    for s, y in samples:  # one sample after another
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0] + 1e-12:
            (m0, w0, _), (m1, w1, s1) = blocks[-2:]
            blocks[-2:] = [[(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1, s1]]
    want = {s: m for m, _, s in blocks}
    rows = pd.DataFrame([(15, s, y, samples.count((s, y))) for s, y in sorted(set(samples))], columns=["lead", "p", "mean", "n"])
    got = kernels.fit_isotonic(rows)
    assert dict(zip(got.threshold, got.value)) == pytest.approx({s: round(m, 6) for s, m in want.items()})


def test_eight_connected():
    frame = pd.DataFrame({"i": [0, 1, 5], "j": [0, 1, 5]})
    assert kernels.label_components(frame).label.tolist() == [1, 2, 3] and kernels.label_components(frame, corners=True).label.tolist() == [1, 1, 2]


def test_query_functions(spark):
    assert api.runs(spark, SF).count() == 4 and api.scoreboard(spark, SF, run=1, lead=30).count() == 1
    some = api.alerts(spark, SF, preset="Protective")
    assert {r["preset"] for r in some.collect()} <= {"protective"} and api.alerts(spark, SF, region="no such").count() == 0
    assert api.bulletin(spark, SF, 40).columns == ["preset", "headline", "issue_time_utc", "issue_time_ist", "valid_until_ist", "regions", "alerts", "people", "rung", "confidence"]
    assert api.data_health(spark, SF, "radar").count() == 1 and api.baselines(spark, SF, "uncalibrated_trees").count() == 1
    assert api.blocks(spark, SF, "no such").count() == 0 and api.initiation(spark, SF, least_p=0.5).where("p < 0.5").count() == 0
    assert api.flashes(spark, SF, 0, 0).count() == 0 and api.nwp_indices(spark, SF, 1).count() <= 1
    assert api.cells(spark, SF).count() >= 0 and api.field(spark, SF).columns and api.cap(spark, SF, -1).count() == 0 and api.model_health(spark, SF, 1).count() == 4


def test_more_query_functions(spark):
    first = api.tracks(spark, SF).orderBy("track", "b").first()
    assert api.path(spark, SF, track=first["track"], lead=60).count() == api.tracks(spark, SF, track=first["track"]).count()
    inside = api.blocks_in_box(spark, SF, 80.0, 20.0, 90.0, 30.0)
    assert inside.count() == api.blocks(spark, SF).count() and api.blocks_in_box(spark, SF, 0.0, 0.0, 1.0, 1.0).count() == 0
    one = api.cases(spark, SF).orderBy("event_id").first()
    assert api.case_bundle(spark, SF, one["event_id"]).count() == 1
    assert api.cap(spark, SF, preset="protective").columns == ["event", "preset", "id", "xml"] and api.message_faults(spark, SF).count() == 0
    assert api.probability(spark, SF, lead=90).where("lead <> 90").count() == 0 and api.climate(spark, SF, "radar").count() == 1
    district = api.blocks(spark, SF).first()["district"]
    assert [r["district"] for r in api.admin_geojson(spark, SF, district.lower()).collect()] == [district]
