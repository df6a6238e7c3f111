"""What leaves the package: features, feeds, documents and colours on made rows and against plain loops."""

import json
import math

import numpy as np
import pytest

from galvane.plans import catalog, outgoing
from galvane.sources import views

SF = "/root/testdata/sf0.001"


def test_features_are_closed_polygons(spark):
    for name in ("geojson_storms", "geojson_initiation", "geojson_rings", "geojson_district"):
        rows = [json.loads(r["feature"]) for r in catalog.QUERIES[name](spark, SF).collect()]
        assert rows, name
        for f in rows:
            (ring,) = f["geometry"]["coordinates"]
            assert f["type"] == "Feature" and f["geometry"]["type"] == "Polygon" and ring[0] == ring[-1] and len(ring) >= 5
            assert all(60 < x < 100 and 15 < y < 35 for x, y in ring)


def test_district_in_any_case_and_nulls_stay(spark):
    rows = [(1, "S", "Gaya", None, 25.0, 25.1, 85.0, 85.1, 7), (2, "S", "Patna", "b", 25.0, 25.1, 85.0, 85.1, 8)]
    blocks = spark.createDataFrame(rows, "s_suppkey bigint, state string, district string, block string, lat0 double, lat1 double, lon0 double, lon1 double, population bigint")
    (one,) = outgoing.blocks_of(blocks, "gAYA").collect()
    assert one["s_suppkey"] == 1 and json.loads(one["feature"])["properties"] == {"block": None, "district": "Gaya", "state": "S", "population": 7}
    assert outgoing.blocks_of(blocks).count() == 2 and outgoing.blocks_of(blocks, "nowhere").isEmpty()


def test_clusters_by_flood(spark):
    """The same clusters as by walking each frame's mask."""
    pix = {(r["frame"], r["i"], r["j"]): r["value"] for r in views.v_pix(spark, SF).collect()}
    rows = {}
    for (f, i, j), v in pix.items():
        if (f - 1, i, j) in pix:
            before = pix[f - 1, i, j]
            ir, cooling, depth = 300 - v / 4, (before - v) / 8, (v - before) / 100 - 0.5
            if 180 <= ir <= 273.15 and cooling <= -4 and depth >= -5:
                rows[f, i, j] = (ir, cooling, depth)
    want, left = [], set(rows)
    while left:
        todo, found = [left.pop()], []
        while todo:
            f, i, j = todo.pop()
            found.append((f, i, j))
            near = {(f, i + 1, j), (f, i - 1, j), (f, i, j + 1), (f, i, j - 1)} & left
            left -= near
            todo += near
        if len(found) >= 3:
            cooling, depth = (np.mean([rows[x][k] for x in found]) for k in (1, 2))
            want.append((found[0][0], len(found), min(rows[x][0] for x in found), min(1, 0.4 + 0.1 * abs(cooling) / 4 + (0.2 if depth >= -2 else 0))))
    got = sorted((r["frame"], r["area_px"], r["ir"], r["confidence"]) for r in catalog.QUERIES["satellite_clusters"](spark, SF).collect())
    assert len(got) == len(want) and all(np.allclose(a, b, atol=0.0501) for a, b in zip(got, sorted(want), strict=True))


KNOTS = [(15, 0, 0.2, 0.1), (15, 1, 0.4, 0.5), (15, 2, 0.6, 1.2), (30, 0, 0.5, 0.3)]


@pytest.mark.parametrize(("method", "want"), [("linear", [0.1, 0.1, 0.3, 0.5, 0.85, 1.0, 1.0]), ("step", [0.1, 0.1, 0.5, 0.5, 1.0, 1.0, 1.0])])
def test_calibrated(spark, method, want):
    """Ends hold, results are clipped, one knot is a constant, no knots leave p, a null stays."""
    knots = spark.createDataFrame(KNOTS, "lead int, ord int, threshold double, value double")
    p = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.9]
    rows = [(15, x) for x in p] + [(30, 0.1), (30, 0.9), (45, 1.7), (45, 0.4), (15, None)]
    got = {(r["lead"], r["p"]): r["calibrated"] for r in outgoing.calibrated(spark.createDataFrame(rows, "lead int, p double"), knots, method).collect()}
    assert len(got) == len(rows) and [got[15, x] for x in p] == pytest.approx(want)
    assert (got[30, 0.1], got[30, 0.9], got[45, 1.7], got[45, 0.4], got[15, None]) == (0.3, 0.3, 1.0, 0.4, None)
    none = outgoing.calibrated(spark.createDataFrame([(15, -1.0)], "lead int, p double"), knots.where("false"), method)
    assert none.first()["calibrated"] == 0.0


def test_feed_is_xml(spark):
    rows = [(0, "operational", k, 10.0 * k, "a < b & c", 1 + k % 3, "alert", 0.5) for k in range(30)]
    alerts = spark.createDataFrame(rows, "event bigint, preset string, id bigint, minute double, region string, stage int, verdict string, p double")
    found = outgoing.feed(alerts)
    ids = found.selectExpr("entries", "xpath(feed, '/feed/entry/id/text()') AS ids", "xpath_string(feed, '/feed/entry[1]/title') AS title", "xpath_string(feed, '/feed/updated') AS at").first()
    assert ids["entries"] == 20 and [int(x.rsplit("-", 1)[1]) for x in ids["ids"]] == list(range(29, 9, -1))
    assert ids["title"] == "[RED] a < b & c" and ids["at"] == "2024-01-01T04:50:00+00:00"
    assert outgoing.feed(alerts.where("false")).isEmpty()


def test_rungs(spark):
    """With physics out the cells are served by persistence, then by climatology."""
    rungs = {}
    for r in catalog.QUERIES["router_rungs"](spark, SF).collect():
        rungs.setdefault((r["unet"], r["fusion"], r["physics"], r["persistence"]), set()).add(r["rung"])
    assert rungs[0, 0, 0, 0] == {"CLIMATOLOGY"} and rungs[0, 0, 0, 1] <= {"PERSISTENCE", "CLIMATOLOGY"} and "PERSISTENCE" in rungs[0, 0, 0, 1]
    assert "PERSISTENCE" not in rungs[0, 0, 1, 1] and {"FULL_MULTIMODAL", "REDUCED_MODALITY"} >= rungs[1, 1, 1, 1] - {"FULL_FUSION", "SATELLITE_SURFACE"}


def test_colours(spark):
    values = {(r["frame"], r["i"], r["j"]): r["value"] for r in views.v_pix(spark, SF).collect()}
    seen = set()
    for r in catalog.QUERIES["render_probability"](spark, SF).collect():
        p = min(values[r["frame"], r["i"], r["j"]] / 500, 1)
        k = sum(p >= x for x in (0.2, 0.4, 0.6, 0.8))
        low, width, alpha = (0, 0.2, 0.4, 0.6, 0.8)[k], 0.2 if k < 4 else 0.2001, (0, 110, 140, 170, 200)[k]
        assert abs(r["a"] - math.floor(alpha * (0.6 + 0.4 * min((p - low) / width, 1)))) <= 1
        seen.add((k, r["r"], r["g"], r["b"]))
    assert len(seen) == len({k for k, *_ in seen})
    storms = {(r["cycle"], r["i"], r["j"]): r["intensity"] / 6 for r in views.v_storm(spark, SF).collect()}
    reds = {5: 100, 15: 30, 25: 67, 35: 124, 40: 253, 45: 251, 50: 229, 55: 183, 60: 216, 65: 142}
    ramp = catalog.QUERIES["render_reflectivity"](spark, SF).collect()
    assert len(ramp) == len(storms) and len({r["r"] for r in ramp}) > 3
    assert all(r["r"] == reds[max(x for x in reds if x <= storms[r["cycle"], r["i"], r["j"]])] for r in ramp)


def test_documents(spark):
    (doc, *_) = [r["doc"] for r in catalog.QUERIES["scorecard_document"](spark, SF).orderBy("run").collect()]
    lines = doc.split("\n")
    assert lines[0].startswith("### ") and [x.split("|")[1].strip() for x in lines if x.startswith("| +")] == ["+15 min", "+30 min", "+45 min", "+60 min"]
    assert sum(x.startswith("| ") for x in lines[lines.index("#### Baselines") :]) == 7
    for r in catalog.QUERIES["bulletin_document"](spark, SF).collect():
        b = json.loads(r["doc"])
        assert b["bulletin_id"] == f"GALVANE-{r['preset'].upper()}" and b["affected_regions"] and len(b["procedures"]) == 5
