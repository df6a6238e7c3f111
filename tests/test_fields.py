"""Fields against loops over arrays: uncertainty, smoothing, the union of kernels with plumes, extrapolation; the projection there and back."""

import math

import numpy as np
import pytest

from galvane.plans import catalog, fields, nowcast  # noqa: F401
from galvane.sources import views

SF = "/root/testdata/sf0.001"


def boxed(a, r):
    for _ in range(2):
        for axis in (0, 1):
            pad = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
            b = np.pad(a, pad, mode="edge")
            a = sum(np.take(b, range(o, o + a.shape[axis]), axis) for o in range(2 * r + 1)) / (2 * r + 1)
    return a


def grid(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r[0], np.zeros((10, 10)))[int(r[1]), int(r[2])] = r[value]
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_weights_are_two_passes(radius):
    a = np.random.default_rng(radius).random((10, 10))
    w = np.zeros((10, 10))
    for s, t, n in nowcast.weights(radius):
        w[s, t] = n / (2 * radius + 1) ** 2
    assert np.allclose(w.T @ a @ w, boxed(a, radius))


def test_uncertainty(spark):
    """0.45 of doubt, 0.30 of the lead's share (0.40 at most), 0.15 of the edge's 0.20, 0.10 of what is missing; smoothed; 0.05 to 1."""
    px = grid(views.v_pix(spark, SF).select("frame", "i", "j", "value").collect(), 3)
    seen = {}
    for r in views.v_obs(spark, SF).select("cycle", "modality").distinct().collect():
        seen.setdefault(r["cycle"] // 6, set()).add(r["modality"])
    got = {}
    for r in catalog.QUERIES["uncertainty_terms"](spark, SF).collect():
        got.setdefault((r["frame"], r["lead"]), np.zeros((10, 10)))[r["i"], r["j"]] = r["sigma"]
    edge = np.zeros((10, 10))
    edge[[0, 9]] = edge[:, [0, 9]] = 0.2
    assert set(got) == {(f, lead) for f in px for lead in (15, 30, 45, 60)}
    for (f, lead), sigma in got.items():
        p, there = np.minimum(px[f] / 500, 1), seen.get(f, set())
        missing = 0.2 * ("radar" not in there) + 0.25 * ("satellite" not in there) + 0.15 * ("model" not in there)
        want = 0.45 * 4 * p * (1 - p) + 0.3 * min(0.4, 0.05 * lead / 15) + 0.15 * edge + 0.1 * min(1, missing)
        assert np.allclose(sigma, np.clip(boxed(want, 2), 0.05, 1), atol=1e-6)


@pytest.fixture(scope="module")
def storms(spark):
    """Storms by cycle with probability and motion, by loops."""
    rows = views.v_storm(spark, SF).select("cycle", "i", "j", "intensity").collect()
    by = {}
    for r in rows:
        by.setdefault(r["cycle"], {})[r["i"], r["j"]] = r["intensity"]
    out = {}
    for cycle, cells in by.items():
        for (i, j), x in cells.items():
            near = sorted((di * di + dj * dj, di, dj) for di in range(-2, 3) for dj in range(-2, 3) if (i + di, j + dj) in by.get(cycle - 1, {}))
            my, mx = (-near[0][1], -near[0][2]) if near else (0, 0)
            out.setdefault(cycle, []).append((i, j, min(x / 250, 0.98), mx, my))
    return out


def painted(cells, plumes):
    y, x = np.mgrid[:10, :10]
    field = np.full((10, 10), 0.05)
    for i, j, p, mx, my in cells:
        if p > 0.05:
            dx, dy, speed = x - j, y - i, math.hypot(mx, my)
            if speed > 0.001:
                along, across = (dx * mx + dy * my) / speed, (-dx * my + dy * mx) / speed
                d = (along / np.where(along > 0, 3.75, 1.5)) ** 2 + (across / 1.5) ** 2
            else:
                d = (dx**2 + dy**2) / 2.25
            field = 1 - (1 - field) * (1 - np.minimum(p * np.exp(-0.5 * d), 0.999))
    for c in plumes:
        if abs(c["lead"] - 30) <= 20:
            r = max(1.5, math.sqrt(max(10, c["area"]) / (math.pi * 100)))
            plume = c["p"] * np.exp(-0.5 * (((y - c["ci"]) / r) ** 2 + ((x - c["cj"]) / r) ** 2)) * math.exp(-0.5 * ((c["lead"] - 30) / 15) ** 2)
            field = np.maximum(field, plume)
    return np.clip(boxed(field, 2), 0, 1)


@pytest.fixture(scope="module")
def field(spark, storms):
    plumes = {}
    for c in catalog.QUERIES["initiation_clusters"](spark, SF).collect():
        plumes.setdefault(c["frame"], []).append(c)
    return {c: painted(cells, plumes.get(c // 6, [])) for c, cells in storms.items()}


def test_probability_field(spark, field):
    got = grid(catalog.QUERIES["probability_field"](spark, SF).select("cycle", "i", "j", "p").collect(), 3)
    live = {c for c in field if c in got}
    assert live and all(np.allclose(got[c], field[c], atol=2e-6) for c in live)


def test_beyond_an_hour(spark, storms, field):
    rows = catalog.QUERIES["lagrangian_120"](spark, SF).collect()
    for lead, steps in ((90, 2), (120, 4)):
        got = grid([(r["cycle"], r["i"], r["j"], r["p"]) for r in rows if r["lead"] == lead], 3)
        for c in list(got)[:6]:
            my, mx = np.mean([s[4] for s in storms[c]]) * 1.5, np.mean([s[3] for s in storms[c]]) * 1.5
            sy, sx = int(np.round(my * steps)), int(np.round(mx * steps))
            moved = np.zeros((10, 10))
            for i in range(10):
                for j in range(10):
                    if 0 <= i - sy < 10 and 0 <= j - sx < 10:
                        moved[i, j] = field[c][i - sy, j - sx]
            want = np.clip(boxed(0.05 + (moved - 0.05) * math.exp(-15 * steps / 45), 3), 0, 1)
            assert np.allclose(got[c], want, atol=2e-6)


def test_projection_comes_back(spark):
    rows = catalog.QUERIES["equal_area_back"](spark, SF).collect()
    assert rows and all(r["back"] == 1 for r in rows)


def test_regrid_of_a_plane(spark):
    """Bilinear weights give a plane back where all four neighbours are there."""
    full = [(0, i, j, 3.0 * i - 2.0 * j + 7) for i in range(10) for j in range(10)]
    text = open(fields.__file__).read().split('relational("regrid_equal_area", f"""')[1].split('""")')[0]
    sql = eval('f"""' + text + '"""', vars(fields))
    out = spark.sql(sql, v_pix=spark.createDataFrame(full, "frame int, i int, j int, value double")).collect()
    back = spark.sql(eval('f"""WITH {LINE}, {TARGET} ' + "{FROM_KM.replace('{source}', 'target')}" + '"""', vars(fields))).collect()
    want = {(r["x"], r["y"]): 3 * (26 - r["lat_b"]) / 0.1 - 2 * (r["lon_b"] - 84) / 0.1 + 7 for r in back}
    assert len(out) > 50 and all(abs(r["value"] - want[r["x"], r["y"]]) < 1e-4 for r in out)
