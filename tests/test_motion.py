"""The filter as matrices, cones and headings by hand, as-of joins against a walk."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvane.operators import asof, motion


def by_matrices(seen):
    """The constant-velocity filter over (hours, lat, lon), as its textbook form has it."""
    x, p, last, out = None, None, None, []
    h, r = np.eye(2, 4), np.diag([0.005**2] * 2)
    for t, lat, lon in seen:
        if x is None:
            x, p = np.array([lat, lon, 0, 0.0]), np.diag([0.01**2, 0.01**2, 1, 1])
        else:
            dt = max(1e-4, t - last)
            f = np.eye(4)
            f[0, 2] = f[1, 3] = dt
            q = 0.8 * np.kron(np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]), np.eye(2))
            x, p = f @ x, f @ p @ f.T + q
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + k @ (np.array([lat, lon]) - h @ x), (np.eye(4) - k @ h) @ p
        last = t
        out.append(x.copy())
    return np.array(out)


@pytest.fixture(scope="module")
def walked(spark):
    rnd = random.Random(4)
    rows = []
    for track in range(4):
        t, lat, lon = 0.0, 25.0 + track, 84.0
        for _ in range(12 if track else 1):
            rows.append((track, t, lat, lon, 5))
            t, lat, lon = t + rnd.choice([1 / 6, 1 / 6, 0.5]), lat + rnd.gauss(0.05, 0.02), lon + rnd.gauss(-0.03, 0.02)
    df = spark.createDataFrame([*rows, (9, None, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 1)], "track int, hours double, lat double, lon double, area int").repartition(3)
    return rows, motion.filtered(df, "track", "hours", "lat", "lon")


def test_filter(walked):
    rows, df = walked
    got = df.orderBy("track", "hours").collect()
    want = np.concatenate([by_matrices([r[1:4] for r in rows if r[0] == k]) for k in range(4)])
    assert np.allclose([[r["f_lat"], r["f_lon"], r["v_lat"], r["v_lon"]] for r in got], want, rtol=1e-9, atol=1e-12)


def test_acceleration_from_the_third_row(walked):
    rows, df = walked
    got = motion.accelerated(df, "track", "hours", "lat").where("track = 1").orderBy("hours").collect()
    assert [r["accel"] for r in got[:2]] == [0.0, 0.0]
    for a, b in zip(got[1:], got[2:], strict=False):
        dt = b["hours"] - a["hours"]
        y, x = (b["v_lat"] - a["v_lat"]) / dt * 111.32, (b["v_lon"] - a["v_lon"]) / dt * 111.32 * math.cos(math.radians(b["lat"]))
        assert b["accel"] == pytest.approx(math.hypot(x, y))


def state(spark, v_lat, v_lon, area=1):
    return spark.createDataFrame([(25.0, 84.0, v_lat, v_lon, area)], "f_lat double, f_lon double, v_lat double, v_lon double, area int")


def test_slow_storm_has_a_circle(spark):
    ring = state(spark, 0.0, 0.001).select(motion.cone(F.lit(12.0))).first()[0]
    assert len(ring) == 17 and ring[0] == ring[16]
    assert ring[4]["lat"] == pytest.approx(25 + (12 + 1.645 * 12) / 111.32, abs=1e-4)


def test_northward_cone(spark):
    """30 km/h due north: left side is west, radii grow with the lead, the ring closes."""
    ring = state(spark, 30 / 111.32, 0.0).select(motion.cone(motion.base_radius(F.lit(1), 123.9))).first()[0]
    km = 111.32 * math.cos(math.radians(25))
    assert len(ring) == 16 and ring[0] == ring[-1]
    assert (84 - ring[0]["lon"]) * km == pytest.approx(8, abs=0.02) and ring[0]["lat"] == 25.0
    assert (ring[14]["lon"] - 84) * km == pytest.approx(8, abs=0.02)
    assert ring[4]["lat"] == pytest.approx(25 + 30 / 111.32, abs=1e-4) and ring[10]["lat"] == ring[4]["lat"]
    assert (ring[7]["lat"] - 25) * 111.32 == pytest.approx(30 + 8 + 1.645 * 12, abs=0.02)


@pytest.mark.parametrize(("v_lat", "v_lon", "want"), [(1.0, 0.0, 0.0), (0.0, 1.0, 90.0), (-1.0, 0.0, 180.0), (0.0, -1.0, 270.0), (0.001, 0.0, 0.0)])
def test_heading(spark, v_lat, v_lon, want):
    assert state(spark, v_lat, v_lon).select(motion.heading()).first()[0] == pytest.approx(want)


def test_path(spark):
    assert [tuple(p) for p in state(spark, 0.4, -0.2).select(motion.path()).first()[0]] == [(25.1, 83.95), (25.2, 83.9), (25.3, 83.85), (25.4, 83.8)]


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_as_of(spark, width):
    rnd = random.Random(6)
    told = [(k, float(rnd.randrange(60)), n, rnd.random()) for n, k in enumerate(rnd.choices("aab", k=80))]
    asked = [(k, float(rnd.randrange(-5, 80)), n) for n, k in enumerate(rnd.choices("aabc", k=120))]
    e = spark.createDataFrame(told, "k string, t double, id int, value double")
    a = spark.createDataFrame(asked, "k string, t double, n int")
    got = {r["n"]: r["value"] for r in asof.latest(a, e, ["k"], "t", ["value"], width, ["id"]).collect()}
    want = {n: max(((s, i, v) for c, s, i, v in told if c == k and s <= t), default=(0, 0, None))[2] for k, t, n in asked}
    assert got == want
