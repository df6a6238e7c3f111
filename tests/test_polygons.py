"""Clipping, areas and points inside against plain geometry; the overlap join on made cells and blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galvane.operators import polygons

RING = "array<struct<x:double,y:double>>"
L_SHAPE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]


def shoelace(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def inside(ring, x, y):
    return sum((y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def star(rnd, n):
    """A concave ring around the origin."""
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(r * math.cos(t), r * math.sin(t)) for t in turns for r in [rnd.uniform(0.3, 1.5)]]


def test_clipped_area_by_counting_points(spark):
    rnd = random.Random(8)
    rows = [(k, star(rnd, rnd.randint(5, 12)), *sorted(rnd.uniform(-1.5, 1.5) for _ in range(2)), *sorted(rnd.uniform(-1.5, 1.5) for _ in range(2))) for k in range(25)]
    df = spark.createDataFrame(rows, f"k int, ring {RING}, x0 double, x1 double, y0 double, y1 double")
    got = polygons.clipped(df, "ring", *(F.col(c) for c in ("x0", "y0", "x1", "y1"))).select("k", polygons.area(F.col("ring")).alias("a"))
    for k, a in got.collect():
        _, ring, x0, x1, y0, y1 = rows[k]
        n = 150
        hit = sum(inside(ring, x0 + (i + 0.5) * (x1 - x0) / n, y0 + (j + 0.5) * (y1 - y0) / n) for i in range(n) for j in range(n))
        assert a == pytest.approx(hit / n / n * (x1 - x0) * (y1 - y0), abs=0.02 * max(0.2, (x1 - x0) * (y1 - y0)))


def test_known_shapes(spark):
    boxes = [(0.5, 0.5, 1.5, 1.5, 0.75), (1.2, 1.2, 1.8, 1.8, 0.0), (-1.0, -1.0, 3.0, 3.0, 3.0), (5.0, 5.0, 6.0, 6.0, 0.0), (0.25, 0.25, 0.75, 0.75, 0.25)]
    df = spark.createDataFrame([(L_SHAPE, *b) for b in boxes], f"ring {RING}, x0 double, y0 double, x1 double, y1 double, want double")
    got = polygons.clipped(df, "ring", *(F.col(c) for c in ("x0", "y0", "x1", "y1"))).select(polygons.area(F.col("ring")).alias("a"), "want").collect()
    assert all(r["a"] == pytest.approx(r["want"], abs=1e-12) for r in got)
    points = spark.createDataFrame([(L_SHAPE, 0.5, 1.5, True), (L_SHAPE, 1.5, 1.5, False), (L_SHAPE, 1.5, 0.5, True), ([], 0.0, 0.0, False), ([(0.0, 0.0), (1.0, 1.0)], 0.5, 0.5, False)], f"ring {RING}, x double, y double, want boolean")
    assert all(r[0] == r[1] for r in points.select(polygons.holds(F.col("ring"), F.col("x"), F.col("y")), "want").collect())
    assert [r[0] for r in points.select(polygons.area(F.col("ring"))).collect()] == [3.0, 3.0, 3.0, 0.0, 0.0]


def overlap_rows(spark, cells, blocks, tile=0.2):
    c = spark.createDataFrame(cells, "name string, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    b = spark.createDataFrame(blocks, f"id int, population long, ring {RING}")
    return {(r["box"]["name"], r["region"]["id"]): (r["overlap_fraction"], r["overlap_sqkm"], r["inside"], r["exposed_population"]) for r in polygons.overlaps(c, b, tile=tile).collect()}


def test_overlap_counts_the_blocks_part(spark):
    """A tenth of the block, or the centre in it; people by the covered part, with a floor."""
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    blocks = [(1, 1000, square(0.0, 0.0, 1.0)), (2, 1000, square(2.0, 0.0, 1.0)), (3, 1000, square(0.0, 2.0, 1.0)), (4, 1000, square(10.0, 10.0, 2.0))]
    cells = [("quarter", 0.5, 0.5, 1.5, 1.5, 1.2, 1.2), ("sliver", 2.0, 0.0, 2.05, 1.0, 1.9, 0.5), ("centre", 0.4, 2.4, 0.5, 2.5, 0.45, 2.45), ("whole", 9.0, 9.0, 13.0, 13.0, 9.5, 9.5), ("beside", 3.0, 0.0, 4.0, 1.0, 3.5, 0.5), ("wrong", 1.0, 1.0, 0.0, 0.0, 0.5, 0.5)]
    km = 111.32**2
    want = {("quarter", 1): (0.25, round(0.25 * km, 2), False, 250), ("centre", 3): (0.01, round(0.01 * km, 2), True, 150), ("whole", 4): (1.0, round(4 * km, 2), False, 1000)}
    for tile in (0.2, 0.7, 50.0):  # a pair counts once, however many tiles it shares
        assert overlap_rows(spark, cells, blocks, tile) == want
