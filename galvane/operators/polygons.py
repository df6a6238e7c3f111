"""Polygons as arrays of corners: clipping to boxes, areas, points inside, and overlap joins on tiles.

A ring is array<struct<x: double, y: double>>, corners in order, the first not repeated. Everything is array
functions, so a join's pairs stay in the JVM. Rings of fewer than three corners have area 0 and hold no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KM_PER_DEGREE = 111.32


def following(ring: Column) -> Column:
    """Each corner's next."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def cut(ring: Column, axis: str, bound: Column, below: bool) -> Column:
    """One step of Sutherland-Hodgman: what of the ring lies on one side of a line (below: where axis <= bound)."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] <= bound if below else p[axis] >= bound

    def edge(p: Column, q: Column) -> Column:
        t = (bound - p[axis]) / (q[axis] - p[axis])
        at = {axis: bound, other: p[other] + t * (q[other] - p[other])}
        crossing = F.struct(at["x"].alias("x"), at["y"].alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(inside(p), F.when(inside(q), F.array(q)).otherwise(F.array(crossing))).otherwise(F.when(inside(q), F.array(crossing, q)).otherwise(none))

    return F.flatten(F.zip_with(ring, following(ring), edge))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column name; filters above it are not pushed below, where they would work the value out again for each use."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def clipped(df: DataFrame, ring: str, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """df with its ring clipped to the box. A concave ring may come back with edges that run along the box and back; their area is 0."""
    for axis, bound, below in (("x", x0, False), ("x", x1, True), ("y", y0, False), ("y", y1, True)):
        df = once(df, ring, cut(F.col(ring), axis, bound, below))
    return df


def area(ring: Column) -> Column:
    """The shoelace sum over edges, in square degrees; corners are taken from the first one, which keeps digits."""
    o = ring[0]
    terms = F.zip_with(ring, following(ring), lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Does a ray from the point cross an odd number of edges?"""
    crossed = F.zip_with(ring, following(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"])))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def tiled(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """df once for each tile that a row's box meets, with _tx, _ty and the first of each, _fx and _fy."""
    low_x, low_y = F.floor(x0 / size), F.floor(y0 / size)
    rows = df.withColumn("_fx", low_x).withColumn("_fy", low_y).withColumn("_tx", F.explode(F.sequence(low_x, F.floor(x1 / size))))
    return rows.withColumn("_ty", F.explode(F.sequence(low_y, F.floor(y1 / size))))


def bounds(df: DataFrame, ring: str) -> DataFrame:
    """df with the box of its ring: _x0, _y0, _x1, _y1."""
    for name, axis, end in (("_x0", "x", F.array_min), ("_y0", "y", F.array_min), ("_x1", "x", F.array_max), ("_y1", "y", F.array_max)):
        df = df.withColumn(name, end(F.col(ring)[axis]))
    return df


def meetings(boxes: DataFrame, regions: DataFrame, tile: float = 0.2) -> DataFrame:
    """box, region, ring: every region (with ring) whose ring and box (x0, y0, x1, y1) meet, with the ring clipped to the box.

    Pairs meet on tiles: one that shares several counts on the first of them. box and region hold the columns of the inputs.
    """
    left = tiled(boxes.where("x0 <= x1 AND y0 <= y1").select(F.struct(*boxes.columns).alias("box")), F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1"), tile)
    right = bounds(regions.where("size(ring) >= 3").select(F.struct(*regions.columns).alias("region"), F.col("ring")), "ring")
    right = tiled(right, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), tile).withColumnsRenamed({"_fx": "_gx", "_fy": "_gy"})
    near = (F.col("_x0") <= F.col("box.x1")) & (F.col("_x1") >= F.col("box.x0")) & (F.col("_y0") <= F.col("box.y1")) & (F.col("_y1") >= F.col("box.y0"))
    first = (F.col("_tx") == F.greatest("_fx", "_gx")) & (F.col("_ty") == F.greatest("_fy", "_gy"))
    pairs = left.join(right, ["_tx", "_ty"]).where(near & first).select("box", "region", "ring")
    return clipped(pairs, "ring", F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1")).where(F.size("ring") > 0)


def overlaps(cells: DataFrame, regions: DataFrame, least: float = 0.1, tile: float = 0.2) -> DataFrame:
    """box, region, overlap_fraction, overlap_sqkm, inside, exposed_population of cells (x0, y0, x1, y1, cx, cy) and regions (ring, population).

    A pair counts if the cell covers at least this part of the region or its centre lies in it. People: the covered
    part, but 0.05 at least, 0.15 if the centre lies inside, and 1 at most.
    """
    met = once(once(meetings(cells, regions, tile), "_meet", area(F.col("ring"))), "_whole", area(F.col("region.ring")))
    met = once(met, "inside", holds(F.col("region.ring"), F.col("box.cx"), F.col("box.cy")))
    met = met.withColumn("_part", F.when(F.col("_whole") > 0, F.col("_meet") / F.col("_whole")).otherwise(0.0))
    kept = met.where((F.col("_part") >= least) | F.col("inside"))
    share = F.least(F.lit(1.0), F.greatest(F.when(F.col("inside"), 0.15).otherwise(0.05), F.col("_part")))
    return kept.select("box", "region", F.round("_part", 3).alias("overlap_fraction"), F.round(F.col("_meet") * KM_PER_DEGREE * KM_PER_DEGREE, 2).alias("overlap_sqkm"), "inside", F.bround(F.col("region.population") * share, 0).cast("long").alias("exposed_population"))
