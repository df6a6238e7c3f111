"""Isotonic regression as the lower hull of cumulative sums, put together from the hulls of ranges.

The fitted values are the slopes of the greatest convex function below the points (rows so far, outcomes so
far). A range's hull keeps all that the whole hull can have of it, so hulls of ranges are merged, a few dozen at a
time, and each range then looks up which of its points lie on the merged hull. No task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from galvane.operators.ranks import running, stored

MERGED = 32


def lower_hull(x: list[int], y: list[int]) -> list[int]:
    """Places of the corners of the lower hull of points in ascending order of x; points on an edge are none. Whole numbers, so exact."""
    keep: list[int] = []
    for k in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (x[k] - x[b]) < (y[k] - y[b]) * (x[b] - x[a]):
                break
            keep.pop()
        keep.append(k)
    return keep


def isotonic(samples: DataFrame, key: str, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """key, ord, threshold, value: knots by key of samples (key, p, y, n): n rows of outcome y (0 or 1) at score p.

    Samples go by p, then y. A knot is the last score of a run of rows with one value; of runs that end at one score
    the last counts. Runs of equal value after one another stay apart. Scores and keys are not null.
    """
    kind = samples.schema[key].dataType.simpleString()
    n = F.col("n").cast("long")
    points = store(running(samples, [key], [F.col("p"), F.col("y")], {"cn": n, "cy": n * F.col("y").cast("long")}, store, keep=["_range"]))
    corner = f"{key} {kind}, part bigint, home bigint, cn bigint, cy bigint"

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cn", ignore_index=True)
        return rows.iloc[lower_hull(rows["cn"].tolist(), rows["cy"].tolist())][[key, "part", "home", "cn", "cy"]]

    zero = F.lit(0).cast("long")
    origin = points.groupBy(key).agg(F.min("_range").cast("long").alias("home")).select(key, "home", zero.alias("cn"), zero.alias("cy"))
    hull = points.select(key, F.col("_range").cast("long").alias("home"), "cn", "cy").unionByName(origin).withColumn("part", F.col("home"))
    hull = store(hull.groupBy(key, "part").applyInPandas(corners, corner))
    parts = points.agg(F.max("_range")).first()[0] or 0
    while True:
        hull = hull.withColumn("part", F.floor(F.col("part") / MERGED).cast("long")).groupBy(key, "part").applyInPandas(corners, corner)
        parts //= MERGED
        if not parts:
            break
        hull = store(hull)

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cn", ignore_index=True)
        a, b = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
        return pd.DataFrame({key: a[key], "first": a["home"], "last": b["home"], "ax": a["cn"], "ay": a["cy"], "bx": b["cn"], "by": b["cy"]})

    edge = hull.groupBy(key).applyInPandas(edges, f"{key} {kind}, first bigint, last bigint, ax bigint, ay bigint, bx bigint, by bigint")
    # An edge goes to all ranges from its first corner's to its last's: as many copies as edges and ranges together.
    sent = edge.select(key, F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("_range"), "ax", "ay", "bx", "by")

    def on_hull(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({key: [], "p": [], "cn": [], "value": []})
        rows, edges = rows.sort_values("cn", ignore_index=True), edges.sort_values("bx", ignore_index=True)
        at = np.searchsorted(edges["bx"].to_numpy(), rows["cn"].to_numpy(), "left")
        ax, ay, bx, by = (edges[c].to_numpy()[at] for c in ("ax", "ay", "bx", "by"))
        x, y = rows["cn"].to_numpy(), rows["cy"].to_numpy()
        on = (y - ay).astype(object) * (bx - ax) == (by - ay).astype(object) * (x - ax)
        out = pd.DataFrame({key: rows[key], "p": rows["p"], "cn": x, "value": (by - ay) / (bx - ax)})
        return out[on.astype(bool)]

    knots = points.groupBy(key, "_range").cogroup(sent.groupBy(key, "_range")).applyInPandas(on_hull, f"{key} {kind}, p double, cn bigint, value double")
    last = knots.groupBy(key, "p").agg(F.max_by("value", "cn").alias("value"))
    ranked = running(last, [key], [F.col("p")], {"ord": F.lit(1)}, store)
    return ranked.select(key, (F.col("ord") - 1).cast("int").alias("ord"), F.col("p").alias("threshold"), "value")
