"""Labels of connected pixels across tiles: label in tiles, unite labels at borders, renumber.

A task sees one tile of one frame. What leaves it are the labels at its borders; those that touch are joined
to components by rounds of joins, and components are numbered in order of their first pixel, by ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from galvane.operators.kernels import label_components
from galvane.operators.ranks import running, stored

Store = Callable[[DataFrame], DataFrame]


def united(links: DataFrame, store: Store = stored) -> DataFrame:
    """node, root (the least node of its component) for all nodes of links (a, b).

    Rounds of stars: every node hands its larger neighbours to its least one, then its smaller ones, until
    each component is a star.
    """
    stars = store(links.where("a <> b").select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("low")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("low").alias("up"), F.col("up").alias("low")))
        hub = both.groupBy("up").agg(F.min("low").alias("m")).select("up", F.least("up", "m").alias("hub"))
        wide = both.join(hub, "up").where("low > up").select(F.col("low").alias("up"), F.col("hub").alias("low"))
        least = wide.groupBy("up").agg(F.min("low").alias("hub"))
        narrow = wide.join(least, "up").where("low <> hub").select(F.col("low").alias("up"), F.col("hub").alias("low"))
        stars = store(narrow.unionByName(least.withColumnRenamed("hub", "low")).where("up <> low").distinct())
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("up", "low"))).first())
        if now == before:
            break
        before = now
    return stars.select(F.col("up").alias("node"), F.col("low").alias("root")).unionByName(stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def place(i: str | Column, j: str | Column) -> Column:
    """A pixel's place in row-major order, as one number."""
    as_long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return F.shiftleft(as_long(i), 31) + as_long(j)


def labelled(mask: DataFrame, tile: int = 64, corners: bool = False, store: Store = stored) -> DataFrame:
    """frame, i, j, label of the pixels of mask (frame, i, j): 4-connected (corners: 8-connected) ones share a label.

    Labels of a frame go from 1 in row-major order of their first pixels. Repeated pixels are one; pixels with a
    null are left out.
    """
    pixels = mask.select("frame", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).dropna().distinct()
    kind = pixels.schema["frame"].dataType.simpleString()
    tiled = pixels.withColumn("ti", F.floor(F.col("i") / tile)).withColumn("tj", F.floor(F.col("j") / tile))

    def in_tile(rows):
        out = label_components(rows, corners)
        first = out.assign(place=out["i"].astype("int64") * (1 << 31) + out["j"]).groupby("label")["place"].transform("min")
        return out.assign(seed=first)[["frame", "i", "j", "seed"]]

    local = store(tiled.groupBy("frame", "ti", "tj").applyInPandas(in_tile, f"frame {kind}, i int, j int, seed bigint"))
    inner = [F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1) for c in ("i", "j")]
    edge = local.where(inner[0] | inner[1])
    ways = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * corners
    asked = edge.withColumn("way", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways])))
    asked = asked.select("frame", (F.col("i") + F.col("way.a")).alias("i"), (F.col("j") + F.col("way.b")).alias("j"), F.col("seed").alias("from"))
    node = lambda c: F.struct("frame", F.col(c).alias("seed"))
    links = asked.join(edge, ["frame", "i", "j"]).where("`from` <> seed").select(node("from").alias("a"), node("seed").alias("b")).distinct()
    roots = united(links, store).select(F.col("node.frame").alias("frame"), F.col("node.seed").alias("seed"), F.col("root.seed").alias("root"))
    whole = store(local.join(roots, ["frame", "seed"], "left").select("frame", "i", "j", F.coalesce("root", "seed").alias("root")))
    numbers = running(whole.select("frame", "root").distinct(), ["frame"], [F.col("root")], {"label": F.lit(1)}, store)
    return whole.join(numbers, ["frame", "root"]).select("frame", "i", "j", F.col("label").cast("int").alias("label"))


def levels(field: DataFrame, thresholds: tuple[float, ...], tile: int = 64, store: Store = stored) -> DataFrame:
    """frame, i, j, label_0, label_1, ...: components at each of rising thresholds of field (frame, i, j, value); 0 where below it.

    A component of one level lies in one of the level before, so the labels nest.
    """
    out = None
    for k, t in enumerate(thresholds):
        own = labelled(field.where(F.col("value") >= t), tile, store=store).withColumnRenamed("label", f"label_{k}")
        out = own if out is None else out.join(own, ["frame", "i", "j"], "left")
    return out.select("frame", "i", "j", *[F.coalesce(f"label_{k}", F.lit(0)).alias(f"label_{k}") for k in range(len(thresholds))])
