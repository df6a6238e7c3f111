"""Sharding by sampled splitters: shards of nearly equal bytes, cut at quantiles of a size-weighted sample.

A record's place in the order is (hash of its group, hash of itself). Splitters are the quantiles of a sample
that draws a record in proportion to its size; ranges found to hold more than six times their share are sampled
again by themselves and subdivided until none is left that can be. Exact sums within the ranges, which are
bounded, and of the ranges before them give every record its place among all bytes, and with it its shard.
Rows of one group stand together: a group that lies in one range goes to one shard; one that fills
several ranges, such as a third of all rows, is spread by record over as many shards as its bytes need.

At each end a shard differs from an equal part by at most half a record or half an undivided group; such
a group is at most about four RANGES-ths of all bytes (1/32 of one of eight shards), unless it is one record. The law is `bytes`.

Defined results: a null text is empty; a size is its bytes and 1; null ids and repeated rows are records
like others; an empty table has no rows; more shards than records leave shards empty. Columns of any name
are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from galvane.llm.common import written

RANGES, MOST_RANGES, RANGE_BYTES = 1024, 8192, 256 << 20
PER_RANGE = 16  # sampled records for each splitter
CUT = 4  # a group with so many bounds inside is subdivided


class Splitters:
    """Sorted bounds (group, own); the range of a record is the number of bounds not above it."""

    def __init__(self, group: np.ndarray, own: np.ndarray):
        order = np.lexsort((own, group))
        group, own = group[order], own[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        self.group, self.own = group[new], own[new]

    def place(self, group: np.ndarray, own: np.ndarray) -> np.ndarray:
        at, end = np.searchsorted(self.group, group, "left"), np.searchsorted(self.group, group, "right")
        cut = np.flatnonzero(at < end)  # records of groups that are subdivided
        for g in np.unique(group[cut]):
            rows = cut[group[cut] == g]
            a, b = at[rows[0]], end[rows[0]]
            at[rows] = a + np.searchsorted(self.own[a:b], own[rows], "right")
        return at


def drawn(sample: list, wanted: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """wanted - 1 bounds from sampled rows (group, own, weight); bounds inside a group that has fewer than CUT move to the group's start."""
    if not sample:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.array([(r[0], r[1]) for r in sample], np.int64)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    group, own, weight = rows[order, 0], rows[order, 1], np.array([r[2] for r in sample])[order]
    up = np.cumsum(weight)
    at = np.unique(np.searchsorted(up, np.arange(1, wanted) * up[-1] / wanted, "left").clip(0, len(up) - 1))
    group, own = group[at], own[at]
    held = np.searchsorted(group, group, "right") - np.searchsorted(group, group, "left")
    return group, np.where(held < CUT, lowest, own)


LOWEST = -(2**63)


def with_ranges(rows: DataFrame, ranges: int = RANGES) -> tuple[DataFrame, list, list[int]]:
    """rows with its range; (range, bytes, rows) of each; the groups that bounds subdivide. rows (stored): group_hash, own_hash, size and more."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = int(min(max(ranges, total // RANGE_BYTES), MOST_RANGES, max(1, n)))
    uniform = (F.xxhash64("own_hash", "group_hash", F.lit("drawn")).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)

    def sampled(of: DataFrame, size: float, draws: int) -> list:
        """About draws rows, each as likely as its share of size; a row larger than one draw's share stands for several."""
        if not size:
            return []
        hope = F.col("size") * (draws / size)
        return of.where(uniform < hope).select("group_hash", "own_hash", F.greatest(hope, F.lit(1.0)).alias("weight")).collect()

    bounds = Splitters(*drawn(sampled(rows, total, ranges * PER_RANGE), ranges, LOWEST))

    def ranged(splitters: Splitters) -> DataFrame:
        fields = rows.select("group_hash", "own_hash").columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in fields)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splitters.place(group, own), pa.int32())], names=[*batch.schema.names, "range"])

        return rows.mapInArrow(run, rows.withColumn("range", F.lit(0)).schema)

    while True:
        placed = written(ranged(bounds), "ranged")
        held = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
        share = (CUT + 2) * total / ranges
        over = [r for r in held if r["bytes"] > share and r["bytes"] > 2 * r["most"]]
        out = placed, [(r["range"], r["bytes"], r["n"]) for r in held], np.unique(bounds.group[bounds.own != LOWEST]).tolist()
        if not over or len(bounds.group) >= 4 * MOST_RANGES:
            return out
        group, own, before = [bounds.group], [bounds.own], len(bounds.group)
        inside = placed.where(F.col("range").isin([r["range"] for r in over]))
        size = sum(r["bytes"] for r in over)
        parts = -(-size * ranges // total) * 2
        drawn_rows = sampled(inside, size, parts * PER_RANGE)
        place = bounds.place(np.array([r[0] for r in drawn_rows], np.int64), np.array([r[1] for r in drawn_rows], np.int64)) if drawn_rows else []
        for r in over:
            mine = [x for x, p in zip(drawn_rows, place, strict=True) if p == r["range"]]
            g, o = drawn(mine, max(2, -(-r["bytes"] * ranges // total)), LOWEST)
            group, own = [*group, g], [*own, o]
        bounds = Splitters(np.concatenate(group), np.concatenate(own))
        if len(bounds.group) == before:
            return out


def sharded(records: DataFrame, group: Column, size: Column, shards: int = 8, own: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """records with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    group: what copies have in common; size: bytes; own: what tells records of a group apart (ties are told by row).
    """
    own = F.lit(0) if own is None else own
    rows = records.select(F.struct(*records.columns).alias("record"), F.xxhash64(group).alias("group_hash"), size.cast("long").alias("size"), own.alias("own"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.select("record", "group_hash", F.xxhash64("own", "row").alias("own_hash"), "size"), "records")
    placed, held, divided = with_ranges(rows, ranges)
    held.sort()
    total = sum(b for _, b, _ in held)
    starts, at, first = [], 0, 0
    for r, b, n in held:  # a row for each range, at most some ten thousand
        starts.append((r, at, first))
        at, first = at + b, first + n
    before = records.sparkSession.createDataFrame(starts, "range int, bytes_before bigint, rows_before bigint")
    in_order = Window.partitionBy("range").orderBy("group_hash", "own_hash")
    of_group = Window.partitionBy("range", "group_hash").orderBy("own_hash")
    split = records.sparkSession.createDataFrame([(g,) for g in divided], "group_hash bigint").withColumn("split", F.lit(True))  # fewer than bounds
    here = placed.join(F.broadcast(before), "range").join(F.broadcast(split), "group_hash", "left").select(
        "record", "size", "split",
        (F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes_before")).alias("end"),
        (F.row_number().over(in_order) + F.col("rows_before") - 1).alias("place"),
        F.sum("size").over(of_group.rowsBetween(Window.unboundedPreceding, 0)).alias("group_end"),
        F.sum("size").over(Window.partitionBy("range", "group_hash")).alias("group_bytes"),
    )
    # A group in one range goes by its middle, as one; a subdivided one by the middle of each record.
    middle = F.when(F.isnull("split"), 2 * (F.col("end") - F.col("group_end")) + F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size"))
    shard = F.least(F.floor(middle * shards / (2 * max(1, total))), F.lit(shards - 1)).cast("int")
    cut = written(here.select("record", "place", shard.alias("shard")), "cut")
    first_place = cut.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first_place), "shard").select("record.*", "shard", (F.col("place") - F.col("first")).alias("slot"))


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The columns of the query, for doc_id and text of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = sharded(rows, F.col("text_hash"), F.col("size"), shards, F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """docs as Parquet in path/shard=0 and so on, each shard's rows in order of slot."""
    text = F.coalesce("text", F.lit(""))
    out = sharded(docs, text, F.octet_length(text) + 1, shards, F.col("doc_id"))
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
