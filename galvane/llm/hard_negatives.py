"""Hard negatives by coordinate pruning over length buckets (LEMP).

Vectors x become whole numbers floor(256 x). Rows lie in shards of one class of labels and one range of
lengths, and in a shard in buckets of rows of like length, longest first. A bucket keeps the directions of its
rows as one sorted list for each coordinate. For a score s an anchor q needs a cosine of t = s / (|q| * longest);
above 1 the bucket is passed over; else, both of length 1, row p can only reach t if each coordinate p_f lies
within sqrt((1 - t^2) (1 - q_f^2)) of t q_f (without upper end if q_f >= t, without lower if q_f <= -t). The
lists give those feasible ranges for the anchor's focus coordinates (its largest), the shortest range is read and the others intersect it, and what
is left is verified by exact products. Where the ranges leave more than a part of the bucket
all of it is verified at once, which is cheaper and gives the same rows.

Positives are found first, in the shards of the anchor's class: in those of the longest rows, and then, with the
score of the last positive found there, in the rest. The needed score of a negative follows from the positives,
and rises as rows are found. Anchors stream past a shard's rows in blocks, and each shard meets at most PART
anchors in one task; the shard is repeated for more.

Defined results: rows whose vec_id, label or vector is null, or whose vector holds null, NaN or infinite components,
take no part; shorter vectors count as ending in zeros; equal scores go by smaller id; an anchor is not
its own positive, nor is another row of its id; rows of one id are candidates each, and anchors each
(their rows are alike in anchor_id; anchor_row tells them apart); a positive of negative score has no negatives.
Bounds are floating point with a margin; scores are exact.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from galvane.llm.common import written
from galvane.llm.metric_search import matrix, scores

SHARD_ROWS, BUCKET_ROWS = 16384, 1024
CLASSES, LENGTHS = 8, 4
BLOCK, PART, MOST_TASKS = 256, 1 << 16, 20000
FOCUS = 3
NONE = np.iinfo(np.int64).min
TOP = np.iinfo(np.int64).max


def whole(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, label, v (float64 bytes), length: the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = v.values if v.is_valid else None
                if i is None or label is None or x is None or x.null_count:
                    continue
                x = np.floor(scale * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    x = np.concatenate([x, np.zeros(dims - len(x))])
                    out.append((i, label, x.tobytes(), float(np.sqrt(x @ x))))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["vec_id", "label", "v", "length"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, v binary, length double")


class Bucket:
    """Rows of like length: exact vectors by id, and sorted coordinate lists of their directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, length: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        length = length[order]
        self.longest = float(length.max(initial=0))
        self.unit = self.x / np.maximum(length, 1e-300)[:, None]
        self.shortest = float(length.min(initial=0))
        self.lists = np.argsort(self.unit, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.unit, self.lists, 0)

    def scored(self, q: np.ndarray, length: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of all rows that reach need, and perhaps of some that don't."""
        n = len(self.ids)
        size = np.maximum(length * np.where(need > 0, self.longest, self.shortest), 1e-100)
        t = need / size - 1e-9  # a score needs at least this cosine
        t = np.where(length == 0, np.where(need > 0, 2.0, -1.0), t)
        live = np.flatnonzero(t <= 1)
        if not len(live):
            return
        unit = q[live] / np.maximum(length[live], 1e-300)[:, None]
        t = np.clip(t[live], -1, 1)[:, None]
        k = min(FOCUS, q.shape[1])
        focus = np.argpartition(-np.abs(unit), k - 1, axis=1)[:, :k]
        qf = np.take_along_axis(unit, focus, 1)
        spread = np.sqrt(np.maximum(0, (1 - t * t) * (1 - qf * qf))) + 1e-9
        low = np.where((t > 0) & (qf > -t), t * qf - spread, -2.0)
        high = np.where((t > 0) & (qf < t), t * qf + spread, 2.0)
        a, b = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            a[at], b[at] = np.searchsorted(self.sorted[:, f], low[at], "left"), np.searchsorted(self.sorted[:, f], high[at], "right")
        best = (b - a).argmin(1)
        at = np.arange(len(live))
        a, b = a[at, best], b[at, best]
        wide = (b - a) * 8 > n
        rows = live[wide]
        if len(rows):
            s = scores(q[rows], self.x)
            hit, col = np.nonzero(s >= need[rows, None])
            yield rows[hit], col, s[hit, col]
        for j in np.flatnonzero(~wide & (b > a)):
            cand = self.lists[a[j] : b[j], focus[j, best[j]]]
            for g in range(k):
                if g != best[j]:
                    p = self.unit[cand, focus[j, g]]
                    cand = cand[(p >= low[j, g]) & (p <= high[j, g])]
            if len(cand):
                yield np.full(len(cand), live[j]), cand, scores(q[live[j] : live[j] + 1], self.x[cand])[0]


def buckets(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, length: np.ndarray) -> list[Bucket]:
    order = np.argsort(-length, kind="stable")
    return [Bucket(ids[p], labels[p], x[p], length[p]) for p in (order[a : a + BUCKET_ROWS] for a in range(0, len(order), BUCKET_ROWS))]


class Best:
    """The k best rows by (score, smaller id) of each list."""

    def __init__(self, lists: int, k: int):
        self.score, self.id, self.k = np.full((lists, k), NONE), np.full((lists, k), TOP), k

    def take(self, which: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(which)
        if not len(touched):
            return
        who = np.concatenate([which, np.repeat(touched, self.k)])
        ids, score = np.concatenate([ids, self.id[touched].ravel()]), np.concatenate([score, self.score[touched].ravel()])
        order = np.lexsort((ids, -score.astype(np.float64) if np.abs(score[score > NONE]).max(initial=0) < 2**52 else ~score, who))
        who = who[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who, "left")
        keep = order[nth < self.k]
        self.id[touched], self.score[touched] = ids[keep].reshape(-1, self.k), score[keep].reshape(-1, self.k)


def nearest(rows: list[Bucket], asked: tuple, k: int) -> pa.Table:
    """The k best rows of each anchor's label: anchor, vec_id, score."""
    number, ids, labels, q, length, floor = asked
    best = Best(len(ids), k)
    for bucket in rows:
        need = np.maximum(floor, best.score[:, -1])
        for who, col, s in bucket.scored(q, length, need.astype(np.float64)):
            own = (bucket.labels[col] == labels[who]) & (bucket.ids[col] != ids[who])
            best.take(who[own], bucket.ids[col[own]], s[own])
    hit = best.score > NONE
    return pa.table({"anchor": np.repeat(number, hit.sum(1)), "anchor_id": np.repeat(ids, hit.sum(1)), "vec_id": best.id[hit], "score": best.score[hit]})


def negatives(rows: list[Bucket], asked: tuple, k: int, low: int, high: int) -> pa.Table:
    """The k best rows of other labels in the band of each positive: anchor, positive, vec_id, score."""
    number, ids, labels, q, length, positives = asked  # positives: lists of (nth, score)
    lists = [(a, nth, s) for a, own in enumerate(positives) for nth, s in own if s >= 0]
    anchor, nth, ps = (np.array([x[i] for x in lists], np.int64) for i in range(3))
    least, most = -(-low * ps // 100), high * ps // 100
    best = Best(len(lists), k)
    first = np.searchsorted(anchor, np.arange(len(ids)))
    count = np.searchsorted(anchor, np.arange(len(ids)), "right") - first
    for bucket in rows:
        need = np.full(len(ids), np.inf)
        np.minimum.at(need, anchor, np.maximum(least, best.score[:, -1]).astype(np.float64))
        for who, col, s in bucket.scored(q, length, need):
            other = bucket.labels[col] != labels[who]
            who, col, s = who[other], col[other], s[other]
            for j in range(int(count.max(initial=0))):
                at = first[who] + j
                ok = np.flatnonzero(j < count[who])
                ok = ok[(s[ok] <= most[at[ok]]) & (s[ok] >= np.maximum(least[at[ok]], best.score[at[ok], -1]))]
                best.take(at[ok], bucket.ids[col[ok]], s[ok])
    hit = best.score > NONE
    n = hit.sum(1)
    return pa.table({"anchor": np.repeat(number[anchor], n), "nth": np.repeat(nth, n).astype(np.int32), "vec_id": best.id[hit], "score": best.score[hit]})


FOUND = {"nearest": "anchor bigint, anchor_id bigint, vec_id bigint, score bigint", "negatives": "anchor bigint, nth int, vec_id bigint, score bigint"}


def passed(shards: DataFrame, sent: DataFrame, dims: int, parts: int, tasks: int, search, schema: str) -> DataFrame:
    """search of each block of anchors (shard, part, data) against its shard's rows (shard, vec_id, label, v, length).

    Rows of a shard come before the blocks, which stream past them; a task's memory is a shard and a block.
    """
    rows = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "v", "length")
    asked = sent.select("shard", "part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("label"), F.col("data").alias("v"), F.lit(None).cast("double").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, index = None, [], None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "kind"))
            edge = np.flatnonzero((np.diff(shard, prepend=shard[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0)) if len(shard) else []
            for a, b in zip([0, *edge], [*edge, len(shard)], strict=True):
                if a == b:
                    continue
                if (shard[a], part[a]) != key:
                    key, kept, index = (shard[a], part[a]), [], None
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    kept.append((piece.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), piece.column("label").to_numpy(zero_copy_only=False).astype(np.int64), matrix(piece.column("v"), dims), piece.column("length").to_numpy(zero_copy_only=False)))
                    continue
                if index is None:
                    index = buckets(*(np.concatenate(x) for x in zip(*kept, strict=True))) if kept else []
                for blob in piece.column("v"):
                    if index:
                        yield from search(index, pickle.loads(blob.as_py())).to_batches()

    both = rows.unionByName(asked).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    return both.mapInArrow(run, schema)


def mined(vectors: DataFrame, is_anchor: str, positives: int = 5, per_positive: int = 3, scale: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and anchor_row of vectors (vec_id, embedding, label).

    low and high: the band of a negative's score, in hundredths of the positive's.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    dims = max(1, dims if dims is not None and dims > 0 else 1)
    base = written(whole(rows, dims, scale).select("*", F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int").alias("class"), F.monotonically_increasing_id().alias("row")), "vectors")
    bounds = base.agg(F.percentile_approx("length", [i / LENGTHS for i in range(1, LENGTHS)])).first()[0] or []
    range_ = sum((F.when(F.col("length") < b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))  # 0: the longest
    base = base.withColumn("far", range_)
    directory = base.groupBy("class", "far").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("class", "far").collect()  # CLASSES * LENGTHS rows at most
    shards, first = [], 0
    for r in directory:
        n = math.ceil(r["n"] / SHARD_ROWS)
        shards.append((r["class"], r["far"], first, n, r["longest"]))
        first += n
    at = F.lit(0)
    for c, far, a, n, _ in shards:
        at = F.when((F.col("class") == c) & (F.col("far") == far), a + F.pmod(F.xxhash64("row"), F.lit(n))).otherwise(at)
    placed = base.withColumn("shard", at.cast("int"))
    anchors = base.where(is_anchor)
    parts = max(1, -(-anchors.count() // PART))
    tasks = int(min(max(1, first * parts), MOST_TASKS))
    home = {c: far for c, far, *_ in reversed(shards)}  # the longest rows of each class

    def blocks(phase: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, ids, labels, class_, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label", "class", "floor"))
                v, length = matrix(batch.column("v"), dims), batch.column("length").to_numpy(zero_copy_only=False)
                more = [[(x["nth"], x["score"]) for x in p] for p in batch.column("positives").to_pylist()] if phase == "negatives" else None
                out = []
                for c, far, a, n, longest in shards:
                    open_ = (floor <= length * longest * (1 + 1e-9)) | (floor <= 0)
                    if phase != "negatives":
                        open_ &= (class_ == c) & ((home[c] == far) == (phase == "home"))
                    chosen = np.flatnonzero(open_)
                    for i in range(0, len(chosen), BLOCK):
                        x = chosen[i : i + BLOCK]
                        last = floor[x].astype(np.float64) if more is None else [more[k] for k in x]
                        blob = pickle.dumps((row[x], ids[x], labels[x], v[x], length[x], last), protocol=5)
                        out += [(s, int(row[x[0]] % parts), blob) for s in range(a, a + n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["shard", "part", "data"])

        return run

    def sent(asked: DataFrame, phase: str) -> DataFrame:
        return asked.mapInArrow(blocks(phase), "shard int, part int, data binary")

    lowest = F.lit(-(2.0**62))
    find = lambda index, asked: nearest(index, asked, positives)
    near = written(passed(placed, sent(anchors.withColumn("floor", lowest), "home"), dims, parts, tasks, find, FOUND["nearest"]), "near")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    nth = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == positives).select(F.col("anchor").alias("row"), F.col("score").cast("double").alias("floor"))
    rest = passed(placed, sent(anchors.join(nth, "row", "left").withColumn("floor", F.coalesce("floor", lowest)), "rest"), dims, parts, tasks, find, FOUND["nearest"])
    best = written(near.unionByName(rest).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")
    known = best.where("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("nth", "score")).alias("positives"), F.ceil(F.min("score") * low / 100).cast("double").alias("floor"))
    band = lambda index, asked: negatives(index, asked, per_positive, low, high)
    found = passed(placed, sent(anchors.join(known, "row"), "negatives"), dims, parts, tasks, band, FOUND["negatives"])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= per_positive)
    named = best.select("anchor", "nth", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("anchor").alias("anchor_row"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The query: labels of ids divisible by 7 are turned on by one, anchors are ids divisible by 50."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(embeddings.select("vec_id", "embedding", turned.alias("label")), "vec_id % 50 = 0")
