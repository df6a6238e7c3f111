"""Exact top-k by inner product: M-tree best-first search.

Vectors x become whole numbers floor(64 x). One more coordinate, sqrt(M - |x|^2) with M the largest
|x|^2, makes inner products and Euclidean distances agree: |q' - x'|^2 = M + |q|^2 - 2 q.x with 0 as
the query's own. The tree's upper level is a directory of pivots, as many as the table fills shards but
for a bound on its bytes, each with the covering radius of its rows; a large pivot's rows make several
shards. A shard is a tree of pages: routing objects with covering radii, and the distances of pages to
the shard's pivot and of entries to their routing object. Each query takes its pages best bound first;
those and entries that the stored distances and the triangle inequality rule out are not compared.
First each query searches its own pivot's shards; then, with the score that its k-th best has there, it
is sent to those pivots alone whose covering radius leaves them open. Bounds are floating point with a
margin; scores are exact.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without
an id, take no part; shorter vectors count as ending in zeros; equal scores go by smaller id; rows
with one id are candidates each, and a query none of its own id.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from galvane.llm.common import written

LEAST_PIVOTS, DIRECTORY_BYTES = 32, 16 << 20
SHARD_ROWS = 8192
PAGES = 16
BLOCK = 1024


def whole(docs: DataFrame, dims: int) -> DataFrame:
    """vec_id, v (float64 bytes), norm2: the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, norms = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values if v.is_valid else None
                if i is None or x is None or x.null_count:
                    continue
                x = np.floor(64 * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(x).all():
                    continue
                x = np.concatenate([x, np.zeros(dims - len(x))])
                ids.append(i)
                out.append(x.tobytes())
                norms.append(float(x @ x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm2"])

    return docs.mapInArrow(run, "vec_id bigint, v binary, norm2 double")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if max(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1], 1) < 2**52:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(c) for c in r] for r in m], object) for m in (q, x))
    return (a @ b.T).astype(np.int64)


def reach(score: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    """The distance beyond which no row has that score or more with a query of that square norm."""
    return np.sqrt(np.maximum(0, most + norm2 - 2 * score + 1e-6 * (most + norm2) + 1))


class Tree:
    """One shard: its pages, by routing object."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float):
        up = lifted(x, most)
        self.pivot = up.mean(0, keepdims=True)
        n = max(1, min(PAGES, len(x) // 16))
        routing = up[np.linspace(0, len(x) - 1, n).astype(int)]
        d = distances(up, routing)
        page = d.argmin(1)
        self.pages = []
        for k in range(n):
            own = np.flatnonzero(page == k)
            if len(own):
                near = d[own, k]
                order = np.argsort(near, kind="stable")
                self.pages.append((ids[own[order]], x[own[order]], near[order]))
        kept = np.unique(page)
        self.routing = routing[kept]
        self.radius = np.array([p[2][-1] for p in self.pages])
        self.parent = distances(self.routing, self.pivot)[:, 0]  # of pages to the shard's pivot
        self.cover = float((self.parent + self.radius).max())

    @staticmethod
    def asked(page: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each page with the queries whose turn it is there."""
        order = np.argsort(page, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
            yield int(page[part[0]]), part

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k of each query; none that can't beat floor need be there."""
        n = len(q)
        best, who = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64)
        norm = (q * q).sum(1)
        lift = np.concatenate([q, np.zeros((n, 1))], 1)
        far = lambda s: reach(s, norm, most)
        to_pivot = distances(lift, self.pivot)[:, 0]
        open_ = np.flatnonzero(to_pivot - self.cover <= far(kth))
        if not len(open_):
            return who, best
        hope = np.full((n, len(self.pages)), np.inf)
        rough = np.maximum(0, np.abs(to_pivot[open_, None] - self.parent[None]) - self.radius[None])
        some = np.flatnonzero((rough <= far(kth)[open_, None]).any(0))  # distances to the rest aren't computed
        to_page = np.full((n, len(self.pages)), np.inf)
        to_page[np.ix_(open_, some)] = distances(lift[open_], self.routing[some])
        hope[np.ix_(open_, some)] = np.maximum(rough[:, some], to_page[np.ix_(open_, some)] - self.radius[None, some])
        turn = np.argsort(hope, axis=1, kind="stable")  # each query's own order of pages
        for p, rows in ((p, rows) for k_th in range(len(self.pages)) for p, rows in self.asked(turn[:, k_th])):
            limit = far(kth)
            rows = rows[hope[rows, p] <= limit[rows]]
            if not len(rows):
                continue
            ids, x, near = self.pages[p]
            lo = np.searchsorted(near, (to_page[rows, p] - limit[rows]).min())
            hi = np.searchsorted(near, (to_page[rows, p] + limit[rows]).max(), "right")
            if lo == hi:
                continue
            s = scores(q[rows], x[lo:hi])
            s = np.where(ids[None, lo:hi] == qid[rows, None], np.iinfo(np.int64).min, s)
            better = np.flatnonzero(s.max(1) >= np.maximum(best[rows, -1], kth[rows]))
            if not len(better):
                continue
            rows, s = rows[better], s[better]
            if s.shape[1] > 4 * k:  # the k-th of the page bounds what can count; ties at it all stay
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                keep = (s >= bar[:, None]).any(0)
                s, cand = s[:, keep], ids[lo:hi][keep]
            else:
                cand = ids[lo:hi]
            all_s = np.concatenate([best[rows], s], 1)
            all_i = np.concatenate([who[rows], np.broadcast_to(cand, s.shape)], 1)
            order = np.lexsort((all_i, -all_s.astype(np.float64) if abs(all_s[all_s > np.iinfo(np.int64).min]).max(initial=0) < 2**52 else ~all_s), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1].astype(np.float64))
        return who, best


RESULT = "query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: of vectors (vec_id, embedding), for rows where is_query holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    dims = max(1, dims if dims is not None and dims > 0 else 1)
    base = written(whole(rows, dims), "vectors")
    most, count = base.agg(F.max("norm2"), F.count("*")).first()
    most = float(most or 0)
    wanted = min(max(LEAST_PIVOTS, -(-count // SHARD_ROWS)), max(LEAST_PIVOTS, DIRECTORY_BYTES // (8 * dims)))
    pivots = base.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(wanted).collect()
    pivot = lifted(np.array([np.frombuffer(r[0], np.float64) for r in pivots]).reshape(-1, dims), most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lifted(matrix(batch.column(1), dims), most), pivot) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.argmin(1), pa.int32()), pa.array(far.min(1, initial=np.inf))], names=["vec_id", "v", "pivot", "far"])

    placed = written(base.select("vec_id", "v").mapInArrow(assign, "vec_id bigint, v binary, pivot int, far double"), "placed")
    directory = placed.groupBy("pivot").agg(F.count("*"), F.max("far")).collect()  # a row for each pivot
    sizes, radius = {r[0]: r[1] for r in directory}, {r[0]: r[2] for r in directory}
    parts = {p: math.ceil(n / SHARD_ROWS) for p, n in sizes.items()}
    first, total = {}, 0
    for p in sorted(parts):
        first[p], total = total, total + parts[p]
    table = F.create_map(*[F.lit(x) for p in first for x in (p, F.struct(F.lit(first[p]).alias("a"), F.lit(parts[p]).alias("n")))]) if first else None
    if table is None:
        return placed.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    at = table[F.col("pivot")]
    shards = placed.withColumn("shard", (at["a"] + F.pmod(F.xxhash64("vec_id", "v"), at["n"].cast("long"))).cast("int")).select("shard", "vec_id", "v")
    queries = placed.where(is_query)
    own = {p: list(range(first[p], first[p] + parts[p])) for p in first}

    def blocks(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v, piv = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
                floor = batch.column(3).to_numpy(zero_copy_only=False)
                out = []
                if not home and len(ids):
                    away = distances(np.concatenate([v, np.zeros((len(v), 1))], 1), pivot)
                    limit = reach(floor, (v * v).sum(1), most)
                for p in own:
                    chosen = np.flatnonzero(piv == p if home else (piv != p) & (away[:, p] - radius[p] <= limit)) if len(ids) else ids
                    for a in range(0, len(chosen), BLOCK):
                        x = chosen[a : a + BLOCK]
                        blob = pickle.dumps((ids[x], v[x], floor[x]), protocol=5)
                        out += [(s, blob) for s in own[p]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["shard", "data"])

        return run

    def search(key, rows, asked):
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        tree = Tree(rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dims), most)
        out = []
        for blob in asked.column("data"):
            ids, q, floor = pickle.loads(blob.as_py())
            who, s = tree.search(ids, q, floor, k, most)
            hit = s > np.iinfo(np.int64).min
            out.append((np.repeat(ids, hit.sum(1)), who[hit], s[hit]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    def found(asked: DataFrame, home: bool) -> DataFrame:
        sent = asked.mapInArrow(blocks(home), "shard int, data binary")
        return shards.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(search, RESULT)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    lowest = F.lit(-(2.0**62))
    near = written(found(queries.select("vec_id", "v", "pivot", lowest.alias("floor")), True), "near")
    kth = near.withColumn("rank", rank).where(F.col("rank") == k).groupBy(F.col("query_id").alias("of")).agg(F.max(F.col("score").cast("double")).alias("kth"))
    rest = queries.join(kth, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", "pivot", F.coalesce("kth", lowest).alias("floor"))
    both = near.unionByName(found(rest, False))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
