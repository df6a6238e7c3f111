"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles. Documents with equal sets are one node from the
start. Every node lists the shingles of its prefix: in one order of all shingles, frequent ones
last, so many that two sets alike enough must share one of them. The inverted lists of prefixes
name candidates: first only neighbours by size in each list. Bit sketches of the sets bound how much
two can have in common and rule most of them out. The others are searched (below), linked and
joined into components. Lists that overlap much, as those of one passage do, become one, which keeps
all their pairs. Then each member's nearest sketch in another component, and at last, in lists that have
more of them, all plausible pairs that still lie in different components, are searched too.
So every link is found or lies inside a component, and no list of n copies makes n^2 pairs.

Searching is done in shards, each with the sets of a query block and its candidates and an inverted
index over them. For each query the long inverted lists are set aside; the short ones are merged,
and documents met often enough are looked up in the long ones by binary search (DivideSkip); those
reaching the required overlap are retained.

Defined results: null and empty texts have 0 shingles and are their own component; a row without a
doc_id is counted but linked with nothing; rows with one doc_id and different texts are linked each
by its own text, and one_of_each takes away only the rows whose text is a copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galvane.llm.common import PACKED, U64, buckets_for, chunks, column_bytes, dealt, inside, lower_ascii, mix, packed, unpacked, row_key, whole_grams, without_rows, word_grams, word_hashes, words, written
from galvane.llm.components import components

SAMPLE_DOCS, FREQUENT = 20_000, 65_536
#: How many lists may take in others of their name; those left after that stay as they are.
MERGES = 8


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, part, poff in chunks(data, off):
        starts, ends, first = words(part, poff)
        h = word_hashes(lower_ascii(part), starts, ends)
        g = word_grams(h, n)
        for k in range(b - a):
            i, j = first[k], first[k + 1]
            if j - i >= n:
                yield np.unique(g[i : j - n + 1])
            else:
                yield whole_grams(h, np.array([i]), np.array([j])) if j > i else np.zeros(0, U64)


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix((mix(s).sum(dtype=U64) ^ U64(len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).reshape(1))[0].astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of 512 to 65536 classes of shingles, is the number that the set has odd?"""
    m = min(65536, max(512, 1 << (2 * len(s)).bit_length()))
    return np.packbits(np.bincount((s & U64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the size of the symmetric difference, from sketches."""
    while len(x) > len(y):  # classes modulo half as many
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches (node, n, sketch) don't rule out; exact: none is lost.

    Similarity 0.75 means that at most a seventh of the sizes' sum is in the symmetric difference.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            keep = [7 * apart(np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8)) <= n[i] + m[i] for i in range(len(n))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sketches.select(F.col("node").alias("of_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("node").alias("of_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(one, F.col("a") == F.col("of_a")).join(two, F.col("b") == F.col("of_b"))
    return both.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(test, "a bigint, b bigint")


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, node and sketch of each document (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), node_of(s), sketch(s).tobytes()) for s in shingle_sets(*column_bytes(batch.column(1)))]
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "text_hash", "n", "node", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, node bigint, sketch binary")


def frequent_shingles(docs: DataFrame, count: int, n: int) -> np.ndarray:
    """Shingles that many of a bounded sample of documents have, the FREQUENT most so.

    They only come last in the order of shingles: any order gives the same links.
    """
    every = max(1, count // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    least = max(4, min(count, SAMPLE_DOCS) // 2000)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(*column_bytes(batch.column(1))))
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield packed(list(dealt(h % U64(n), n, h, c)))

    def count_up(key, table):
        h, c = (np.concatenate(x) for x in zip(*unpacked(table), strict=True))
        kinds, number = np.unique(h, return_inverse=True)
        total = np.bincount(number, c, len(kinds)).astype(np.int64)
        keep = total >= least
        return pa.table({"h": kinds[keep].astype(np.int64), "c": total[keep]})

    top = sample.mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(count_up, "h bigint, c bigint").orderBy(F.desc("c"), "h").limit(FREQUENT)
    return np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).astype(U64))


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The part of a set that meets that of any set with a Jaccard similarity of 0.75 or more."""
    size = len(s) - (3 * len(s) + 3) // 4 + 1
    late = np.zeros(len(s), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        late = frequent[at] == s
    return np.concatenate([s[~late], s[late]])[:size]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(flags)
    return first, np.append(first[1:], len(flags))[: len(first)]


FOUND = "list bigint, a bigint, b bigint, members binary"


def inverted_lists(docs: DataFrame, frequent: np.ndarray, n: int) -> DataFrame:
    """Rows of two kinds. list null: a pair of neighbours (a, b). Else the members (node, n) of a list of 3 or more; list is the member of least hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(prefix(s, frequent), node_of(s), len(s)) for s in shingle_sets(*column_bytes(batch.column(1))) if len(s)]
            if parts:
                size = [len(p) for p, _, _ in parts]
                h = np.concatenate([p for p, _, _ in parts])
                who, many = np.repeat([x for _, x, _ in parts], size), np.repeat(np.array([m for _, _, m in parts], np.uint32), size)
                yield packed(list(dealt(h % U64(n), n, h, who, many)))

    def neighbours(key, table):
        h, who, many = (np.concatenate(x) for x in zip(*unpacked(table), strict=True))
        order = np.argsort(h, kind="stable")  # most shingles stand alone and need no further order
        h, who, many = h[order], who[order], many[order]
        same = h[1:] == h[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        h, who, many = h[some], who[some], many[some]
        order = np.lexsort((who, many, h))
        h, who, many = h[order], who[order], many[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        h, who, many = h[new], who[new], many[new].astype(np.int64)
        new_list = np.ones(len(h), bool)  # another list, or sizes too far apart for any pair across
        new_list[1:] = (h[1:] != h[:-1]) | (4 * many[:-1] < 3 * many[1:])
        next_to = np.flatnonzero(~new_list)
        pairs = np.unique(np.stack([np.minimum(who[next_to - 1], who[next_to]), np.maximum(who[next_to - 1], who[next_to])], 1), axis=0) if len(next_to) else np.zeros((0, 2), np.int64)
        lists: dict[bytes, int] = {}
        for a, b in zip(*runs(new_list), strict=True):
            if b - a > 2:
                lists.setdefault(np.stack([who[a:b], many[a:b]], 1).tobytes(), int(who[a + int(mix(who[a:b].astype(U64)).argmin())]))
        k, m = len(pairs), len(lists)
        return pa.table({"list": pa.array([None] * k + list(lists.values()), pa.int64()), "a": pa.array([*pairs[:, 0].tolist(), *[None] * m], pa.int64()), "b": pa.array([*pairs[:, 1].tolist(), *[None] * m], pa.int64()), "members": pa.array([None] * k + list(lists), pa.binary())})

    return docs.mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(neighbours, FOUND)


def overlapping(each: list[np.ndarray]) -> list[np.ndarray]:
    """Lists (node, n) with those that bring few new members put into a longer one: every pair of a list is in one of the results."""
    each, out = sorted(each, key=len, reverse=True), []
    for _ in range(MERGES):
        if not each:
            break
        whole, apart_ = each[0], []
        most = len(whole) + len(whole) // 4
        for m in each[1:]:
            new = m[~np.isin(m[:, 0], whole[:, 0])]
            if len(whole) + len(new) <= most:
                whole = np.concatenate([whole, new])
            else:
                apart_.append(m)
        out.append(whole)
        each = apart_
    return out + each


def merged_lists(lists: DataFrame) -> DataFrame:
    """list, members: overlapping lists with the same member of least hash as one.

    The lists of a name are no more than the shingles in that member's prefix.
    """

    def merge(key, table):
        got = overlapping([np.frombuffer(m, np.int64).reshape(-1, 2) for m in sorted(set(table.column("members").to_pylist()))])
        return pa.table({"list": pa.array([node_of(m[:, 0].astype(U64)) for m in got], pa.int64()), "members": pa.array([m.tobytes() for m in got], pa.binary())})

    return lists.select("list", "members").groupBy("list").applyInArrow(merge, "list bigint, members binary")


def t_occurrence(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join all sets alike enough, by search for each set in the sets before it."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    by = np.argsort(tokens, kind="stable")  # within a token by document number
    tokens, doc = tokens[by], doc[by]
    root = np.arange(len(sets))
    for i, s in enumerate(sets):
        # sets before i are not larger; links need 3 len(s) / 4 in common at least
        lo, hi = np.searchsorted(tokens, s), np.searchsorted(tokens, s, "right")
        need = (3 * len(s) + 3) // 4
        long_ = int(need / (0.5 * math.log2(max(2, int((hi - lo).max())) + 1) + 1))  # lists set aside
        rank = np.argsort(hi - lo, kind="stable")
        short, far = rank[: len(s) - long_], rank[len(s) - long_ :]
        width = hi[short] - lo[short]
        base = np.concatenate([[0], np.cumsum(width)])
        merged = doc[np.arange(base[-1]) - np.repeat(base[:-1] - lo[short], width)]
        merged = np.sort(merged[merged < i], kind="stable")  # lists are sorted runs, which this merges
        head = np.flatnonzero(np.diff(merged, prepend=-1))
        cand, common = merged[head], np.diff(head, append=len(merged))
        keep = (common >= max(1, need - len(far))) & (4 * size[cand] >= 3 * len(s)) & (root[cand] != root[i])
        cand, common = cand[keep], common[keep]
        if not len(cand):
            continue
        for t in far:
            part = doc[lo[t] : hi[t]]
            at = np.minimum(np.searchsorted(part, cand), len(part) - 1)
            common += part[at] == cand
        for j in cand[100 * common >= 75 * (len(s) + size[cand] - common)]:
            if root[j] != root[i]:
                root[root == root[i]] = root[j]
                yield order[i], order[int(j)]


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the sets (node, members) of candidate pairs (a, b)."""
    shards = max(8, pairs.count() // 2000)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("of")).agg(F.min(F.least("a", "b")).alias("least"))  # pairs of a group meet in few shards
    shard = F.pmod(F.xxhash64("least"), F.lit(shards)).cast("int").alias("shard")
    placed = pairs.join(near, F.col("a") == F.col("of")).select(shard, F.explode(F.array("a", "b")).alias("of"))
    wanted = placed.distinct()

    def search(key, table):
        who = table.column("node").to_pylist()
        got = [np.frombuffer(x, U64) for x in table.column("members").to_pylist()]
        links = list(t_occurrence(got))
        return pa.table({"a": pa.array([who[i] for i, _ in links], pa.int64()), "b": pa.array([who[j] for _, j in links], pa.int64())})

    return wanted.join(sets, F.col("of") == F.col("node")).select("shard", "node", "members").groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, with classes modulo fewer."""
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def across(lists: DataFrame, roots: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """Plausible pairs (a, b) of a list's members in different components; sketches test them in place.

    nearest: of each member's pairs only that of the nearest sketch, to join components at small cost
    before all pairs are asked for; a row with more names a list that has others.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, np.frombuffer(m, np.int64).reshape(-1, 2)) for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                m = np.concatenate([x for _, x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in rows], [len(x) for _, x in rows])), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["list", "node", "n"])

    members = lists.select("list", "members").mapInArrow(spread, "list bigint, node bigint, n bigint")
    known = members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("list", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = written(known, "members")
    several = mixed.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(F.col("list").alias("of"))

    def pairs(key, table):
        node, n, root = (table.column(c).to_numpy() for c in ("node", "n", "root"))
        order = np.lexsort((node, n))
        node, n, root = node[order], n[order], root[order]
        raw = table.column("sketch").take(pa.array(order)).to_pylist()
        size = np.array([len(x) for x in raw])  # grows with n, so it is in order too
        stop = np.searchsorted(n, n * 4 // 3, "right")
        out, plausible_ = [], 0
        best, with_ = np.full(len(node), np.iinfo(np.int64).max), np.arange(len(node))
        for m in np.unique(size):
            own = np.flatnonzero(size == m)
            first, last = own[0], stop[own].max()
            words_ = np.concatenate([folded(np.frombuffer(b"".join(raw[k] for k in np.flatnonzero(size[first:last] == w) + first), np.uint8).reshape(-1, w), m) for w in np.unique(size[first:last])]).view(U64)
            for i in own:
                j = np.arange(i + 1, stop[i])
                j = j[root[j] != root[i]]
                far = np.bitwise_count(words_[j - first] ^ words_[i - first]).sum(1, dtype=np.int64)
                j, far = j[7 * far <= n[i] + n[j]], far[7 * far <= n[i] + n[j]]
                plausible_ += len(j)
                if len(j) and nearest:
                    if far.min() < best[i]:
                        best[i], with_[i] = far.min(), j[far.argmin()]
                    closer = far < best[j]
                    best[j[closer]], with_[j[closer]] = far[closer], i
                elif len(j):
                    out.append(np.stack([np.full(len(j), node[i]), node[j]], 1))
        if nearest:
            k = np.flatnonzero(with_ != np.arange(len(node)))
            out = [np.stack([node[k], node[with_[k]]], 1)]
        got = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
        more = [key[0].as_py()] if plausible_ > len(got) else []
        return pa.table({"a": pa.array([*got[:, 0].tolist(), *[None] * len(more)], pa.int64()), "b": pa.array([*got[:, 1].tolist(), *[None] * len(more)], pa.int64()), "more": pa.array([None] * len(got) + more, pa.int64())})

    named = sketches.select(F.col("node").alias("named"), "sketch")
    return mixed.join(several, F.col("list") == F.col("of"), "left_semi").join(named, F.col("node") == F.col("named")).select("list", "node", "n", "root", "sketch").groupBy("list").applyInArrow(pairs, "a bigint, b bigint, more bigint").distinct()


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: the least doc_id that each row reaches by links."""
    rows = docs.select(row_key()[0], "text", row_key()[1])
    known = rows.where("doc_id is not null").drop("text_hash")
    n = buckets_for(docs)
    base = written(nodes(rows), "nodes")
    frequent = frequent_shingles(known, base.count(), n)
    found = written(inverted_lists(known, frequent, n), "lists")
    first = base.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    by_node = base.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    by_node = written(by_node, "sketches")
    pairs = written(plausible(found.where("list is null").select("a", "b").distinct(), by_node), "pairs")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(node, s.tobytes()) for node, s in zip(batch.column(0).to_pylist(), shingle_sets(*column_bytes(batch.column(1))), strict=True) if node_of(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())], names=["node", "members"])

    def sets_of(names: DataFrame) -> DataFrame:
        wanted = written(names.join(first, "node").select(F.col("least").alias("of"), "node"), "wanted")
        return written(known.join(wanted, F.col("doc_id") == F.col("of")).select("node", "text").mapInArrow(members, "node bigint, members binary"), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    roots = components(written(linked(pairs, sets), "links"))
    lists = written(merged_lists(found.where("list is not null")), "merged")
    for nearest in (True, False):
        got = written(across(lists, roots, by_node, nearest), "across")
        rest = got.where("more is null").select("a", "b")
        if rest.isEmpty():
            break
        more = written(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node"), "node", "left_anti"), "more")
        if not more.isEmpty():
            sets = sets.unionByName(sets_of(more))
        more = written(linked(rest, sets), "links")
        if not more.isEmpty():  # the roots stand for the links they came from
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        if nearest:  # a list whose plausible pairs have all been searched is done
            lists = lists.join(got.where("more is not null").select(F.col("more").alias("of")), F.col("list") == F.col("of"), "left_semi")
    joined = first.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    joined = written(joined, "roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    ids = joined.join(least, "root").select(F.col("node").alias("of"), "component")
    whole = base.where("doc_id is not null and n > 0").join(ids, F.col("node") == F.col("of")).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return whole.unionByName(base.where("doc_id is null or n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that each document reaches by links."""
    return linked_rows(docs).drop("text_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with, of each component, the rows of its least doc_id; rows without a doc_id stay."""
    return without_rows(docs, linked_rows(docs).where("doc_id <> component_id"))
