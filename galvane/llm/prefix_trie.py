"""Prefix trie of conversations: shared beginnings, and totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. It is told by the running sum of four 32-bit pieces of an
MD5 of (place, digest of role and text), and named by its depth and its smallest member. Totals of
subtrees come from rounds of joins: rake takes all leaves off and adds what they hold to their parents;
compress takes out nodes with one child, of neighbours in a chain the one whose depth has the smaller
lowest bit, so that a chain halves each round. A node taken out notes the child that it waits for and
what it adds to that child's total; the notes are re-expanded by jumps over notes, twice as far each time.

Defined results: turns go by turn (null first), then role, then text; null roles and texts are empty;
rows without a conv_id take no part; a conversation without turns ends at the root; an empty table has
no nodes. Equal turns of one conversation stand one after the other. Columns other than those named are
ignored. No task holds a conversation, a node's members or its children; the hash of a node's ends is by
its definition sequential, and one task streams the joined ids (pieces of at most 10,000) through it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galvane.llm.common import written
from galvane.operators.ranks import running

PIECES = ("h0", "h1", "h2", "h3")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest, bytes: the turns of each conversation in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    first = F.col("turn").asc_nulls_first()
    ranked = running(rows, ["conv_id"], [first, F.col("role"), F.col("text")], {"at": F.lit(1)}, lambda df: written(df, "turns"), [first, F.substring("role", 1, 32), F.substring("text", 1, 32)])
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return ranked.select("conv_id", "at", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(own: DataFrame, spread: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, digest, bytes), with a borrowed beginning.

    Conversation c takes its first h turns, h = crc32(c) % (most + 1), from conversation c - c % spread.
    """
    convs = own.groupBy("conv_id").agg(F.max("at").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % spread).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(lent, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    heads = own.where(F.col("at") <= most).select(F.col("conv_id").alias("base"), "at", "digest", "bytes")
    heads = convs.select("conv_id", "base", "h").join(heads, "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "digest", "bytes")
    tails = own.join(convs.select("conv_id", "h", "k"), "conv_id").where("at > h").select("conv_id", (F.col("k") + F.col("at") - F.col("h")).alias("depth"), "digest", "bytes")
    return convs.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), heads.unionByName(tails)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, digest, bytes) with h0 to h3, which tell the sequence of turns up to there, and u0 to u3, the same of the turns before."""
    mark = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"))
    pieces = rows.select("conv_id", "depth", "bytes", *[F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long").alias(f"m{i}") for i in range(4)])
    summed = running(pieces, ["conv_id"], [F.col("depth")], {h: F.col(f"m{i}") for i, h in enumerate(PIECES)}, lambda df: written(df, "pieces"))
    return summed.select("conv_id", "depth", "bytes", *PIECES, *[(F.col(h) - F.col(f"m{i}")).alias(f"u{i}") for i, h in enumerate(PIECES)])


def subtree_totals(nodes: DataFrame, weights: Sequence[str]) -> DataFrame:
    """node and each weight summed over its subtree. nodes: node (unique), up (null: a root), depth, weights (long)."""
    low = F.col("depth").cast("long")
    live = written(nodes.select("node", "up", low.alias("depth"), *weights, *[F.lit(0).cast("long").alias(f"{w}_due") for w in weights]), "live")
    done, notes = [], []
    while not live.isEmpty():  # rounds: the logarithm of the number of nodes
        kids = live.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n"))
        marked = live.join(kids, "node", "left").withColumn("leaf", F.isnull("n")).drop("n")
        raked = marked.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
            *[F.sum(F.when(F.col("leaf"), F.col(w) + F.col(f"{w}_due")).otherwise(0)).alias(f"{w}_got") for w in weights], F.count_if(~F.col("leaf")).alias("kids"), F.min(F.when(~F.col("leaf"), F.col("node"))).alias("only")
        )
        rest = marked.join(raked, "node", "left").select("node", "up", "depth", "leaf", *[(F.col(w) + F.coalesce(F.col(f"{w}_got"), F.lit(0))).alias(w) for w in weights], *[f"{w}_due" for w in weights], F.expr("kids = 1 AND up IS NOT NULL").alias("unary"), "only")
        rest = written(rest, "raked")
        done.append(rest.where("leaf").select("node", *weights))
        chain = rest.where("unary")
        rank = F.struct(F.col("depth").bitwiseAND(-F.col("depth")), "depth")
        below = chain.select(F.col("node").alias("only"), rank.alias("below"))
        above = chain.select(F.col("node").alias("up"), rank.alias("above"))
        taken = chain.withColumn("rank", rank).join(below, "only", "left").join(above, "up", "left").where("(below IS NULL OR rank < below) AND (above IS NULL OR rank < above)")
        heirs = taken.select(F.col("only").alias("node"), F.col("node").alias("out"), F.col("up").alias("new_up"), *[F.col(w).alias(f"{w}_out") for w in weights], *[F.col(f"{w}_due").alias(f"{w}_out_due") for w in weights])
        left = rest.where("NOT leaf").join(taken.select("node"), "node", "left_anti").join(heirs, "node", "left")
        zero = F.lit(0)
        live = written(
            left.select(
                "node", F.coalesce("new_up", "up").alias("up"), "depth", *weights,
                *[(F.col(f"{w}_due") + F.coalesce(F.col(f"{w}_out"), zero) + F.coalesce(F.col(f"{w}_out_due"), zero)).alias(f"{w}_due") for w in weights],
                "out", *[(F.col(f"{w}_due") + F.col(f"{w}_out")).alias(f"{w}_add") for w in weights],
            ),
            "live",
        )
        notes.append(live.where("out IS NOT NULL").select(F.col("out").alias("node"), F.col("node").alias("waits"), *[F.col(f"{w}_add") for w in weights]))
        live = live.drop("out", *[f"{w}_add" for w in weights])
    return expanded(done, notes, weights)


def expanded(done: list[DataFrame], notes: list[DataFrame], weights: Sequence[str]) -> DataFrame:
    """Totals of the nodes raked (done) and of those taken out of chains: a note's total is its sum and that of the node it waits for."""
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    if not done:
        return None
    totals, open_ = union(done), union(notes)
    for _ in range(math.ceil(math.log2(len(notes) + 1))):  # a node waits for one that left in a later round
        after = open_.select(F.col("node").alias("waits"), F.col("waits").alias("then"), *[F.col(f"{w}_add").alias(f"{w}_then") for w in weights])
        open_ = written(open_.join(after, "waits", "left").select("node", F.coalesce("then", "waits").alias("waits"), *[(F.col(f"{w}_add") + F.coalesce(F.col(f"{w}_then"), F.lit(0))).alias(f"{w}_add") for w in weights]), "notes")
    held = open_.join(totals.withColumnRenamed("node", "waits"), "waits").select("node", *[(F.col(w) + F.col(f"{w}_add")).alias(w) for w in weights])
    return totals.unionByName(held)


def ends_digest(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the members (long) that end there, ascending, joined by commas. ends: node, member."""
    kind = ends.schema["node"].dataType.simpleString()

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        nodes = batch.column("node").to_pylist()
        a = 0
        for b in range(1, len(nodes) + 1):
            if b == len(nodes) or nodes[b] != nodes[a]:
                yield a, b
                a = b

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, members = list(runs(batch)), batch.column("member").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array([a for a, _ in cut], pa.int64())), pa.array([members[a] for a, _ in cut], pa.int64()), pa.array([",".join(map(str, members[a:b])) for a, b in cut], pa.string())], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            out = []
            for a, b in runs(batch):
                at, ids = batch.column("node")[a : a + 1], batch.column("ids").slice(a, b - a).to_pylist()
                if node is not None and at[0] == node[0]:
                    digest.update(b"," + ",".join(ids).encode())
                    continue
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(",".join(ids).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([n for n, _ in out]), pa.array([h for _, h in out], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([node, pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    pieces = ends.repartitionByRange("node", "member").sortWithinPartitions("node", "member").mapInArrow(joined, f"node {kind}, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, f"node {kind}, ends_sha256 string")


def name(depth: str | Column = "depth", conv: str | Column = "conv_id") -> Column:
    return F.struct(F.col(depth).cast("long").alias("depth") if isinstance(depth, str) else depth.cast("long").alias("depth"), (F.col(conv) if isinstance(conv, str) else conv).alias("conv_id"))


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, length) with turns (conv_id, depth from 1, digest, bytes), one row each."""
    path = written(prefixes(rows), "prefixes")
    up = [f"u{i}" for i in range(4)]
    nodes = path.groupBy("depth", *PIECES, *up).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), *[zero.alias(c) for c in (*PIECES, *up)], "conv_id", "n_convs", zero.alias("bytes"))
    nodes = written(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(h).alias(u) for h, u in zip(PIECES, up, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    named = written(nodes.join(parents, ["depth", *up], "left").select(name().alias("node"), F.when(F.col("depth") > 0, name(F.col("depth") - 1, "parent_conv_id")).alias("up"), "n_convs", "bytes"), "named")
    kids = named.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    tree = written(named.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "tree")
    totals = subtree_totals(tree.select("node", "up", F.col("node.depth").alias("depth"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = path.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(F.col("conv_id").alias("member"), F.col("depth").cast("long").alias("depth"), *PIECES)
    last = last.unionByName(convs.where("length = 0").select(F.col("conv_id").alias("member"), zero.alias("depth"), *[zero.alias(h) for h in PIECES]))
    ends = written(last.join(nodes.select("depth", *PIECES, "conv_id"), ["depth", *PIECES]).select(name().alias("node"), "member"), "ends")
    out = tree if totals is None else tree.join(totals, "node")
    if totals is None:
        out = out.select("*", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    out = out.join(ends_digest(ends), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node.conv_id").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("up.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text), with the query's columns."""
    own = written(turns(conversations), "own")
    return trie(*rebuilt(own))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    own = written(turns(conversations), "own")
    return trie(own.groupBy("conv_id").agg(F.max("at").alias("length")), own.withColumnRenamed("at", "depth"))
