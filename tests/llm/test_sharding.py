"""Shards: sizes, slots, groups; hot groups, edges."""

import zlib

import pytest
from pyspark.sql import functions as F

from galvane.llm import sharding

SCHEMA = "doc_id bigint, text string"


def whole(rows, got):
    """What holds for every result: all rows, right sizes and sums, slots without gaps."""
    size = lambda t: len((t or "").encode()) + 1
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]


def test_even_and_groups_together(spark):
    rows = [(i, f"text number {i // 3} " + "word " * (i // 3 % 40)) for i in range(3000)]
    got = sharding.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    by = whole(rows, got)
    assert max(by) - min(by) < 0.02 * sum(by) / 8
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())


def test_hot_group_is_subdivided(spark):
    rows = [(i, "the same text in a third of all rows and more") for i in range(1500)] + [(5000 + i, f"another {i}" * 4) for i in range(1500)] + [(9, "one row again and again")] * 600
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    by = whole(rows, sharding.digest(df).collect())
    assert max(by) - min(by) < 0.02 * sum(by) / 8
    keyed = df.select(F.xxhash64("text").alias("group_hash"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("own_hash"), F.octet_length("text").cast("long").alias("size"))
    _, held, divided = sharding.with_ranges(keyed, 64)
    total = sum(b for _, b, _ in held)
    assert len(divided) >= 2 and max(b for _, b, _ in held) <= 6 * total / 64 + 100


def test_splitters_as_sorting():
    import numpy as np

    rnd = np.random.default_rng(3)
    group, own = rnd.integers(0, 20, 500), rnd.integers(-50, 50, 500)
    bounds = sharding.Splitters(rnd.integers(0, 20, 30), np.where(rnd.random(30) < 0.4, sharding.LOWEST, rnd.integers(-50, 50, 30)))
    order = sorted(zip(bounds.group.tolist(), bounds.own.tolist(), strict=True))
    want = [sum(b <= (g, o) for b in order) for g, o in zip(group.tolist(), own.tolist(), strict=True)]
    assert bounds.place(group, own).tolist() == want


def test_edges(spark):
    rows = [(None, None), (None, None), (1, ""), (2, "x" * 200000), (2, "y"), (3, None)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA + ", size string, shard string, range int")
    by = whole(rows, sharding.digest(df).collect())
    assert sum(b >= 200000 for b in by) == 1
    assert sharding.digest(df.where("false")).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 50}", i) for i in range(400)], SCHEMA + ", more int")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "more").collect())) == sorted(map(tuple, df.collect()))
    assert back.select("shard").distinct().count() == 4
