"""Hard negatives against all pairs; the pruning against exact products; edges."""

import numpy as np
import pytest

from galvane.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """Rows of the query by all pairs."""
    live = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        live.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, label, q in live:
        if i % 50:
            continue
        score = [(-sum(a * b for a, b in zip(q, v, strict=False)), j, other) for j, other, v in live if j != i]
        for s, j, _ in sorted(x for x in score if x[2] == label)[:5]:
            near = sorted(x for x in score if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out)


def columns(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "lengths"])
def test_as_plain(spark, kind, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    v = centres[rnd.integers(0, 12, 700)] + 0.5 * rnd.normal(size=(700, 16))
    if kind == "lengths":
        v = np.round(v, 0) * rnd.choice([0, 0.01, 0.1, 1, 10], 700)[:, None]  # ties, zero vectors, buckets passed over
    rows = [(i, v[i].tolist(), int(rnd.choice([1, 1, 1, 2, 3, 8]))) for i in range(700)]
    monkeypatch.setattr(hn, "SHARD_ROWS", 60)
    monkeypatch.setattr(hn, "PART", 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = columns(hn.hard_negatives(df))
    assert found == plain(rows) and len(found) > 50


@pytest.mark.parametrize("seed", range(4))
def test_ranges_lose_nothing(seed):
    rnd = np.random.default_rng(seed)
    x = np.floor(rnd.normal(size=(500, 8)) * rnd.choice([3, 30], (500, 1)))
    x[:5] = 0
    q = np.floor(rnd.normal(size=(40, 8)) * 20)
    q[0] = 0
    exact = q @ x.T
    need = np.sort(exact, axis=1)[:, rnd.choice([-1, -3, -20, 0], 40)][np.arange(40), np.arange(40)]
    got = set()
    for bucket in hn.buckets(np.arange(500), np.zeros(500, int), x, np.sqrt((x * x).sum(1))):
        for who, col, s in bucket.scored(q, np.sqrt((q * q).sum(1)), need):
            got |= {(a, bucket.ids[b], c) for a, b, c in zip(who.tolist(), col.tolist(), s.tolist(), strict=True) if c >= need[a]}
    assert got == {(a, b, int(exact[a, b])) for a in range(40) for b in range(500) if exact[a, b] >= need[a]}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, None, 1), (100, [nan, 1.0], 1), (150, [inf, 1.0], 1), (200, [None, 1.0], 1), (250, [1.0, 1.0], None), (300, [], 2), (1, [1.0], 1), (2, [1.0, 2.5], 1), (3, [1.0, 1.0], 2), (4, [1.0, 1.2], 3), (5, [1.0, 1.2], 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, anchor int")
    found = columns(hn.hard_negatives(df))
    assert found == plain(rows) and len(found) > len(set(found))  # two rows of id 0 are two anchors
    assert hn.hard_negatives(df.where("false")).collect() == []
