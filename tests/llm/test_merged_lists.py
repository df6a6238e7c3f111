"""Inverted lists that overlap much are examined as one, and the links stay those of a plain comparison."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from galvane.llm import jaccard


def plain(docs):
    """The least document that each reaches by links."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_one_passage_in_many_documents(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n: [str(rng.randrange(10**7)) for _ in range(n)]
    passage = some(50)
    docs = [(i, " ".join([*some(20 + i % 30), *passage, *some(20)])) for i in range(30)]
    for i in range(30, 60):  # near copies, and copies of them, so that some chains go on
        words = docs[i // 3][1].split()
        words[rng.randrange(len(words))] = "new"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "FREQUENT", 0)  # no shingle is known as frequent
    seen, kept = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, tag: (seen.append(kept(df, tag)), seen[-1])[1] if tag == "members" else kept(df, tag))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(d).collect()}
    assert got == plain(docs) and len(set(got.values())) < 40
    assert 0 < sum(x.count() for x in seen) <= 4 * len(docs)  # not once for each shingle of the passage


def test_no_pair_of_a_list_is_lost():
    rng = np.random.default_rng(3)
    lists = [np.stack([x, x % 7 + 20], 1) for x in (np.sort(rng.choice(40, rng.integers(3, 30), replace=False)) for _ in range(60))]
    pairs = lambda each: {frozenset(p) for m in each for p in combinations(m[:, 0].tolist(), 2)}
    got = jaccard.overlapping(lists)
    assert pairs(lists) <= pairs(got) and len(got) < len(lists)
    assert all(len(set(m[:, 0].tolist())) == len(m) for m in got)


def test_only_lists_with_open_pairs_go_on(spark):
    """Three sets of one sketch have three plausible pairs, two of which the first round may name; two sets have one."""
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 100).astype(np.uint64)
    lists = spark.createDataFrame([(7, np.array([[1, 100], [2, 100], [3, 100]]).tobytes()), (8, np.array([[4, 100], [5, 100]]).tobytes())], "list bigint, members binary")
    sketches = spark.createDataFrame([(i, 100, jaccard.sketch(s).tobytes()) for i in range(1, 6)], "node bigint, n bigint, sketch binary")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    first = jaccard.across(lists, roots, sketches, True).collect()
    assert [r["more"] for r in first if r["more"] is not None] == [7]
    every = jaccard.across(lists.where(F.col("list") == 7), roots, sketches, False).collect()
    assert {(r["a"], r["b"]) for r in every if r["more"] is None} == {(1, 2), (1, 3), (2, 3)}
