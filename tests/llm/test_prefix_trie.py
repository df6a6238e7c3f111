"""The prefix trie against a plain one; edges."""

import hashlib
import random
import zlib

import pytest

from galvane.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, borrow=True):
    """Nodes of rows (conv_id, turn, role, text) by dictionaries, as the contract says."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if borrow:
        head = lambda c: zlib.crc32(str(c).encode()) % 9
        convs = {c: convs.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[: head(c)] + v[head(c) :] for c, v in convs.items()}
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        kids = sum(len(k) == len(key) + 1 for k in under)
        out[min(members), len(key)] = (min(nodes[key[:-1]]) if key else None, len(members), kids, sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(1))
def test_as_plain(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 60), 40):
        n = rnd.choice([1, 2, 5, 9, 30])
        for t in range(n):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]) if rnd.random() < 0.2 else ("user", "assistant")[t % 2], rnd.choice(["hé", "hé", "so", "", None])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.shared_beginnings(df)) == plain(rows)
    assert got(prefix_trie.plain_trie(df)) == plain(rows, borrow=False)


def test_long_chain_and_wide_node(spark, many_ranges):
    """One conversation of 300 turns, copies of its first 150, and a root with many leaves."""
    rows = [(0, t, "user", f"t{t}") for t in range(300)] + [(k, t, "user", f"t{t}") for k in (7, 9) for t in range(150)] + [(100 + k, 0, "user", f"leaf {k}") for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = got(prefix_trie.plain_trie(df))
    assert found == plain(rows, borrow=False)
    assert found[0, 0][3] == 201 and found[0, 150][1] == 3


def test_edges(spark):
    rows = [(None, 0, "user", "nobody"), (1, None, None, None), (1, None, None, None), (1, 0, "user", "x" * 100000), (10, 3, "user", "a"), (10, 3, "user", "a"), (4, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA + ", node string, digest string, at int")
    assert got(prefix_trie.shared_beginnings(df)) == plain(rows)
    assert got(prefix_trie.plain_trie(df)) == plain(rows, borrow=False)
    assert prefix_trie.shared_beginnings(df.where("false")).collect() == []


def test_totals_of_any_forest(spark):
    """Rake and compress on random trees: chains, stars and mixtures, against sums over descendants."""
    rnd = random.Random(5)
    up, depth = {}, {}
    for v in range(300):
        u = None if v in (0, 100) else v - 1 if rnd.random() < 0.7 else rnd.randrange(max(0, v - 100) if v < 100 else 100, v) if v != 100 else None
        up[v], depth[v] = u, 0 if u is None else depth[u] + 1
    total = dict.fromkeys(up, 0)
    for v in up:
        u = v
        while u is not None:
            total[u] += v
            u = up[u]
    df = spark.createDataFrame([(v, up[v], depth[v], v) for v in up], "node bigint, up bigint, depth bigint, w bigint")
    assert {r["node"]: r["w"] for r in prefix_trie.subtree_totals(df, ["w"]).collect()} == total
