"""Each operator against a brute-force version on a small table with nulls, empty texts, copies and ties."""

import hashlib
import random
import re

import numpy as np
import pytest

from galvane.llm import chat, decontaminate, jaccard, metric_search, packing, personal, quality, repeats, secrets, suffix_dedup
from galvane.llm.suffixes import suffix_order

DOCS = "doc_id bigint, text string, lang string, marks string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "   "), (5, passage)]
    for i in range(6, 40):
        own = [word() for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(own) + ("\n" + passage if i % 3 == 0 else "")))
    rows += [(40 + i, rows[6 + i][1]) for i in range(5)]
    base = rows[10][1].split() + [word() for _ in range(100)]
    for i in range(45, 55):
        mine = list(base)
        mine[rng.randrange(len(mine))] = "edit"
        rows.append((i, " ".join(mine)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "x") for i, t in texts], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_jaccard_join(docs, texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert rows(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == sorted((i, len(sets[i]), root[i]) for i in sets)


def test_repeated_words(docs, texts):
    w = {i: re.findall(r"[^ \t-\r]+", t or "") for i, t in texts}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - 12):
            first.setdefault(tuple(w[i][k : k + 13]), i)
    want = []
    for i in w:
        gone = {p for k in range(len(w[i]) - 12) if first[tuple(w[i][k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w[i]), len(gone), " ".join(x for p, x in enumerate(w[i]) if p not in gone)))
    assert rows(repeats.drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(want)


def test_repeated_bytes(docs, texts):
    raw = {i: (t or "").encode() for i, t in texts}
    seen, want = set(), []
    for i in sorted(raw):
        gone = set()
        for k in range(len(raw[i]) - 99):
            s = raw[i][k : k + 100]
            if s in seen:
                gone |= set(range(k, k + 100))
            seen.add(s)
        want.append((i, len(raw[i]), len(gone), bytes(c for p, c in enumerate(raw[i]) if p not in gone)))
    got = [(a, b, c, bytes(d)) for a, b, c, d in rows(suffix_dedup.drop_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "kept")]
    assert got == sorted(want)


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(150):
        s = bytes(rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 50)))
        order, common = suffix_order(np.frombuffer(s, np.uint8), 8, budget=16)
        tails = [s[i:] for i in order]
        assert sorted(order) == list(range(len(s))) and all(a[:8] <= b[:8] for a, b in zip(tails, tails[1:]))
        for a, b, c in zip(tails, tails[1:], common[1:]):
            assert c == next((k for k in range(8) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 8)


def test_secrets():
    text = 'key_part = "Zx81kQ0pLm"\napi_key = key_part + "99aaQQ"\npassword: hunter2hunter2\ntoken = abc\nAKIAABCDEFGHIJKL'
    base, spans = secrets.scan(text)
    assert [k for k, _, _ in base] == ["assign", "access"] or [k for k, _, _ in base] == ["assign", "assign", "access"]
    assert set(base) <= set(spans)
    assert ("lex", text.index("Zx81"), text.index("Zx81") + 10) in spans
    assert "hunter2" not in secrets.redacted(text) and secrets.scan("plain words: of no import")[1] == []


def test_packing(docs, texts, none):
    got = packing.pack(packing.pieces(docs, packing.tokenizer_path(), limit=64), limit=64).toPandas()
    assert sorted(set(got.doc_id)) == sorted(i for i, _ in texts)
    for _, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.length.sum() <= 64 and list(part.offset) == [0, *np.cumsum(part.length)[:-1]]
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 64 + 1
    for i, t in texts:
        ids = [x for part in got[got.doc_id == i].sort_values("piece").ids for x in part]
        assert ids == [*packing.encoder(packing.tokenizer_path())(t or ""), 2]
    assert packing.pack(packing.pieces(none, packing.tokenizer_path())).count() == 0


def test_decontaminate(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion"
    d = spark.createDataFrame([(1, f"Intro. {item.upper()}! end"), (2, "nothing of it"), (3, item.replace("lazy", "lasy")), (4, None), (5, "")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    assert rows(decontaminate.contaminated(d, b), "doc_id", "item_id", "edits") == [(1, 7, 0), (3, 7, 1)]
    assert rows(decontaminate.contaminated(d, b, block_bytes=16), "doc_id", "item_id", "edits") == [(1, 7, 0), (3, 7, 1)]
    assert rows(decontaminate.decontaminated(d, b), "doc_id") == [(2,), (4,), (5,)]
    assert decontaminate.myers("abcd", "xxabdxx", 2) == 1


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(30)]
    v += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    whole = {i: np.floor(64 * np.array(x)).astype(int) for i, x in v[:230]}
    want = []
    for q in (x for x in whole if x % 20 == 0):
        s = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:20]
        want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(s)]
    assert rows(metric_search.top_k(df, "vec_id % 20 = 0"), "query_id", "rank", "vec_id", "score") == sorted(want)


def test_quality(spark):
    good = "the cat sat on the mat and the dog ran to the red house "
    d = spark.createDataFrame([(i, good * 5, "en") for i in range(20)] + [(50, "#$%^ &*!! @@ ~~ || {}{} <>" * 20, "en"), (51, None, None), (52, good * 4, "de")], "doc_id bigint, text string, lang string")
    l = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id bigint, quality int, toxic int")
    assert [r[0] for r in rows(quality.judged(d, l).where("not keep"), "doc_id")] == [50]
    costs = quality.model_costs(spark.createDataFrame([(0x6161616161 + i, n) for i, n in enumerate((5, 2, 1, 1, 0))], "gram bigint, n bigint")).collect()
    assert len(costs) == 5 and all(r["cost"] > 0 for r in costs)


def test_chat_round_trip(spark):
    rows_ = [(1, 0, "user", "a < b &amp; </turn>\n"), (1, 1, "assistant", '<turn role="user">x'), (2, 0, 'r"<', None), (2, 0, 'r"<', None)]
    c = spark.createDataFrame(rows_, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.chains(c))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(a, b) for _, _, a, b in rows_[:2]] and got[1]["learnt"] == rows_[1][3]
    assert [tuple(t) for t in got[2]["turns"]] == [('r"<', "")] * 2
    tree = spark.createDataFrame([(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"), (1, 4, 2, 9.0, "user", "c")], "conv_id bigint, node bigint, parent bigint, score double, role string, text string")
    assert rows(chat.branches(tree.select("conv_id", "node", "parent", "score")), "branch", "leaf", "node") == [(1, 4, 1), (1, 4, 2), (1, 4, 4), (2, 3, 1), (2, 3, 3)]


def test_personal(spark):
    t = "mail a.b@c.example.com, host 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111, +1 (555) 555-0100 é x@y.z%w@q.r"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in personal.digest(d).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (3, 1, 1, 1)
    assert got[2]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_tables(none, spark):
    assert secrets.digest(none).count() == 0 and personal.digest(none).count() == 0
    assert repeats.drop_repeated_words(none).count() == 0 and suffix_dedup.drop_repeated_bytes(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert metric_search.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), "vec_id % 20 = 0").count() == 0


def test_quality_held_out(spark):
    """The limit promises a share of clean texts: strange clean ones pass it, and texts somewhat unlike them do not."""
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(stock) for _ in range(60))
    other = lambda: " ".join(w[::-1] if rng.random() < 0.15 else w for w in text().split())
    made = [(i, text(), "en") for i in range(400)] + [(1000 + i, text(), "en") for i in range(200)] + [(2000 + i, other(), "en") for i in range(200)]
    d = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    l = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    gone = [r["doc_id"] for r in quality.judged(d, l).where("not keep").collect()]
    assert sum(1000 <= i < 2000 for i in gone) <= 16 and sum(i >= 2000 for i in gone) >= 150
