"""Operators and pipeline stages without SQL, each against a plain version of its contract."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from galvane.llm import common, decontaminate, jaccard, metric_search, packing, personal, quality, repeats, secrets, suffix_dedup


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32))):
        found += [(m.start(), k + 1, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x for _, _, x in sorted(found))


BITS = st.sampled_from(["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "0f" * 9, "hunter2hunter2", "é", "\n", "+", "x", "kſ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(BITS, max_size=30).map("".join))
def test_secret_base_spans(text):
    base, spans = secrets.scan(text)
    assert secrets.joined(base) == plain_secrets(text) and set(base) <= set(spans)
    hidden = secrets.redacted(text)
    assert all(text[a:b] not in hidden for _, a, b in base if b - a > 20 and text.count(text[a:b]) == 1)


def test_secret_partly_in_a_base_span():
    text = 'x password = "hunter22!verySecret99" y'
    assert secrets.redacted(text) == 'x [SECRET]" y' and len(secrets.scan(text)[1]) == 2


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def plain_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(x for _, _, x in sorted(found))


def test_personal_of_many_matches(spark):
    """A text of 100,000 numbers, and one of 3,000 cards: places by blocks are the plain ones."""
    texts = ["\n".join(str(1000000 + i) for i in range(100000)), "\n".join(("4111111111111111", "é 4111111111111112")[i % 5 == 0] for i in range(3000))]
    got = {r["doc_id"]: r for r in personal.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0]["spans"] == "" and got[1]["n_card"] == 2400
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(plain_personal(t).encode()).hexdigest()


def test_personal_base_spans(spark):
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "x-y.z", " ", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+49", "12", "-", ".", "é", "\n", "Dr. Anna Smith ", "0025", "(", ")", "123-45-6789"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in personal.digest(df).collect()}
    for i, t in enumerate(texts):
        want = plain_personal(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(",")) and got[i]["n_spans"] == len(list(filter(None, got[i]["spans"].split(","))))


def distance_in(item, text):
    """The least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for k, d in enumerate(text):
            new.append(min(row[k] + (c != d), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def test_benchmark_items(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 5)))
    items = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(12)] + ["art"]
    texts = ["the party of hearts"]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(0, 20))]
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            item[rng.randrange(len(item))] = rng.choice("abcdz ")
        texts.append(" ".join([*own, "".join(item), *[word() for _ in range(3)]]))
    want = []
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            item = decontaminate.padded(item)
            edits = distance_in(item, decontaminate.padded(t))
            if edits <= int((len(item) - 2) * decontaminate.MAX_EDIT_RATE):
                want.append((i, k, edits))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")  # repeated rows
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for block_bytes in (1 << 20, 40):
        assert sorted(map(tuple, decontaminate.contaminated(d, b, block_bytes=block_bytes).collect())) == sorted(want * 2)
    kept = sorted(r["doc_id"] for r in decontaminate.decontaminated(d, b).collect())
    assert kept == sorted(2 * [i for i in range(len(texts)) if i not in {w[0] for w in want}])


def kneser_ney(counts, order):
    """-ln p of every gram, from counts of grams of `order` bytes, in plain dicts."""
    levels = {order: {g: c for g, c in counts.items() if c}}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    off = {}
    for n, level in levels.items():
        have = [sum(c == k for c in level.values()) for k in range(5)]
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + have[2] else 0.0
        off[n] = [min(max(k - (k + 1) * y * have[k + 1] / have[k], 0.1), k - 0.1) if have[k] else 0.1 for k in (1, 2, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        rest = [(h, c) for h, c in levels[n].items() if h[:-1] == g[:-1]]
        total = sum(c for _, c in rest)
        if not total:
            return p(g[1:])
        take = lambda c: off[n][min(c, 3) - 1] if c else 0.0
        c = levels[n].get(g, 0)
        return (c - take(c)) / total + sum(take(x) for _, x in rest) / total * p(g[1:])

    return {g: -math.log(p(g)) for g in counts}


def test_model_costs(spark):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(400))
    counts = Counter(text[i : i + quality.ORDER] for i in range(len(text) - quality.ORDER + 1))
    counts |= {bytes(rng.choice(b"abcd") for _ in range(quality.ORDER)): 0 for _ in range(50)} | dict(counts)
    rows = [(int.from_bytes(g, "big"), c) for g, c in counts.items()]
    got = {r["gram"]: r["cost"] for r in quality.model_costs(spark.createDataFrame(rows, "gram bigint, n bigint")).collect()}
    want = kneser_ney(counts, quality.ORDER)
    assert got == pytest.approx({int.from_bytes(g, "big"): c for g, c in want.items()}, rel=1e-9)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["don't", " I'LL", "  ", "\n\n", "\t", "é", "naïve", "123456", "!?", "<|", "endoftext|>", "ſt", "日本", "a" * 40]), max_size=25).map("".join))
def test_both_ways_to_ids(text):
    path = packing.tokenizer_path()
    assert packing.encoder(path, packing.ranks_path())(text) == packing.encoder(path)(text)


def plain_two_fit(lengths, limit):
    """Best-two-fit with a plain list: how many sequences."""
    left, n = sorted(lengths), 0
    while left:
        chosen, gap = [], limit
        while fit := [x for x in left if x <= gap]:
            chosen.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        least = chosen[-1]
        if gap and len(left) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap + least]
            if pairs:
                _, a, b = max(pairs)
                chosen.pop()
                left.remove(a)
                left.remove(b)
                left = sorted([*left, least])
        n += 1
    return n


def test_two_fit():
    rng = random.Random(6)
    for _ in range(60):
        limit = rng.choice([10, 30, 64])
        lengths = np.array([rng.randint(1, limit) for _ in range(rng.randint(1, 80))])
        bins, places = packing.two_fit(lengths, limit)
        for b in range(bins.max() + 1):
            order = np.argsort(places[bins == b])
            assert (places[bins == b][order] == np.concatenate([[0], np.cumsum(lengths[bins == b][order])[:-1]])).all()
        assert np.bincount(bins, lengths).max() <= limit
        assert abs(bins.max() + 1 - plain_two_fit(lengths.tolist(), limit)) <= 1


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_differ_everywhere(spark):
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, " ".join([x, y] * 7)), (2, " ".join([y, x] * 7)), (3, " ".join([y] * 14))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.drop_repeated_words(d).collect()}
    assert got == {1: 0, 2: 14, 3: 0}  # 1 and 2 share windows that start one word later
    assert {r["component_id"] for r in jaccard.near_duplicates(d).where("doc_id <> 2").collect()} == {1, 3}


def test_hot_passages(spark):
    """More documents than the sample asks for share passages: their hashes are salted."""
    rng = random.Random(2)
    own = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(20))
    hot = own()
    made = [(i, f"{own()} {hot} {own()}") for i in range(120)] + [(200 + i, hot) for i in range(30)]
    d = spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)
    assert all(len(h) for h in repeats.frequent(d, [repeats.word_windows(13, n) for n in (4, 8, 13)]))
    words = {r["doc_id"]: r["n_removed"] for r in repeats.drop_repeated_words(d).collect()}
    assert words == {i: 20 if i else 0 for i, _ in made}
    spans = {r["doc_id"]: r["n_spans"] for r in suffix_dedup.drop_repeated_bytes(d).collect()}
    assert spans == {i: 1 if i else 0 for i, _ in made}


def test_more_levels(spark):
    rng = random.Random(8)
    long_ = [str(rng.randrange(10**6)) for _ in range(60)]
    d = spark.createDataFrame([(1, " ".join(long_)), (2, " ".join(["x", *long_[5:45], "y"])), (3, " ".join(long_[5:30]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.drop_repeated_words(d, width=30, start=3).collect()}
    assert got == {1: 0, 2: 40, 3: 0}


def test_pruned_pivots(spark):
    """Far clusters: queries of one are sent to few pivots, and the answer is still exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 6)) * 20
    v = [(i, (centres[i % 6] + rng.normal(size=6) * 0.05).tolist()) for i in range(900)]
    whole = np.floor(64 * np.array([x for _, x in v])).astype(int)
    want = []
    for q in range(0, 900, 20):
        s = sorted((-int(whole[q] @ whole[c]), c) for c in range(900) if c != q)[:20]
        want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(s)]
    got = metric_search.top_k(spark.createDataFrame(v, "vec_id bigint, embedding array<double>"), "vec_id % 20 = 0")
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_stages(spark, tmp_path):
    """Each stage of the pipeline on a small corpus, against what the plain versions say of its own input."""
    rng = random.Random(12)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    item = text(12)
    rows = [(i, text(60), "en") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end", "en") for i in range(5)] + [(300, f"{text(30)} {item} {text(30)}", "en"), (301, text(40) + ' password = "Zx81kQ0pLm77" ' + text(20), "en"), (302, "#$%^ &*!! @@ ~~ || {}" * 30, "en"), (303, text(900), "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (*range(110), 301)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, inputs = common.read(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert 302 not in inputs["ngram_jaccard_join"] and len(inputs["ngram_jaccard_join"]) >= 115
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in inputs["ngram_jaccard_join"].items())}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert set(inputs["benchmark_decontamination"]) == {i for i, r in root.items() if i == r}
    leaks = {i for i, t in inputs["benchmark_decontamination"].items() if distance_in(decontaminate.padded(item), decontaminate.padded(t)) <= int(len(item) * decontaminate.MAX_EDIT_RATE)}
    assert 300 in leaks and set(inputs["secret_scan"]) == set(inputs["benchmark_decontamination"]) - leaks
    assert {i: secrets.redacted(t) for i, t in inputs["secret_scan"].items()} == inputs["best_fit_packing"] and "Zx81kQ0pLm77" not in inputs["best_fit_packing"][301]
    encode, ids = packing.encoder(packing.tokenizer_path()), defaultdict(list)
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
    assert ids == {i: [*encode(t), 2] for i, t in inputs["best_fit_packing"].items()}
    used = docs.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert used.max() <= 1024 and len(used) <= used.sum() // 1024 + 2


def test_work_path_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_path(Cluster, "x")
