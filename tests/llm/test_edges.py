"""Nulls in any column, repeated rows, very long texts, empty tables and extra columns with clashing names."""

import pytest

import corpus_pipeline
from galvane.llm import chat, decontaminate, jaccard, metric_search, packing, personal, quality, repeats, secrets, suffix_dedup

EXTRA = ["n", "u", "v", "a", "b", "node", "root", "gram", "kept", "spans", "bucket", "marks", "item_id", "score", "rank", "piece", "k", "h"]
LONG = "alpha beta gamma delta epsilon zeta " * 20000
BODY = "plain words that stand for a common text of the house and the road and the sea and the hill and more besides"
ROWS = [(1, BODY), (1, BODY), (2, BODY), (None, BODY), (None, None), (3, None), (4, ""), (5, LONG), (6, LONG), (7, "password = hunter2hunter2 a@b.example")]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, None, None, None, *["x"] * len(EXTRA)) for i, t in ROWS], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "words of no document at all here"), (None, None), (2, "")], "item_id bigint, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_secrets(odd):
    got = secrets.digest(odd).collect()
    assert len(got) == len(ROWS) and [r["n_assign"] for r in got if r["doc_id"] == 7] == [1]
    assert secrets.redact_secrets(odd).columns == odd.columns


def test_jaccard(odd):
    got = by_id(jaccard.near_duplicates(odd))
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[6]["component_id"] == 5
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_repeats(odd):
    words, spans = by_id(repeats.drop_repeated_words(odd)), by_id(suffix_dedup.drop_repeated_bytes(odd))
    assert words[2]["n_removed"] == len(BODY.split()) and words[6]["kept"] == "" and words[3]["n_words"] == 0
    assert spans[2]["n_removed"] == len(BODY) and spans[6]["n_removed"] == len(LONG) and spans[4]["n_bytes"] == 0


def test_packing(odd):
    got = packing.pack(packing.pieces(odd, packing.tokenizer_path(), with_ids=False)).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert got[got.doc_id.isin([3, 4])].length.tolist() == [1, 1]


def test_quality(odd, labels):
    judged = quality.judged(odd, labels).collect()
    assert len(judged) == len(ROWS) and all(r["keep"] is not None for r in judged)
    assert quality.without_rejected(odd, labels).columns == odd.columns
    assert quality.judged(odd, labels.where("false")).count() == len(ROWS)


def test_decontaminate(odd, items):
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.decontaminated(odd, items).columns == odd.columns
    assert decontaminate.decontaminated(odd, items.where("false")).count() == len(ROWS)


def test_personal(odd):
    got = personal.digest(odd)
    assert got.count() == len(ROWS) and by_id(got)[7]["n_email"] == 1


def test_top_k(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (None, [1.0, 1.0], "x"), (20, [], "x"), (21, [3.0, None], "x")], "vec_id bigint, embedding array<double>, score string")
    assert [r["vec_id"] for r in metric_search.top_k(v, "vec_id % 20 = 0").where("query_id = 20").collect()].count(0) == 2


def test_chat(spark):
    c = spark.createDataFrame([(None, None, None, None, "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (1, None, "assistant", LONG, "x")], "conv_id bigint, turn bigint, role string, text string, branch string")
    got = {r["conv_id"]: r for r in chat.digest(c).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len(LONG)
    assert chat.digest(c.where("false")).count() == 0


def test_pipeline(spark, odd, labels, items, tmp_path):
    for name, df in (("documents", odd.select("doc_id", "text", "lang", "source", "n_chars")), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.columns, stage(spark, kept, str(tmp_path))
        assert kept.columns == before
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in last}
    assert {3, 4} <= ids and 2 not in ids


@pytest.mark.parametrize("doc", [None, 70])
def test_verdicts_go_by_row(spark, doc):
    good, item = "the cat sat on the mat and the dog ran to the red house ", "the quick brown fox jumps over the lazy dog while seven wizards mix a potion"
    bad = "#$%^ &*!! @@ ~~ || {}{} <>" * 20
    d = spark.createDataFrame([(i, good * 5, "en") for i in range(20)] + [(doc, bad, "en"), (doc, good * 5, "en")], "doc_id bigint, text string, lang string")
    l = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id bigint, quality int, toxic int")
    assert [r["text"] for r in quality.without_rejected(d, l).collect() if r["doc_id"] == doc] == [good * 5]
    d = spark.createDataFrame([(doc, f"so {item} it is"), (doc, good)], "doc_id bigint, text string")
    assert [r["text"] for r in decontaminate.decontaminated(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()] == [good]


def test_copies_go_by_row(spark):
    other = "another text that no row but two has, of thirteen words or so"
    d = spark.createDataFrame([(1, BODY), (8, BODY), (8, other), (9, other)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.one_of_each(d).collect())) == [(1, BODY), (8, other)]


def test_chat_without_conversation(spark):
    c = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "an answer"), (1, 0, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digest(c).collect()}
    assert got == {None: (2, 9), 1: (1, 0)}


def test_chat_ring(spark):
    ring = [(1, 1, 3, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0), (1, 4, 2, 0.0), (1, 5, 4, 0.0), (1, 6, None, 0.0), (1, 7, 6, 0.0), (1, 8, 7, 0.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0), (None, 1, None, 0.0), (None, 2, 1, 0.0)]
    got = chat.branches(spark.createDataFrame(ring, "conv_id bigint, node bigint, parent bigint, score double")).collect()
    assert sorted(((r["conv_id"] or 0, r["leaf"], r["step"], r["node"]) for r in got)) == [(0, 2, 0, 2), (0, 2, 1, 1), (1, 8, 0, 8), (1, 8, 1, 7), (1, 8, 2, 6)]


@pytest.mark.parametrize("name", ["db_pwd", "passphrase", "private_key", "credential", "auth", "n" * 200 + "_pwd"])
def test_secrets_far_from_their_names(name):
    value, gap = "Zx81kQ0pLm-7uTw/93hGv+Ne", " " * 300
    for text in (f'{name}{gap}={gap}"{value}"', f'part{gap}={gap}"{value}"\n{name}{gap}={gap}part', f'{name} = "pre" +\n    "{value}"', f'{name} = "pre"\n    + "{value}"', f'{name} = "pre" + \\\n "{value}"'):
        assert value not in secrets.redacted(text)


def test_secrets_of_many_literals():
    values = [f"Zx{i}kQ{i * i}" for i in range(200)]
    for text in ("secret_key = " + " + ".join(f'"{v}"' for v in values), "\n".join(f'c{i} = "{v}"' for i, v in enumerate(values)) + "\nall = " + " + ".join(f"c{i}" for i in range(200)) + "\nsecret_key = all"):
        assert not [v for v in values if f'"{v}"' in secrets.redacted(text)]
    doubled = 'a0 = "Zx81kQ0pLm"\n' + "\n".join(f"a{i + 1} = a{i} + a{i}" for i in range(3000)) + '\nsecret_key = a3000 + "q!"'
    assert "Zx81kQ0pLm" not in secrets.redacted(doubled)
    for value in ("x" * 100, "<" + "aB3-" * 30 + ">", "example" + "aB3-" * 30, "x" * 70 + "aB3", "Zx81kQ0pLm", "hunter2"):
        whole = secrets.Shape(value[:3])
        whole += secrets.Shape(value[3:])
        assert bool(secrets.PLACEHOLDER.match(value)) == bool(secrets.PLACEHOLDER.match(whole.sample()))


def test_pipeline_carries_ids(spark, odd):
    last = corpus_pipeline.packing_stage(spark, odd, "").collect()
    encode = packing.encoder(packing.tokenizer_path())
    want = sorted(x for _, t in ROWS for x in [*encode(t or ""), 2])
    assert sorted(x for r in last for x in r["ids"]) == want and all(len(r["ids"]) == r["length"] for r in last)
    mine = sorted((r["piece"], r["ids"]) for r in last if r["doc_id"] == 5)
    assert [x for _, ids in mine for x in ids] == [*encode(LONG), 2]
