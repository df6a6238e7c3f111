"""Quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams.

Trusted text is what labels call good and not toxic. Documents are packed by home, a hash of their
id; each home counts the 5-grams of its trusted texts and names those of all its texts. The counts
of all homes are summed by gram; counts of lower orders are numbers of distinct left neighbours;
joins by gram and by context give each gram's probability, and each home gets back its own grams.
Trusted documents are in two halves by a hash of their id. Each half makes a model, both in the same
joins. A trusted document is scored by the half that it is not in, all others by the mean of both,
so none is scored by a model that has seen it. A document's score is its mean negative log
probability. It is rejected if that is above a quantile of its language's trusted documents.

Defined results: texts under 5 bytes have no score and are kept; a null text is empty; short texts
are drawn to their language's mean as if they had PRIOR more grams of it; documents that labels
call good are kept; a half without trusted documents is a uniform model; a language without trusted documents takes the limit of all trusted ones; a
doc_id labelled more than once is good if all its labels say so.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galvane.llm.common import U64, buckets_for, chunks, column_bytes, inside, mix, row_key, without_rows, written

ORDER = 5
HOME_BYTES = 32 << 20
PRIOR = 60
QUANTILE = 0.98
SALTS = 64


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of ORDER bytes inside a text, as a number, and its place."""
    at = np.flatnonzero(inside(len(data), off, ORDER))
    g = np.zeros(len(at), np.int64)
    for i in range(ORDER):
        g = g << 8 | data[at + i]
    return g, at


def packed_homes(docs: DataFrame, homes: int) -> DataFrame:
    """home, data: batches of texts with their ids, languages and hashes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            home = batch.column(0).to_numpy()
            order = np.argsort(home, kind="stable")
            cut = np.flatnonzero(np.diff(home[order], prepend=-1))
            rows = []
            for i, a in enumerate(cut):
                part = batch.take(pa.array(order[a : cut[i + 1] if i + 1 < len(cut) else len(order)]))
                data, off = column_bytes(part.column(2))
                rows.append((int(home[order[a]]), squeeze(pickle.dumps((part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_numpy(), off, data.tobytes()), protocol=5))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "data"])

    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int").alias("home"), row_key()[0], "text", F.col("lang").cast("string"), row_key()[1])
    return rows.mapInArrow(run, "home int, data binary")


def unpacked_home(table: pa.Table) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for blob in table.column("data"):
        ids, langs, hashes, off, data = pickle.loads(open_(blob.as_py()))
        yield ids, langs, hashes, off, np.frombuffer(data, np.uint8)


def half_of(ids: list) -> np.ndarray:
    """0 or 1 for each document, by its id."""
    return (mix(np.array([i or 0 for i in ids], np.int64).view(U64)) >> U64(32) & U64(1)).astype(np.int64)


def home_counts(home, docs, labels):
    """gram, n0, n1: how often trusted texts of the home, by half, have each gram that any text of it has."""
    good = set(labels.column("doc_id").to_pylist())
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, *c = (np.concatenate(x) for x in zip(*parts, strict=True))
        kinds, number = np.unique(g, return_inverse=True)
        return kinds, *(np.bincount(number, x, len(kinds)).astype(np.int64) for x in c)

    for ids, _, _, off, data in unpacked_home(docs):
        trusted, half = np.array([i in good for i in ids], bool), half_of(ids)
        for a, _, part, poff in chunks(data, off):
            g, at = grams(part, poff)
            text = a + np.searchsorted(poff, at, "right") - 1
            ok = trusted[text]
            for h in (0, 1):
                kinds, n = np.unique(g[ok & (half[text] == h)], return_counts=True)
                parts.append((kinds, n * (h == 0), n * (h == 1)))
            rest = np.unique(g[~ok])
            parts.append((rest, *np.zeros((2, len(rest)), np.int64)))
        if len(parts) > 16:
            parts = [folded()]
    g, *c = folded() if parts else (np.zeros(0, np.int64), *np.zeros((2, 0), np.int64))
    key = home[0].as_py() if home[0] is not None else None
    return pa.table({"home": pa.array(np.full(len(g), key), pa.int32()), "gram": pa.array(g), "n0": pa.array(c[0]), "n1": pa.array(c[1])})


def home_scores(home, docs, answers):
    """doc_id, text_hash, lang, n of each document of the home, its cost by the half that it is not in, and the mean of both."""
    known = answers.column("gram").to_numpy()
    order = np.argsort(known)
    known, costs = known[order], np.stack([answers.column(f"cost{h}").to_numpy()[order] for h in (0, 1)])
    out = []
    for ids, langs, hashes, off, data in unpacked_home(docs):
        n, total = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)))
        for a, b, part, poff in chunks(data, off):
            g, at = grams(part, poff)
            if len(g):
                text = np.searchsorted(poff, at, "right") - 1
                n[a:b] = np.bincount(text, minlength=b - a)
                place = np.searchsorted(known, g)
                for h in (0, 1):
                    total[h, a:b] = np.bincount(text, costs[h, place], b - a)
        other = total[1 - half_of(ids), np.arange(len(ids))]
        out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "text_hash": pa.array(hashes, pa.int64()), "lang": pa.array(langs, pa.string()), "n": n, "other": other, "both": total.mean(axis=0)}))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.float64()), "both": pa.array([], pa.float64())})


def _mask(gram: Column | str, n: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * n) - 1)) if isinstance(gram, str) else gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def discounts(level: DataFrame, models: range) -> list[list[float]]:
    """For each model, what is taken off counts of 1, 2, and 3 or more: from how many grams of the level have counts 1 to 4."""
    found = level.agg(*[F.count_if(F.col(f"c{m}") == k) for m in models for k in (1, 2, 3, 4)]).first()
    out = []
    for m in models:
        n = [0, *found[4 * m : 4 * m + 4]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        out.append([min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) if n[k] else 0.1 for k in (1, 2, 3)])
    return out


def model_costs(counts: DataFrame, names: tuple[tuple[str, str], ...] = (("n", "cost"),)) -> DataFrame:
    """gram and costs: -ln of the interpolated probability of every gram in counts.

    names: for each model, its column in counts (next to gram) and that of its costs. Each order's
    counts are written once, since four later steps read them.
    """
    models = range(len(names))
    wanted = written(counts.groupBy("gram").agg(*[F.sum(names[m][0]).alias(f"c{m}") for m in models]), "order")
    levels = {ORDER: wanted.where(" or ".join(f"c{m} > 0" for m in models))}
    for n in range(ORDER - 1, 0, -1):  # numbers of distinct left neighbours
        levels[n] = written(levels[n + 1].groupBy(_mask("gram", n).alias("gram")).agg(*[F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}") for m in models]), "order")
    out = wanted.select("gram", *[F.lit(1 / 256).alias(f"p{m}") for m in models])
    for n in range(1, ORDER + 1):
        off = [F.when(F.col(f"c{m}") == 0, 0.0).when(F.col(f"c{m}") == 1, d[0]).when(F.col(f"c{m}") == 2, d[1]).otherwise(d[2]).alias(f"d{m}") for m, d in enumerate(discounts(levels[n], models))]
        level = levels[n].select("*", F.shiftright("gram", 8).alias("context"), *off)
        totals = [F.nullif(F.sum(f"c{m}"), F.lit(0)) for m in models]
        contexts = written(level.groupBy("context").agg(*[t.alias(f"total{m}") for m, t in enumerate(totals)], *[(F.sum(f"d{m}") / t).alias(f"rest{m}") for m, t in enumerate(totals)]), "contexts")
        seen = level.join(contexts.select("context", *[f"total{m}" for m in models]), "context").select(F.col("gram").alias("seen"), *[((F.col(f"c{m}") - F.col(f"d{m}")) / F.col(f"total{m}")).alias(f"own{m}") for m in models])
        key = F.shiftright(_mask("gram", n), 8)
        out = (
            out.join(seen, _mask("gram", n) == F.col("seen"), "left")
            .join(contexts.select(F.col("context").alias("before"), *[f"rest{m}" for m in models]), key == F.col("before"), "left")
            .select("gram", *[(F.coalesce(f"own{m}", F.lit(0.0)) + F.coalesce(f"rest{m}", F.lit(1.0)) * F.col(f"p{m}")).alias(f"p{m}") for m in models])
        )
    return out.select("gram", *[(-F.log(f"p{m}")).alias(names[m][1]) for m in models])


def trusted_ids(labels: DataFrame) -> DataFrame:
    by = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return by.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, n, and the costs other and both, of each document."""
    homes = buckets_for(docs, each=HOME_BYTES)
    packs = packed_homes(docs, homes)
    good = trusted_ids(labels).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int"))
    counts = packs.groupBy("home").cogroup(good.groupBy("home")).applyInArrow(home_counts, "home int, gram bigint, n0 bigint, n1 bigint")
    counts = written(counts, "grams")
    answers = counts.select("home", "gram").join(model_costs(counts, (("n0", "cost0"), ("n1", "cost1"))), "gram").select("home", "gram", F.col("cost0").cast("float").alias("cost0"), F.col("cost1").cast("float").alias("cost1"))
    return packs.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(home_scores, "doc_id bigint, text_hash bigint, lang string, n bigint, other double, both double")


def by_language(rows: DataFrame, each: DataFrame) -> DataFrame:
    """rows with the column that each has for their language (of), else null; a language's rows go to SALTS keys."""
    salted = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.coalesce("lang", F.lit("")) == F.col("of")) & (F.col("own") == F.col("salt")), "left").drop("of", "own", "salt")


def verdicts(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, text_hash, lang, perplexity (of a byte) and keep, for each document."""
    scores = written(scored(docs, labels), "scores")
    good = trusted_ids(labels).withColumn("good", F.lit(True))
    flagged = scores.join(good, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))).withColumn("cost", F.when(F.col("good"), F.col("other")).otherwise(F.col("both")))
    lang = F.coalesce("lang", F.lit(""))
    means = flagged.where("good and n > 0").groupBy(lang.alias("of")).agg((F.sum("cost") / F.sum("n")).alias("mean"))
    mean_all = flagged.where("good and n > 0").agg((F.sum("cost") / F.sum("n")).alias("m")).first()[0]
    if mean_all is None:  # nothing is trusted: there is no ground to reject
        return flagged.select("doc_id", "text_hash", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(True).alias("keep"))
    drawn = by_language(flagged, means).withColumn("mean", F.coalesce("mean", F.lit(mean_all)))
    drawn = drawn.withColumn("drawn", (F.col("cost") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR))
    accuracy = F.lit(10_000)
    limits = drawn.where("good and n > 0").groupBy(lang.alias("of")).agg(F.percentile_approx("drawn", F.lit(quantile), accuracy).alias("limit"))
    limit_all = drawn.where("good and n > 0").agg(F.percentile_approx("drawn", F.lit(quantile), accuracy)).first()[0]
    out = by_language(drawn, limits)
    keep = F.col("good") | (F.col("n") == 0) | (F.col("drawn") <= F.coalesce("limit", F.lit(limit_all)))
    return out.select("doc_id", "text_hash", "lang", F.exp(F.col("cost") / F.nullif("n", F.lit(0))).alias("perplexity"), keep.alias("keep"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity (of a byte) and keep, for each document."""
    return verdicts(docs, labels, quantile).drop("text_hash")


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that are kept: a rejected row goes, other rows of its doc_id, or without one, stay."""
    return without_rows(docs, verdicts(docs, labels).where("not keep"), "lang")
