"""Personal data: weak-supervision aggregation, in DataFrame functions alone.

Candidate spans of each kind come from patterns. Labelers (regular expression, gazetteer, context,
edges) vote yes, no or nothing on each. How often each pattern of votes occurs, a table whose size
is bounded by kinds and labelers, goes into expectation-maximisation: it estimates each labeler's
reliability and each pattern's probability of being personal. Those train the span classifier, a
sum of weights for votes and length. A candidate's context is what stands before it, up to the candidate of its kind before and 40 characters. Base spans stay whatever it says; others need its yes.

Defined results: a null or empty text has no spans; rows repeat as they are; a null doc_id is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from galvane.llm.common import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "id_number", "name")
LABELERS = ("regex", "gazetteer", "context", "edges")

# Patterns: possessive where the next item can't be part of the run, and started only where a run
# starts, so that matching stays linear; they find what the plain patterns find.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+() .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra?|Mme)\.? [A-Z][a-z]++ [A-Z][a-z]++",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|255)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9][0-9]{2}",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "name": r"(?:John|Mary|James|Anna|Peter|Maria|Paul|Hans|Jean|Luis|Carlos|Marie|Thomas|Michael|Sarah) ",
}
CUES = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|ip|host|address|card|visa|iban|account|ssn|social|passport|name|signed)\b[^\n]{0,12}$"
ANTICUES = r"(?i)\b(?:version|ver|v|order|sku|isbn|item|page|figure|section|total)[ .:#]{0,3}$"


PLACES = "array<struct<start:bigint,value:string,before:string,after:string>>"


def held(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(pairs: Column) -> Column:
    """array of (start, value, before, after) from (m: a match, p and a: what stands between it and the matches around it), in code points from 0.

    Sums run within blocks of about the square root of the number of matches, from each block's own start, so
    that no long array is copied for every match.
    """

    def size(x: Column) -> Column:
        return (F.length(x["p"]) + F.length(x["m"])).cast("long")

    def of_block(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast(PLACES).alias("out")),
            lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["p"])).alias("start"), x["m"].alias("value"), F.substring(x["p"], -40, 40).alias("before"), F.substring(x["a"], 1, 1).alias("after")))).alias("out")),
            lambda acc: acc["out"],
        )

    def all_blocks(blocks: Column) -> Column:
        zero = F.lit(0).cast("long")
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, x: acc + size(x)))
        starts = F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, of_block))

    def in_blocks(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: F.slice(xs, k * width + 1, width))
        return F.when(F.size(xs) == 0, F.array().cast(PLACES)).otherwise(held(blocks, all_blocks))

    return held(pairs, in_blocks)


def matches(text: Column, kind: str) -> Column:
    """array of (start, value, before, after) of the pattern's matches: code points from 0, up to 40 characters since the match before, and the next one."""

    def with_gaps(found: Column) -> Column:
        return held(F.split(text, PATTERNS[kind], -1), lambda gaps: F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("p"), F.slice(gaps, F.lit(2), F.size(found)).alias("a")))

    pairs = held(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), with_gaps)
    worth = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]") if kind != "name" else text.contains(" ")
    return F.when(worth, placed(pairs)).otherwise(F.array().cast(PLACES))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does the string of digits pass the check sum?"""
    turned = F.reverse(number)

    def weight(i: Column) -> Column:
        d = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda acc, i: acc + weight(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base rule of a kind; for others, their pattern alone."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 yes, 0 no, -1 nothing."""
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, 0)).otherwise(-1).cast("int")


def candidates(text: Column) -> Column:
    """All candidate spans with their votes; those that fail a base kind's rule are dropped."""
    parts = []
    for kind in KINDS:
        rows = matches(text, kind)
        if kind in ("ip", "card", "phone"):
            rows = F.filter(rows, lambda x: valid(kind, x["value"]))  # noqa: B023

        def span(x: Column) -> Column:
            value, size = x["value"], F.length(x["value"])
            before, after = x["before"], x["after"]
            inside = F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_/]") | after.rlike(r"[\p{L}\p{N}_/]")
            strict = {"email": value.rlike(r"^[A-Za-z0-9][^@]*@[^.@]+\..*[A-Za-z]{2,}$"), "name": size > 8}.get(kind, F.length(digits(value)) > 3)
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + size).alias("end"), F.lit(kind in BASE).alias("base"),
                vote(strict, ~strict).alias("regex"), vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
                vote(before.rlike(CUES), before.rlike(ANTICUES)).alias("context"), vote(~inside, inside).alias("edges"),
                F.least((size / 8).cast("int"), F.lit(4)).alias("size"),
            )

        parts.append(F.transform(rows, span))
    return F.concat(*parts)


def estimate(patterns: list[dict], rounds: int = 25) -> tuple[dict[str, dict[tuple[int, int], float]], list[float]]:
    """Expectation-maximisation over patterns of votes with their counts.

    Returns P(vote | is it personal?) of each labeler, and each pattern's probability of yes.
    """
    yes = [0.5 + 0.12 * sum({1: 1, 0: -1}.get(p[l], 0) for l in LABELERS) for p in patterns]
    yes = [min(0.98, max(0.02, x)) for x in yes]
    table: dict[str, dict[tuple[int, int], float]] = {}
    for _ in range(rounds):
        total = sum(p["n"] for p in patterns) or 1
        prior = min(0.99, max(0.01, sum(p["n"] * y for p, y in zip(patterns, yes, strict=True)) / total))
        for name in LABELERS:
            for c in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                weight[c] += 2.0  # labelers are taken to be better than chance
                for p, y in zip(patterns, yes, strict=True):
                    weight[p[name]] += p["n"] * (y if c else 1 - y)
                whole = sum(weight.values())
                for v, w in weight.items():
                    table.setdefault(name, {})[v, c] = w / whole
        for i, p in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[l][p[l], 1] / table[l][p[l], 0]) for l in LABELERS)
            yes[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return table, yes


def train(patterns: list[dict]) -> dict[str, dict[tuple[str, int], float]]:
    """Weights of the span classifier by feature and (kind or '', value): naive Bayes on EM's answers."""
    _, yes = estimate(patterns)
    weights: dict[str, dict[tuple[str, int], float]] = {}
    for feature in (*LABELERS, "size"):
        sums: dict[tuple[str, int], list[float]] = {}
        whole = [1.0, 1.0]
        for p, y in zip(patterns, yes, strict=True):
            cell = sums.setdefault((p["kind"] if feature == "size" else "", p[feature]), [0.5, 0.5])
            for c, share in ((0, 1 - y), (1, y)):
                cell[c] += p["n"] * share
                whole[c] += p["n"] * share
        weights[feature] = {k: math.log(b / whole[1]) - math.log(a / whole[0]) for k, (a, b) in sums.items()}
    total = sum(p["n"] for p in patterns)
    good = sum(p["n"] * y for p, y in zip(patterns, yes, strict=True))
    weights["prior"] = {("", 0): math.log((good + 1) / (total - good + 1))}
    return weights


def score(x: Column, weights: dict[str, dict[tuple[str, int], float]]) -> Column:
    out = F.lit(weights["prior"]["", 0])
    for feature in (*LABELERS, "size"):
        term = F.lit(0.0)
        for (kind, value), w in sorted(weights[feature].items()):
            hit = x[feature] == value
            term = F.when(hit & (x["kind"] == kind) if kind else hit, F.lit(w)).otherwise(term)
        out = out + term
    return out


def found(docs: DataFrame) -> DataFrame:
    """doc_id, spans: base spans, and others that the classifier takes; each with kind, start, end, base, score."""
    text = F.coalesce("text", F.lit(""))
    table = written(docs.select(F.col("doc_id").cast("long"), candidates(text).alias("spans")), "candidates")
    names = ("kind", *LABELERS, "size")
    counts = table.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in names]).agg(F.count("*").alias("n"))
    patterns = sorted((r.asDict() for r in counts.collect()), key=lambda p: [str(p[c]) for c in names])  # kinds x votes x sizes rows at most
    weights = train(patterns)
    scored = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), score(x, weights).alias("score")))
    base = F.filter(scored, lambda x: x["base"])
    extra = F.filter(scored, lambda x: ~x["base"] & (x["score"] > 0))
    apart = F.filter(extra, lambda x: ~F.exists("base_spans", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    out = table.withColumn("base_spans", base).withColumn("more", apart)
    return out.select("doc_id", F.array_sort(F.concat("base_spans", "more")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["base"])
    return found(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
