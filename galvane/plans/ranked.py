"""Ranks, percentiles and the isotonic fit over ranges of scores, so that no task holds a group.

Equal scores are one row first. Ranges of scores are sorted by themselves, and what the ranges below hold is
added (operators.ranks); the fit merges hulls of ranges (operators.hulls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.operators import hulls
from galvane.operators.ranks import running
from galvane.plans.catalog import query
from galvane.plans.relational import for_duckdb
from galvane.sources import views

AUC_SQL = for_duckdb("""WITH g AS (SELECT lead, p, count(*) AS n, sum(y) AS pos FROM {v_pred} GROUP BY lead, p),
r AS (SELECT lead, pos, sum(n) OVER (PARTITION BY lead ORDER BY p) - n + (n + 1) / 2.0D AS rank, n FROM g)
SELECT lead, round((sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0D) / nullif(CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0), 6) AS auc FROM r GROUP BY lead""")


def auc(samples: DataFrame, key: str) -> DataFrame:
    """key, auc: the rank sum of samples (key, p, y) with y = 1, ties at their mean rank; null without both outcomes."""
    by = samples.groupBy(key, "p").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    pos, n = F.sum("pos"), F.sum("n")
    area = (F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2.0) / F.nullif(pos.cast("double") * (n - pos), F.lit(0.0))
    return running(by, [key], [F.col("p")], {"upto": F.col("n")}).groupBy(key).agg(F.round(area, 6).alias("auc"))


@query("roc_auc", AUC_SQL)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc(views.v_pred(spark, sf_dir), "lead")


#: Names and shares of the percentiles of a climate of values.
SHARES = {"background": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99}
PERCENTILES_SQL = for_duckdb(f"""SELECT modality, {", ".join(f"round(percentile_cont({q}) WITHIN GROUP (ORDER BY value), 6) AS {name}" for name, q in SHARES.items())}, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM {{v_obs}} GROUP BY modality""")


def percentiles_of(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key, each share's percentile (interpolated between neighbours), mean and top of value; nulls are not counted."""
    by = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = by.groupBy(key).agg(F.sum("n").alias("all"), F.max("v").alias("top"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    placed = running(by, [key], [F.col("v")], {"upto": F.col("n")}).join(total, key)
    at = {name: q * (F.col("all") - 1) for name, q in shares.items()}
    near = [F.min(F.when(F.col("upto") > F.floor(x) + k, F.col("v"))).alias(f"{name}_{k}") for name, x in at.items() for k in (0, 1)]
    found = placed.groupBy(key, "all", "top", "mean").agg(*near)
    between = [F.round(F.col(f"{n}_0") + (F.coalesce(f"{n}_1", f"{n}_0") - F.col(f"{n}_0")) * (x - F.floor(x)), 6).alias(n) for n, x in at.items()]
    return found.select(key, *between, F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


def percentile_sketches(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """The same percentiles from a mergeable quantile sketch in one pass: off by at most 1 / accuracy of the rows in rank."""
    return rows.groupBy(*keys).agg(F.percentile_approx(value, list(shares.values()), accuracy).alias("q")).select(*keys, *[F.col("q")[k].alias(n) for k, n in enumerate(shares)])


@query("percentiles", PERCENTILES_SQL)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles_of(views.v_obs(spark, sf_dir), "modality", "value", SHARES)


def isotonic_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots of each lead."""
    by = views.v_pred(spark, sf_dir).groupBy("lead", "p", "y").agg(F.count("*").alias("n"))
    return hulls.isotonic(by, "lead").withColumn("value", F.round("value", 6))
