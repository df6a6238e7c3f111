"""Every baseline's own forecast against the settled label of each storm cell, in one table and one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.plans import kinematics, nowcast, products, relational  # noqa: F401
from galvane.plans.catalog import QUERIES, SQL, query
from galvane.plans.relational import duck_words

KEYS = ["cycle", "i", "j"]
#: Baseline -> query, the column of its forecast, and which of its rows.
MODELS = {
    "lagrangian_advection": ("advected", "p", "true"),
    "uncalibrated_trees": ("tree_proxy", "p", "true"),
    "nwp_environmental_threshold": ("nwp_logistic", "p", "lead = 30"),
    "persistence": ("poisson_persistence", "p30", "true"),
    "text_bulletin": ("bulletin_baseline", "p", "lead = 30"),
}
SCORES = """c AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE p >= 0.35D AND y = 1) AS hits, count(*) FILTER (WHERE p < 0.35D AND y = 1) AS misses, count(*) FILTER (WHERE p >= 0.35D AND y = 0) AS false_alarms, avg(pow(p - y, 2)) AS brier, avg(y) * (1 - avg(y)) AS reference FROM m GROUP BY model)
SELECT model, n, hits, misses, false_alarms, round(hits / nullif(CAST(hits + misses AS DOUBLE), 0), 6) AS pod, round(false_alarms / nullif(CAST(hits + false_alarms AS DOUBLE), 0), 6) AS far,
  round(hits / nullif(CAST(hits + misses + false_alarms AS DOUBLE), 0), 6) AS csi, round(brier, 6) AS brier, round(1 - brier / nullif(reference, 0), 6) AS bss FROM c"""
_parts = [f"SELECT '{m}' AS model, l.y, q.p FROM labels l JOIN (SELECT cycle, i, j, {p} AS p FROM ({SQL[q]}) z WHERE {rows}) q ON q.cycle = l.cycle AND q.i = l.i AND q.j = l.j" for m, (q, p, rows) in MODELS.items()]
BASELINES_SQL = f"WITH labels AS ({SQL['flash_exists_label']}), m AS (SELECT 'climatology_persistence' AS model, y, (SELECT avg(y) FROM labels) AS p FROM labels UNION ALL {' UNION ALL '.join(_parts)}), {duck_words(SCORES)}"


@query("baseline_matrix", BASELINES_SQL)
def baseline_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' forecasts meet the labels by cell, then one pass scores them all; a cell that a model has no forecast for does not count for it."""
    labels = QUERIES["flash_exists_label"](spark, sf_dir)
    forecasts = None
    for model, (name, p, rows) in MODELS.items():
        own = QUERIES[name](spark, sf_dir).where(rows).select(*KEYS, F.lit(model).alias("model"), F.col(p).alias("p"))
        forecasts = own if forecasts is None else forecasts.unionByName(own)
    base = labels.agg(F.avg("y").alias("p"))
    scored = labels.join(forecasts, KEYS).select("model", "y", "p").unionByName(labels.join(F.broadcast(base)).select(F.lit("climatology_persistence").alias("model"), "y", "p"))
    return spark.sql(f"WITH m AS (SELECT * FROM {{scored}}), {SCORES}", scored=scored)
