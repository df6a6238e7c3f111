"""What the sliding buffer holds after all observations, and what is asked of it; streaming.live keeps the same as a stream.

A frame is what a station (its variable) said of a modality in a cycle; the largest event_id is the last writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.plans.catalog import query
from galvane.plans.relational import for_duckdb
from galvane.sources import views
from galvane.streaming import live

KEPT = """last AS (SELECT modality, cycle * 600D AS time, CAST(station AS STRING) AS variable, event_id AS ord, value, row_number() OVER (PARTITION BY modality, cycle, station ORDER BY event_id DESC) AS k FROM {v_obs} WHERE modality IS NOT NULL AND cycle IS NOT NULL AND station IS NOT NULL),
aged AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY time DESC, ord DESC) AS nth, max(time) OVER (PARTITION BY modality) AS top FROM last WHERE k = 1),
kept AS (SELECT * FROM aged WHERE nth <= 50 AND time >= top - 14400)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations as frames (modality, time, variable, order, value)."""
    return views.v_obs(spark, sf_dir).select("modality", (F.col("cycle") * 600.0).alias("time"), F.col("station").cast("string").alias("variable"), F.col("event_id").alias("order"), "value")


def buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.pruned(live.deduplicated(frames(spark, sf_dir)))


@query("buffer_history", for_duckdb(f"WITH {KEPT}, now AS (SELECT max(time) - 1800 AS t FROM kept) SELECT modality, time, variable, value FROM kept, now WHERE time >= t - 3600 AND time <= t"))
def buffer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed hour that ends half an hour before the newest frame."""
    held = buffer(spark, sf_dir)
    now = held.agg((F.max("time") - 1800).alias("t"))
    return live.history(held.crossJoin(F.broadcast(now)), F.col("t"), 60).select("modality", "time", "variable", "value")


@query("buffer_latest", for_duckdb(f"WITH {KEPT} SELECT modality, time, variable, value FROM kept WHERE nth = 1"))
def buffer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest frame of each modality."""
    return live.latest(buffer(spark, sf_dir)).select("modality", "time", "variable", "value")


@query("buffer_summary", for_duckdb(f"WITH {KEPT}, n AS (SELECT modality, count(*) AS n FROM aged GROUP BY modality) SELECT k.modality, count(*) AS count, min(time) AS earliest, max(time) AS latest, max(n) - count(*) AS dropped FROM kept k JOIN n ON n.modality = k.modality GROUP BY k.modality"))
def buffer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames each modality holds, from when to when, and how many it dropped."""
    none = spark.createDataFrame([], live.FRAMES), spark.createDataFrame([], live.COUNTS)
    return live.summary(*live.put(*none, frames(spark, sf_dir).withColumn("clear", F.lit(False))))
