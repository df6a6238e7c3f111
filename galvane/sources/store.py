"""Run store on shared files: tables partitioned by run, where the newest version of a key is what counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The key of each table's rows within a run.
KEYS = {"forecasts": ["cell", "lead"], "alerts": ["alert_id"], "health": ["modality"], "samples": ["issued", "cell", "lead"], "settlements": ["cycle", "i", "j", "lead"]}


def append(rows: DataFrame, root: str, table: str) -> None:
    """Add rows (run_id, version, the table's key and more). Nothing is rewritten, so a retry is safe."""
    rows.write.mode("append").partitionBy("run_id").parquet(f"{root}/{table}")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each run and key the one with the largest version."""
    w = Window.partitionBy("run_id", *keys).orderBy(F.desc("version"))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def scan(spark: SparkSession, root: str, table: str, run_id: str | None = None, **equal) -> DataFrame:
    """Current rows of a table; run_id prunes partitions, other filters hold after the upsert."""
    rows = spark.read.parquet(f"{root}/{table}")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    rows = latest(rows, KEYS[table])
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows


def current_health(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of each modality over all runs."""
    rows = spark.read.parquet(f"{root}/health")
    return rows.groupBy("modality").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))
