"""Running sums and ranks of ordered groups, however many rows one group has.

Rows are dealt by ranges of (group, order), so that a large group lies in several ranges; each range sums
its own rows, and what the ranges before it in the group hold is added. No task holds a whole group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, in a local session without one, a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-ranks-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], store: Callable[[DataFrame], DataFrame] = stored, dealt: Sequence[Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """df with, under each name of sums, its expression summed over the rows of the same keys up to the row's own.

    order puts the rows of a group in order; dealt, where order is too wide to sample, is a coarser
    order that agrees with it (rows equal in it share a task). Rows with a null key are left out. keep may
    name _range, the number of a row's range.
    The dealt rows are stored once: bounds of ranges are drawn anew whenever a plan runs.
    """
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else df
    placed = store(rows.repartitionByRange(*keys, *(order if dealt is None else dealt)).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_range").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    offsets = parts.select(*keys, "_range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}_before") for name in sums])
    summed = placed.select("*", *[F.sum(x).over(own).alias(name) for name, x in sums.items()])
    both = summed.join(offsets, [*keys, "_range"])
    return both.select(*df.columns, *keep, *[(F.col(name) + F.col(f"_{name}_before")).alias(name) for name in sums])
