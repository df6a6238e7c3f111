"""As-of joins in blocks of time: the newest event at or before each time asked for.

Rows are sorted by key and block of time, so no task holds a key's whole history; what a block without an
earlier event of its own needs is the last event of the blocks before, of which there is one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def latest(asked: DataFrame, events: DataFrame, by: Sequence[str], time: str, values: Sequence[str], width: float, ties: Sequence[str] = ()) -> DataFrame:
    """asked with values of the newest event of the same key and at most its time; null where there is none.

    Both have by and time; of events at one time the one with the largest ties counts. width: a block, in time's unit.
    Keys and times are not null.
    """
    own = [c for c in asked.columns if c not in (*by, time)]
    block = F.floor(F.col(time) / width).alias("_block")
    found = F.struct(*values).alias("_found")
    kind = {c: events.schema[c].dataType for c in ties}
    told = events.select(*by, time, block, F.lit(0).alias("_kind"), *[F.col(c).alias(f"_tie_{c}") for c in ties], found, F.lit(None).cast(asked.select(F.struct(*own)).schema[0].dataType).alias("_own"))
    want = asked.select(*by, time, block, F.lit(1).alias("_kind"), *[F.lit(None).cast(kind[c]).alias(f"_tie_{c}") for c in ties], F.lit(None).cast(told.schema["_found"].dataType).alias("_found"), F.struct(*own).alias("_own"))
    both = told.unionByName(want)
    inside = Window.partitionBy(*by, "_block").orderBy(time, "_kind", *[f"_tie_{c}" for c in ties]).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_found", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = both.groupBy(*by, "_block").agg(F.max_by("_found", F.when(F.col("_kind") == 0, F.struct(time, *[f"_tie_{c}" for c in ties]))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    got = near.join(carried, [*by, "_block"]).withColumn("_got", F.coalesce("_near", "_carried"))
    return got.select(*by, time, *[F.col(f"_own.{c}").alias(c) for c in own], *[F.col(f"_got.{v}").alias(v) for v in values])
