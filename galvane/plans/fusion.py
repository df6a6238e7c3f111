"""Boosted-tree fusion: features of storm cells, a Spark ML fit split by day, isotonic calibration, gating, and scores of every cell."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from galvane.plans.catalog import QUERIES, query
from galvane.plans import kinematics, relational  # noqa: F401
from galvane.sources import views

NWP = ["cape", "cin", "shear", "rh"]
FEATURES = ["intensity", "f10", "f20", "f30", *NWP, *[f"no_{v}" for v in NWP]]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per storm cell: flash counts, intensity, the as-of model values or 0 with their missing flags, label."""
    keys = ["cycle", "i", "j"]
    rows = QUERIES["flash_counts_10_20_30"](spark, sf_dir).join(QUERIES["flash_exists_label"](spark, sf_dir), keys)
    rows = rows.join(QUERIES["nwp_asof"](spark, sf_dir), keys, "left")
    flags = {f"no_{v}": F.col(v).isNull().cast("double") for v in NWP}
    return rows.withColumns(flags).fillna(0.0, NWP).withColumn("day", F.floor(F.col("cycle") / views.EVENT_CYCLES))


def split(rows: DataFrame) -> DataFrame:
    """Whole days go to one part, so that no event is in two: of the days, in the order of a hash, 70 % train, 15 % calibrate, the rest test.

    A table has no more days than the calendar, so one task can rank them.
    """
    days = rows.select("day").distinct().withColumn("at", F.percent_rank().over(Window.orderBy(F.xxhash64("day"), "day")))
    part = F.when(F.col("at") < 0.7, "train").when(F.col("at") < 0.85, "calibrate").otherwise("test")
    return rows.join(days.select("day", part.alias("part")), "day")


def bounded(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def gate() -> Column:
    """What the environment leaves of a probability; without model values nothing is taken."""
    cape = F.when(F.col("no_cape") == 1, 1.0).otherwise(bounded(F.col("cape") / 1000, 0.1, 1.0))
    cap = F.when(F.col("cin") > 200, bounded(1 - (F.col("cin") - 200) / 200, 0.1, 1.0)).otherwise(1.0)
    shear = F.when(F.col("shear") >= 15, bounded(1 + 0.1 * ((F.col("shear") - 15) / 10), 1.0, 1.2)).otherwise(1.0)
    known = (F.col("no_cape") == 0) | (F.col("no_cin") == 0)
    return F.when(known, bounded(cape * cap * shear, 0.1, 1.0)).otherwise(1.0)


@query("tree_fusion")
def tree_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split(features(spark, sf_dir))
    train = rows.where("part = 'train'")
    if train.select("y").distinct().count() < 2:  # one class cannot be fitted: its share is the forecast
        share = train.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("p"))
        return rows.join(F.broadcast(share)).select("cycle", "i", "j", "part", "y", F.col("p").alias("raw"), F.col("p").alias("calibrated"), "p")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxIter=20, maxDepth=4, stepSize=0.1, seed=7)]).fit(train)
    scores = model.transform(rows).drop("prediction").withColumn("raw", vector_to_array("probability")[1])
    held = scores.where("part = 'calibrate'")
    if held.isEmpty():
        scores = scores.withColumn("calibrated", F.col("raw"))
    else:
        scores = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="calibrated").fit(held).transform(scores)
    return scores.select("cycle", "i", "j", "part", "y", "raw", "calibrated", bounded(F.col("calibrated") * gate(), 0.0, 1.0).alias("p"))
