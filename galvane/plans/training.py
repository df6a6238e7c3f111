"""A model interface, the training protocol over whole events, and fields painted from what a model says.

A Forecaster turns rows of storm cells into the same rows with p. `trained` splits samples by whole events, fits on one part,
calibrates on another, scores the rest at a threshold, and keeps the fitted pipeline with a description of how it came about.
`painted` lays each cell's p as a kernel on the grid, whichever model it is from.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from galvane.operators.ranks import stored
from galvane.plans import fusion
from galvane.plans.catalog import QUERIES, SQL, query

FEATURES = fusion.FEATURES


class Forecaster(Protocol):
    """rows (cycle, i, j and features) -> rows with p; available: is there anything to predict from?"""

    @property
    def available(self) -> bool: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


@dataclass
class Climatology:
    """The share of positives."""

    share: float | None = None

    @property
    def available(self) -> bool:
        return self.share is not None

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", F.lit(self.share))


@dataclass
class Persistence:
    """Poisson rate of the last ten minutes, over a lead."""

    lead: float = 30.0
    available: bool = True

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", 1 - F.exp(-(F.col("f10") / 10.0) * self.lead))


@dataclass
class Fitted:
    """A fitted pipeline and its calibration."""

    model: PipelineModel | None = None
    calibration: object | None = None

    @property
    def available(self) -> bool:
        return self.model is not None

    def predict(self, rows: DataFrame) -> DataFrame:
        scores = self.model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
        if self.calibration is None:
            return scores.withColumnRenamed("raw", "p")
        return self.calibration.transform(scores).drop("raw").withColumnRenamed("calibrated", "p")


def by_event(rows: DataFrame, event: str = "day", train: float = 0.6, calibrate: float = 0.2) -> DataFrame:
    """rows with part: whole events to train, calibrate or test, in the order of a hash; with three events or more each part has one."""
    order = Window.orderBy(F.xxhash64(event), event)  # one row for each event
    events = rows.select(event).distinct().select(event, F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    first = F.greatest(F.floor(F.col("n") * train), F.lit(1))
    second = F.greatest(F.floor(F.col("n") * (train + calibrate)), first + 1)
    part = F.when(F.col("k") <= first, "train").when((F.col("k") <= second) & (F.col("n") > 2), "calibrate").otherwise("test")
    return rows.join(events.select(event, part.alias("part")), event)


def scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n, positives, hits, misses, false_alarms, pod, far, csi and brier of rows (y, p), by part."""
    yes, wet = F.col("p") >= threshold, F.col("y") == 1
    c = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.count_if(yes & wet).alias("hits"), F.count_if(~yes & wet).alias("misses"), F.count_if(yes & ~wet).alias("false_alarms"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    return c.withColumns({"pod": F.try_divide("hits", F.col("hits") + F.col("misses")), "far": F.try_divide("false_alarms", F.col("hits") + F.col("false_alarms")), "csi": F.try_divide("hits", F.col("hits") + F.col("misses") + F.col("false_alarms"))})


def trained(rows: DataFrame, features: list[str] = FEATURES, event: str = "day") -> tuple[Forecaster, DataFrame]:
    """The forecaster fitted on rows (event, features, y), and rows with their part. With one class only it is the climatology."""
    rows = by_event(rows, event)
    train, held = rows.where("part = 'train'"), rows.where("part = 'calibrate'")
    base = train.agg(F.avg("y").alias("share"), F.count_distinct("y").alias("kinds")).first()
    if (base["kinds"] or 0) < 2:
        return Climatology(base["share"]), rows
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, standardization=True)]).fit(train)
    raw = Fitted(model)
    calibration = None
    if held.select("y").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="calibrated").fit(raw.predict(held).withColumnRenamed("p", "raw"))
    return Fitted(model, calibration), rows


def save(forecaster: Fitted, rows: DataFrame, path: str, **more: object) -> None:
    """The pipeline, the calibration, and meta.json: events and rows of each part, scores at 0.5, and what else is told."""
    forecaster.model.write().overwrite().save(f"{path}/pipeline")
    if forecaster.calibration is not None:
        forecaster.calibration.write().overwrite().save(f"{path}/calibration")
    parts = [r.asDict() for r in scores(forecaster.predict(rows)).orderBy("part").collect()]  # three rows
    events = {r["part"]: r["events"] for r in rows.groupBy("part").agg(F.count_distinct("day").alias("events")).collect()}
    meta = {"features": FEATURES, "events": events, "scores": parts, "calibrated": forecaster.calibration is not None, **more}
    rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    from pyspark.ml.regression import IsotonicRegressionModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return Fitted(PipelineModel.load(f"{path}/pipeline"), IsotonicRegressionModel.load(f"{path}/calibration") if meta["calibrated"] else None), meta


def painted(rows: DataFrame, background: float = 0.05, sigma: float = 1.5, size: int = 10, reach: int = 6) -> DataFrame:
    """cycle, i, j, p on the grid: the union of a kernel around each cell of rows (cycle, i, j, p) that is above the background.

    A kernel goes to the pixels within reach (four sigma: beyond it is 0.0003 at most), so a cell makes a bounded number of rows.
    """
    near = F.sequence(F.lit(-reach), F.lit(reach))
    k = rows.where(F.col("p") > background).select("cycle", F.col("i").alias("ci"), F.col("j").alias("cj"), "p", F.explode(near).alias("di")).select("*", F.explode(near).alias("dj"))
    k = k.select("cycle", (F.col("ci") + F.col("di")).alias("i"), (F.col("cj") + F.col("dj")).alias("j"), (F.col("p") * F.exp(-0.5 * (F.col("di") ** 2 + F.col("dj") ** 2) / sigma**2)).alias("k"))
    k = k.where(F.col("i").between(0, size - 1) & F.col("j").between(0, size - 1))
    return k.groupBy("cycle", "i", "j").agg((1 - (1 - background) * F.exp(F.sum(F.log(1 - F.least("k", F.lit(0.999)))))).alias("p"))


@query("training_report")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by part of the fitted model and of two baselines, over whole events."""
    forecaster, rows = trained(stored(fusion.features(spark, sf_dir)))
    share = rows.where("part = 'train'").agg(F.avg("y")).first()[0]
    models = {"fitted": forecaster, "persistence": Persistence(), "climatology": Climatology(share)}
    out = None
    for name, model in models.items():
        if model.available:
            own = scores(model.predict(rows)).withColumn("model", F.lit(name))
            out = own if out is None else out.unionByName(own)
    return out


_OFFSETS = ", ".join(f"({k})" for k in range(-6, 7))
PAINTED_SQL = f"""WITH c AS (SELECT cycle, i, j, p30 AS p FROM ({SQL['poisson_persistence']}) q WHERE p30 > 0.05), r AS (SELECT * FROM (VALUES {_OFFSETS}) AS t(o)),
k AS (SELECT cycle, i + a.o AS i, j + b.o AS j, p * exp(-0.5 * (a.o * a.o + b.o * b.o) / 2.25) AS k FROM c, r a, r b)
SELECT cycle, i, j, round(1 - 0.95 * exp(sum(ln(1 - least(k, 0.999)))), 6) AS p FROM k WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 GROUP BY cycle, i, j"""


@query("predict_then_paint", PAINTED_SQL)
def predict_then_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persistence model's forecast, painted."""
    rows = QUERIES["flash_counts_10_20_30"](spark, sf_dir)
    said = Persistence().predict(rows).withColumn("p", F.round("p", 6))
    return painted(said).select("cycle", "i", "j", F.round("p", 6).alias("p"))
