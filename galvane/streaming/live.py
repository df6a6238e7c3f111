"""The sliding buffer as a table of snapshots that a stream keeps and anyone may ask.

The last writer of a (modality, time, variable) wins. Of each modality those frames stay that are at most retention_s
older than its newest one, and of these the newest cap. Each micro-batch writes a new version of the buffer in
the shared folder, under the number of the batch, so a batch that is run again writes the same version; readers
take the newest version that is whole. Before the shuffle a task keeps one frame a key and at most cap a modality.

Defined results: frames without modality, time, variable or order are left out; a null value is a value; of equal orders the
greater value wins; a row with clear empties its modality (null: all) of what has a smaller order, which does not count as dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

KEY = ["modality", "time", "variable"]
FRAMES = "modality string, time double, variable string, `order` bigint, value double"
COUNTS = "modality string, dropped bigint"
RETENTION_S, CAP = 14400.0, 50


def deduplicated(frames: DataFrame) -> DataFrame:
    """One frame of each key, the last one written."""
    whole = frames.dropna(subset=[*KEY, "order"])
    return whole.groupBy(*KEY).agg(F.max(F.struct("order", "value")).alias("last")).select(*KEY, "last.order", "last.value")


def pruned(frames: DataFrame, retention_s: float = RETENTION_S, cap: int = CAP) -> DataFrame:
    """The frames that stay. The newest cap hold the newest, so the cap goes first: its limit is applied before the shuffle."""
    newest = Window.partitionBy("modality").orderBy(F.desc("time"), F.desc("order"), F.desc("variable"))
    few = frames.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= cap)
    top = F.max("time").over(Window.partitionBy("modality"))
    return few.withColumn("_top", top).where(F.col("time") >= F.col("_top") - retention_s).drop("_nth", "_top")


def history(frames: DataFrame, t: Column, minutes: float) -> DataFrame:
    """Frames of [t - minutes, t], both ends included."""
    return frames.where((F.col("time") >= t - minutes * 60.0) & (F.col("time") <= t))


def latest(frames: DataFrame) -> DataFrame:
    """The newest frame of each modality."""
    last = F.max(F.struct("time", "order", "variable", "value")).alias("last")
    return frames.groupBy("modality").agg(last).select("modality", "last.time", "last.variable", "last.order", "last.value")


def summary(frames: DataFrame, counts: DataFrame) -> DataFrame:
    """modality, count, earliest, latest, dropped: of every modality that has frames or has dropped some."""
    by = frames.groupBy("modality").agg(F.count("*").alias("count"), F.min("time").alias("earliest"), F.max("time").alias("latest"))
    return by.join(counts, "modality", "full").select("modality", F.coalesce("count", F.lit(0)).alias("count"), "earliest", "latest", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole versions below root, rising. counts is written last, so its mark stands for both tables."""
    fs, where = _files(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [v for v in found if fs.exists(_files(spark, f"{root}/version={v}/counts/_SUCCESS")[1])]


def snapshot(spark: SparkSession, root: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and counts of the newest version (below before, if given); both empty where there is none."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], FRAMES), spark.createDataFrame([], COUNTS)
    at = f"{root}/version={known[-1]}"
    return spark.read.schema(FRAMES).parquet(f"{at}/frames"), spark.read.schema(COUNTS).parquet(f"{at}/counts")


def put(held: DataFrame, counts: DataFrame, batch: DataFrame, retention_s: float = RETENTION_S, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The buffer and its counts after batch (modality, time, variable, order, value, clear)."""
    fields = [*KEY, "order", "value"]
    clears = batch.where("clear")
    one = clears.where("modality IS NOT NULL").groupBy("modality").agg(F.max("order").alias("_one"))
    every = clears.where("modality IS NULL").agg(F.max("order").alias("_all"))
    both = held.select(*fields).unionByName(batch.where("clear IS NULL OR NOT clear").select(*fields))
    live = both.join(one, "modality", "left").crossJoin(F.broadcast(every)).where("`order` > coalesce(greatest(_one, _all), `order` - 1)").select(*fields)
    frames = deduplicated(live)
    kept = pruned(frames, retention_s, cap)
    lost = frames.groupBy("modality").agg(F.count("*").alias("n")).unionByName(kept.groupBy("modality").agg((-F.count("*")).alias("n")))
    total = lost.unionByName(counts.select("modality", F.col("dropped").alias("n"))).groupBy("modality").agg(F.sum("n").cast("long").alias("dropped"))
    return kept, total


def keeper(root: str, retention_s: float = RETENTION_S, cap: int = CAP, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch makes a version below root; the last keep versions stay, so readers have time."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frames, counts = put(*snapshot(spark, root, batch_id), batch, retention_s, cap)
        at = f"{root}/version={batch_id}"
        fs, where = _files(spark, at)
        fs.delete(where, True)  # of a run of this batch that did not end
        frames.write.parquet(f"{at}/frames")
        counts.write.parquet(f"{at}/counts")
        for old in versions(spark, root)[:-keep]:
            fs.delete(_files(spark, f"{root}/version={old}")[1], True)

    return step
