"""S1, S5, 2.13: observations as a data source of their own, with pushed filters, partitions and a replay as a stream.

`galvane_frames` reads the Parquet files of an event table by row group. Filters on time, modality and the box of latitude and
longitude are taken: row groups whose statistics rule them out are not read, and rows are filtered in Arrow batches. As a
stream it replays the table: each batch holds the next `step_minutes` of event time, by the files' own times,
so that a query over a live feed runs over a recorded one. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "event_id bigint, time timestamp, modality string, lat double, lon double, value double"
#: Which event stands for which source; pixels lie on tenths of a degree.
MODALITIES = {"view": "radar", "click": "satellite", "purchase": "lightning", "signup": "surface", "error": "model"}
BOUNDS = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, EqualTo: pc.equal}


@dataclass
class Piece(InputPartition):
    path: str
    group: int
    since: int | None = None
    until: int | None = None


def micros(value: dt.datetime) -> int:
    whole = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return round(whole.timestamp() * 1e6)


class Files:
    """The row groups of a table and what their statistics say of the times in them."""

    def __init__(self, path: str):
        self.fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        info = self.fs.get_file_info(root)
        found = self.fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        self.paths = sorted(f.path for f in found if f.path.endswith(".parquet"))

    def groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, group, least time, largest time), in microseconds."""
        for path in self.paths:
            meta = pq.ParquetFile(path, filesystem=self.fs).metadata
            at = meta.schema.names.index("ts")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                known = stats is not None and stats.has_min_max
                yield path, g, micros(stats.min) if known else -(2**62), micros(stats.max) if known else 2**62


def batches(root: str, piece: Piece, kept: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The rows of a row group in [since, until) that pass the filters."""
    table = pq.ParquetFile(piece.path, filesystem=Files(root).fs).read_row_group(piece.group, columns=["event_id", "ts", "event_type", "value", "props"])
    at = pc.cast(pc.cast(table["ts"], pa.timestamp("us")), pa.int64())
    k = pc.cast(pc.struct_field(pc.extract_regex(table["props"], r'"k":\s*(?P<k>-?[0-9]+)'), [0]), pa.int64())
    i = pc.floor(pc.divide(pc.cast(k, pa.float64()), 10.0))
    j = pc.subtract(pc.cast(k, pa.float64()), pc.multiply(i, 10.0))
    kind = pa.chunked_array([pa.array([MODALITIES.get(x) for x in table["event_type"].to_pylist()], pa.string())])
    out = pa.table({
        "event_id": table["event_id"], "time": pc.cast(at, pa.timestamp("us", tz="UTC")), "modality": kind,
        "lat": pc.subtract(26.0, pc.multiply(0.1, i)), "lon": pc.add(84.0, pc.multiply(0.1, j)), "value": table["value"],
    })
    mask = pa.array([True] * len(out))
    if piece.since is not None:
        mask = pc.and_(mask, pc.and_(pc.greater_equal(at, piece.since), pc.less(at, piece.until)))
    for f in kept:
        column = out[f.attribute[0]]
        value = pa.scalar(micros(f.value), pa.int64()).cast(pa.timestamp("us", tz="UTC")) if isinstance(f.value, dt.datetime) else f.value
        mask = pc.and_(mask, BOUNDS[type(f)](column, value))
    yield from out.filter(mask).to_batches()


class FramesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.kept = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons with time, modality, lat and lon are done here; the rest goes back to Spark."""
        for f in filters:
            if type(f) in BOUNDS and len(f.attribute) == 1 and f.attribute[0] in ("time", "modality", "lat", "lon"):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        low = max([micros(f.value) for f in self.kept if f.attribute == ("time",) and type(f) in (GreaterThan, GreaterThanOrEqual, EqualTo)], default=-(2**63))
        high = min([micros(f.value) for f in self.kept if f.attribute == ("time",) and type(f) in (LessThan, LessThanOrEqual, EqualTo)], default=2**63)
        return [Piece(path, g) for path, g, least, most in Files(self.path).groups() if most >= low and least <= high] or [Piece("", -1)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition, self.kept) if partition.group >= 0 else iter(())


class FramesStream(DataSourceStreamReader):
    """Offsets are event times; each trigger takes the next step, and the last one what is left."""

    def __init__(self, path: str, step_minutes: float):
        self.path, self.step = path, round(step_minutes * 60e6)
        times = [(a, b) for _, _, a, b in Files(path).groups()]
        self.first, self.end = min((a for a, _ in times), default=0), max((b for _, b in times), default=-1) + 1
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"at": self.first}

    def latestOffset(self) -> dict:
        self.at = min(self.end, (self.first if self.at is None else self.at) + self.step)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = max(self.at or 0, end["at"])
        return [Piece(path, g, start["at"], end["at"]) for path, g, least, most in Files(self.path).groups() if least < end["at"] and most >= start["at"]]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition, [])

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "galvane_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"])

    def streamReader(self, schema) -> FramesStream:
        return FramesStream(self.options["path"], float(self.options.get("step_minutes", "1440")))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The observations of an event table, by the data source."""
    spark.dataSource.register(Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("galvane_frames").load(path)


def history(observations: DataFrame, t: dt.datetime, minutes: float) -> DataFrame:
    """Observations in (t - minutes, t], oldest first."""
    return observations.where((F.col("time") > F.lit(t - dt.timedelta(minutes=minutes))) & (F.col("time") <= F.lit(t))).orderBy("time", "event_id")


def last_before(observations: DataFrame, t: dt.datetime) -> DataFrame:
    """Of each source the newest observation at or before t."""
    return observations.where(F.col("time") <= F.lit(t)).groupBy("modality").agg(F.max_by(F.struct("event_id", "time", "lat", "lon", "value"), F.struct("time", "event_id")).alias("last")).select("modality", "last.*")


def flash_view(observations: DataFrame, centre: dt.datetime, minutes: float = 120.0) -> DataFrame:
    """Flashes with their seconds from the start of an event that lasts minutes to each side of centre, and those seconds as epoch time."""
    start = F.lit(centre - dt.timedelta(minutes=minutes))
    offset = (F.unix_micros("time") - F.unix_micros(start)) / 1e6
    inside = observations.where("modality = 'lightning'").where((F.col("time") >= start) & (F.col("time") <= F.lit(centre + dt.timedelta(minutes=minutes))))
    return inside.select("event_id", offset.alias("offset_s"), (F.unix_micros(start) / 1e6 + offset).alias("epoch_s"), "lat", "lon", "value")
