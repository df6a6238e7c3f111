"""Query functions: f(spark, sf_dir, **filters) -> DataFrame, one for each thing that a client asks for.

Each is a registered query with filters on top, so predicates reach the scans where the query's own
grouping lets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.operators import polygons
from galvane.plans import baselines as _models, bulletins, catalog, fields, geometry, kinematics, nested, nowcast, products, ranked, relational, stateful  # noqa: F401
from galvane.sources import documents, frames, views


def _asked(name: str, spark: SparkSession, sf_dir: str, /, **filters: object) -> DataFrame:
    """The query's rows whose columns equal the filters that are not None; text goes without case."""
    out = catalog.QUERIES[name](spark, sf_dir)
    for column, value in filters.items():
        if value is not None:
            out = out.where(F.lower(column) == value.lower() if isinstance(value, str) else F.col(column) == value)
    return out


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their leads and samples, the latest first."""
    return views.v_pred(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("lead").alias("leads")).orderBy(F.desc("run"))


def scoreboard(spark: SparkSession, sf_dir: str, run: int | None = None, lead: int | None = None) -> DataFrame:
    return _asked("verification_suite", spark, sf_dir, run=run, lead=lead)


def baselines(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return _asked("baseline_matrix", spark, sf_dir, model=model)


def alerts(spark: SparkSession, sf_dir: str, event: int | None = None, preset: str | None = None, stage: int | None = None, region: str | None = None, verdict: str | None = None) -> DataFrame:
    return _asked("alerts", spark, sf_dir, event=event, preset=preset, stage=stage, region=region, verdict=verdict)


def bulletin(spark: SparkSession, sf_dir: str, cycle: int) -> DataFrame:
    """The bulletin of each preset at a cycle: alerts valid then (60 minutes), regions in order of first sight, people, rung and confidence."""
    t = spark.range(1).select(F.lit(float(cycle * 10)).alias("t"))
    return bulletins.bulletin_at(alerts(spark, sf_dir), t, catalog.QUERIES["router_rung"](spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str, cycle: int | None = None) -> DataFrame:
    return _asked("geojson_cells", spark, sf_dir, cycle=cycle)


def initiation(spark: SparkSession, sf_dir: str, frame: int | None = None, least_p: float = 0.0) -> DataFrame:
    return _asked("initiation_clusters", spark, sf_dir, frame=frame).where(F.col("p") >= least_p).orderBy(F.desc("p"), "frame", "label")


def field(spark: SparkSession, sf_dir: str, cycle: int | None = None) -> DataFrame:
    return _asked("noisy_or_field", spark, sf_dir, cycle=cycle)


def flashes(spark: SparkSession, sf_dir: str, since: float, until: float) -> DataFrame:
    """Flashes in (since, until], seconds of the views' clock."""
    return views.v_flash(spark, sf_dir).where((F.col("s") > since) & (F.col("s") <= until))


def data_health(spark: SparkSession, sf_dir: str, modality: str | None = None) -> DataFrame:
    return _asked("modality_status", spark, sf_dir, name=modality)


def model_health(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    return _asked("model_health", spark, sf_dir, run=run)


def nwp_indices(spark: SparkSession, sf_dir: str, variable: int | None = None) -> DataFrame:
    return _asked("nwp_index_stats", spark, sf_dir, variable=variable)


def blocks(spark: SparkSession, sf_dir: str, district: str | None = None) -> DataFrame:
    """Administrative blocks, a district's without regard to case."""
    out = views.v_block(spark, sf_dir)
    return out if district is None else out.where(F.lower("district") == district.lower())


def cap(spark: SparkSession, sf_dir: str, event: int | None = None, preset: str | None = None, id: int | None = None) -> DataFrame:
    """Messages, of an event, a preset or one alert."""
    return _asked("cap_full", spark, sf_dir, event=event, preset=preset, id=id)


def message_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that went out with what is wrong with them, if anything is."""
    return bulletins.faults(cap(spark, sf_dir)).where("faults <> ''")


def tracks(spark: SparkSession, sf_dir: str, track: int | None = None, least_kmh: float = 0.0) -> DataFrame:
    return _asked("kalman_tracks", spark, sf_dir, track=track).where(F.col("velocity_kmh") >= least_kmh)


def path(spark: SparkSession, sf_dir: str, track: int | None = None, lead: int | None = None) -> DataFrame:
    return _asked("kalman_path", spark, sf_dir, track=track, lead=lead)


def cone(spark: SparkSession, sf_dir: str, track: int | None = None) -> DataFrame:
    return _asked("kalman_cone", spark, sf_dir, track=track)


def impacts(spark: SparkSession, sf_dir: str, cycle: int | None = None, district: str | None = None) -> DataFrame:
    """Blocks under storms with the covered part and people, the most covered first."""
    return _asked("polygon_overlap", spark, sf_dir, cycle=cycle, district=district).orderBy("cycle", "i", "j", F.desc("overlap_fraction"), "s_suppkey")


def blocks_in_box(spark: SparkSession, sf_dir: str, west: float, south: float, east: float, north: float) -> DataFrame:
    box = spark.createDataFrame([(west, south, east, north)], "x0 double, y0 double, x1 double, y1 double")
    return polygons.meetings(box, geometry.regions(spark, sf_dir)).select("region.s_suppkey", "region.state", "region.district", "region.block", "region.population")


def blocks_at(spark: SparkSession, sf_dir: str, lat: float, lon: float) -> DataFrame:
    """Blocks whose polygon holds a point."""
    return geometry.regions(spark, sf_dir).where(polygons.holds(F.col("ring"), F.lit(lon), F.lit(lat))).drop("ring")


def admin_geojson(spark: SparkSession, sf_dir: str, district: str | None = None) -> DataFrame:
    """A FeatureCollection for each district."""
    regions = geometry.regions(spark, sf_dir)
    return documents.collections(regions if district is None else regions.where(F.lower("district") == district.lower()), "district")


def cases(spark: SparkSession, sf_dir: str, event: int | None = None) -> DataFrame:
    return _asked("case_studies", spark, sf_dir, event_id=event)


def case_bundle(spark: SparkSession, sf_dir: str, event: int) -> DataFrame:
    return nested.case_bundles(spark, sf_dir).where(F.col("event_id") == event)


def probability(spark: SparkSession, sf_dir: str, cycle: int | None = None, lead: int = 30) -> DataFrame:
    """The probability field at 30 minutes, or beyond an hour at 90 or 120."""
    return _asked("probability_field", spark, sf_dir, cycle=cycle) if lead == 30 else _asked("lagrangian_120", spark, sf_dir, cycle=cycle, lead=lead)


def uncertainty(spark: SparkSession, sf_dir: str, frame: int | None = None, lead: int | None = None) -> DataFrame:
    return _asked("uncertainty_terms", spark, sf_dir, frame=frame, lead=lead)


def plumes(spark: SparkSession, sf_dir: str, frame: int | None = None, lead: int | None = None) -> DataFrame:
    return _asked("initiation_plumes", spark, sf_dir, frame=frame, lead=lead)


def climate(spark: SparkSession, sf_dir: str, modality: str | None = None) -> DataFrame:
    return _asked("percentiles", spark, sf_dir, modality=modality)


def history(spark: SparkSession, path: str, t, minutes: float) -> DataFrame:
    """Observations of an event table in (t - minutes, t], through the data source."""
    return frames.history(frames.frames(spark, path), t, minutes)


def rings(spark: SparkSession, sf_dir: str, station: int | None = None) -> DataFrame:
    return _asked("range_rings", spark, sf_dir, station=station)


def settlements(spark: SparkSession, sf_dir: str, lead: int | None = None) -> DataFrame:
    return _asked("event_time_settlement", spark, sf_dir, lead=lead)
