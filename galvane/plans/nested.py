"""Queries that go through documents: what is asked of them is read back from JSON text, not from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.operators.ranks import stored
from galvane.plans import geometry  # noqa: F401
from galvane.plans.catalog import SQL, query
from galvane.plans.geometry import EDGES
from galvane.plans.relational import for_duckdb
from galvane.plans.stateful import ALERTS_SQL, STAGED, in_cases, sent_alerts
from galvane.sources import documents, views

AREAS_SQL = for_duckdb(f"WITH {EDGES} SELECT CAST(s_suppkey AS STRING) AS id, block, district, state, CAST(population AS BIGINT) AS population, round(min(x1), 6) AS west, round(min(y1), 6) AS south, round(max(x1), 6) AS east, round(max(y1), 6) AS north, count(*) AS corners FROM ring GROUP BY s_suppkey, block, district, state, population")


@query("admin_areas", AREAS_SQL)
def admin_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoJSON document of each district, parsed again into areas with their boxes."""
    docs = documents.collections(geometry.regions(spark, sf_dir), "district")
    found = documents.areas(documents.parsed(docs, documents.GEOJSON))
    return found.select("id", "block", "district", "state", "population", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")], F.size("ring").cast("long").alias("corners"))


def case_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, doc: each event's bundle."""
    event = F.floor(F.col("cycle") / views.EVENT_CYCLES).cast("long").alias("event")
    cells = views.v_storm(spark, sf_dir).select(event, "cycle", "i", "j", "lat", "lon", "intensity")
    return documents.bundles(cells, stored(sent_alerts(spark, sf_dir, in_cases(STAGED))).select("event", "id", "preset", "minute", "region", "stage"))


CASES_SQL = for_duckdb(f"""WITH c AS (SELECT CAST(floor(cycle / {views.EVENT_CYCLES}) AS BIGINT) AS event_id, min(cycle) AS first_cycle, max(cycle) AS last_cycle, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS cells, max(intensity) AS top FROM {{v_storm}} GROUP BY 1),
a AS (SELECT event, count(*) AS alerts FROM alerts_q GROUP BY event)
SELECT event_id, concat('Storms of event ', CAST(event_id AS STRING)) AS title, first_cycle, last_cycle, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, cells, coalesce(alerts, 0) AS alerts, round(top, 6) AS top FROM c LEFT JOIN a ON event = event_id""").replace("alerts_q", f"(SELECT * FROM ({in_cases(ALERTS_SQL)}) q)")


@query("case_studies", CASES_SQL)
def case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of case studies, from their bundles."""
    found = documents.listed(documents.parsed(case_bundles(spark, sf_dir), documents.BUNDLE))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])
