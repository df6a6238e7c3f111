"""Nested documents: GeoJSON of administrative areas and bundles of case studies, out and in.

Documents are built and read by Spark's JSON functions against a schema, one document a row or a file, so that any
number of them is read in parallel; a file of many lines is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GEOJSON = """type string, features array<struct<type: string, id: string, properties: struct<block: string, district: string, state: string, population: bigint>,
  geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"""
BUNDLE = """event_id bigint, title string, first_cycle bigint, last_cycle bigint, bbox array<double>,
  cells array<struct<cycle: bigint, i: int, j: int, lat: double, lon: double, intensity: double>>, alerts array<struct<id: bigint, preset: string, minute: double, region: string, stage: int>>"""


def feature(ring: Column, id: Column, **properties: Column) -> Column:
    """A GeoJSON polygon feature; ring is array<struct<x, y>>, not closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), id.cast("string").alias("id"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), geometry.alias("geometry"))


def collections(regions: DataFrame, by: str) -> DataFrame:
    """by, doc: one FeatureCollection for each value of by, of regions (s_suppkey, block, district, state, population, ring)."""
    f = feature(F.col("ring"), F.col("s_suppkey"), block=F.col("block"), district=F.col("district"), state=F.col("state"), population=F.col("population").cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", f.alias("f")))), lambda x: x["f"])
    return regions.groupBy(by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), listed.alias("features"))).alias("doc"))


def areas(documents: DataFrame) -> DataFrame:
    """id, block, district, state, population, ring and its box (west, south, east, north) of the features in documents (features array<...>).

    A box is taken from the first ring's corners; a ring comes back without the repeated corner. Features without a ring are left out.
    """
    f = documents.select(F.explode("features").alias("f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    rows = f.select(F.col("f.id").alias("id"), "f.properties.*", ring.alias("ring")).where("size(ring) >= 4").withColumn("ring", F.slice("ring", F.lit(1), F.size("ring") - 1))
    for name, axis, end in (("west", "x", F.array_min), ("south", "y", F.array_min), ("east", "x", F.array_max), ("north", "y", F.array_max)):
        rows = rows.withColumn(name, end(F.col("ring")[axis]))
    return rows


def parsed(documents: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """The fields of JSON text in doc; what is no document of the schema is left out."""
    return documents.select(F.from_json(doc, schema, {"mode": "PERMISSIVE"}).alias("_d")).where("_d IS NOT NULL").select("_d.*")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The areas of all GeoJSON files below path."""
    return areas(spark.read.schema(GEOJSON).json(path, multiLine=True))


def write_documents(docs: DataFrame, path: str, by: str) -> None:
    """One file of text for each value of by: path/by=.../part-*; docs has by and doc, once each."""
    docs.select(by, "doc").repartition(by).write.partitionBy(by).text(path)


def bundles(cells: DataFrame, alerts: DataFrame) -> DataFrame:
    """event_id, doc: a case study's bundle of its cells (event, cycle, i, j, lat, lon, intensity) and alerts (event, id, preset, minute, region, stage), each in order."""
    c = cells.groupBy("event").agg(
        F.array_sort(F.collect_list(F.struct("cycle", "i", "j", "lat", "lon", "intensity"))).alias("cells"), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"),
        F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("bbox"),
    )
    a = alerts.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("id", "preset", "minute", "region", "stage"))).alias("alerts"))
    none = F.array().cast("array<struct<id: bigint, preset: string, minute: double, region: string, stage: int>>")
    body = F.struct(F.col("event").alias("event_id"), F.concat(F.lit("Storms of event "), F.col("event").cast("string")).alias("title"), "first_cycle", "last_cycle", "bbox", "cells", F.coalesce("alerts", none).alias("alerts"))
    return c.join(a, "event", "left").select(F.col("event").alias("event_id"), F.to_json(body).alias("doc"))


def listed(bundles: DataFrame) -> DataFrame:
    """A line for each bundle: what it spans and holds."""
    return bundles.select("event_id", "title", "first_cycle", "last_cycle", *[F.col("bbox")[k].alias(n) for k, n in enumerate(("west", "south", "east", "north"))], F.size("cells").cast("long").alias("cells"), F.size("alerts").cast("long").alias("alerts"), F.array_max(F.col("cells")["intensity"]).alias("top"))
