"""2.13: the package's rules as SQL functions of a session, and the data source as a table.

Scalar and table functions are SQL bodies, so Catalyst puts them in place of their calls and nothing leaves the JVM.
`register` makes them known to a session; tables are asked with LATERAL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.plans import products
from galvane.plans.catalog import SQL, query
from galvane.plans.relational import for_duckdb
from galvane.sources import frames, views

FUNCTIONS = {
    "haversine_km(lat DOUBLE, lon DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": "2 * 6371.0088D * asin(sqrt(pow(sin(radians(lat - lat2) / 2), 2) + cos(radians(lat2)) * cos(radians(lat)) * pow(sin(radians(lon - lon2) / 2), 2)))",
    "risk_band(p DOUBLE) RETURNS STRING": "CASE WHEN p <= 0.2D THEN 'LOW' WHEN p <= 0.4D THEN 'MODERATE' WHEN p <= 0.6D THEN 'ELEVATED' WHEN p <= 0.8D THEN 'HIGH' ELSE 'SEVERE' END",
    "compass(east DOUBLE, north DOUBLE) RETURNS DOUBLE": "CASE WHEN east * east + north * north < 0.25D THEN 0D ELSE pmod(degrees(atan2(east, north)), 360D) END",
    "persistence(flashes_10 DOUBLE, lead DOUBLE) RETURNS DOUBLE": "1 - exp(-(flashes_10 / 10D) * lead)",
    "exposure(people DOUBLE) RETURNS DOUBLE": "CASE WHEN people <= 0 THEN 0D ELSE least(log10(people + 1D) / log10(500001D), 1D) END",
    "rings(lat0 DOUBLE, lon0 DOUBLE, km DOUBLE, points INT) RETURNS TABLE(n INT, lat DOUBLE, lon DOUBLE)": "SELECT k, lat0 + km / 111.32D * sin(radians(k * 360D / points)), lon0 + km / (111.32D * cos(radians(lat0))) * cos(radians(k * 360D / points)) FROM (SELECT explode(sequence(0, points - 1)) AS k)",
    "path(lat0 DOUBLE, lon0 DOUBLE, v_lat DOUBLE, v_lon DOUBLE) RETURNS TABLE(lead INT, lat DOUBLE, lon DOUBLE)": "SELECT m, round(lat0 + v_lat * (m / 60D), 4), round(lon0 + v_lon * (m / 60D), 4) FROM (SELECT explode(array(15, 30, 45, 60)) AS m)",
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, which the session knows from now on."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


@query("rings_by_function", SQL["range_rings"])
def rings_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    used = views.v_obs(spark, sf_dir).where("modality = 'radar'").select("station").distinct()
    text = f"WITH {products.STATIONS} SELECT s.station, r.n, round(r.lat, 5) AS lat, round(r.lon, 5) AS lon FROM st s JOIN {{used}} u ON u.station = s.station, LATERAL rings(s.slat, s.slon, 250D, 64) r"
    return spark.sql(text, used=used)


@query("distance_by_function", SQL["haversine"])
def distance_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT event_id, round(haversine_km(lat, lon, 25.6D, 84.5D), 6) AS km FROM {obs}", obs=views.v_obs(spark, sf_dir))


#: The window asked for: up to noon of the tenth day, a day and a half.
T, MINUTES = dt.datetime(2024, 1, 10, 12), 36 * 60
WINDOW_SQL = for_duckdb(f"SELECT event_id, modality, round(lat, 6) AS lat, round(lon, 6) AS lon, value FROM {{v_obs}} WHERE modality = 'radar' AND lat > 25.45D AND us > epoch_us(TIMESTAMP '{T}') - {MINUTES * 60000000} AND us <= epoch_us(TIMESTAMP '{T}')")


@query("frames_window", WINDOW_SQL)
def frames_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history window with a box, through the data source; time, source and box are filtered where the files are read."""
    seen = frames.history(frames.frames(spark, f"{sf_dir}/events.parquet"), T, MINUTES)
    return seen.where("modality = 'radar' AND lat > 25.45D").select("event_id", "modality", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "value")
