"""Adapter views: the driver's tables as observations, flashes, pixels, cells, forecasts, blocks and alerts.

Each view has a DataFrame form for Spark and the same arithmetic as SQL for DuckDB. Seconds are
compressed by 24, so that a month of events makes some thirty hours of ten-minute cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH_US = 1704067200000000
#: An event: so many ten-minute cycles of the views' clock.
EVENT_CYCLES = 36
MODALITIES = {"view": "radar", "click": "satellite", "purchase": "lightning", "signup": "surface", "error": "model"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations on a 10 x 10 grid: one row per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in MODALITIES.items()])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    i, j = (k / 10).cast("int"), k % 10
    s = (us - EPOCH_US) / 1e6 / 24
    return e.select("event_id", "user_id", (F.col("user_id") % 8).alias("station"), kind.alias("modality"), us.alias("us"), s.alias("s"), F.floor(s / 600).cast("long").alias("cycle"), i.alias("i"), j.alias("j"), (26.0 - 0.1 * i).alias("lat"), (84.0 + 0.1 * j).alias("lon"), "value")


def v_flash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightning; an event stands for one to five strokes."""
    return v_obs(spark, sf_dir).where("modality = 'lightning'").select("event_id", "s", "cycle", "lat", "lon", "i", "j", F.col("value").alias("energy"), (1 + F.col("event_id") % 5).alias("strokes"))


def v_pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily frame: the largest value of each pixel."""
    day = F.floor((F.col("us") - EPOCH_US) / 86400000000).cast("int")
    return v_obs(spark, sf_dir).groupBy(day.alias("frame"), "i", "j").agg(F.max("value").alias("value"))


def v_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm cells: radar pixels of a cycle whose largest value is 74 or more."""
    o = v_obs(spark, sf_dir).where("modality = 'radar'")
    return o.groupBy("cycle", "i", "j").agg(F.max("value").alias("intensity"), F.max("lat").alias("lat"), F.max("lon").alias("lon")).where("intensity >= 74")


def v_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks: one detection per user and six hours."""
    b = F.floor((F.col("us") - EPOCH_US) / 21600000000).cast("long")
    return v_obs(spark, sf_dir).groupBy(F.col("user_id").alias("track"), b.alias("b")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("value").alias("intensity"), F.count("*").alias("area"))


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast probabilities with outcomes and baselines, by run and lead."""
    l, p = table(spark, sf_dir, "lineitem"), (F.col("l_quantity") - 0.5) / 50
    return l.select((F.col("l_orderkey") % 4).alias("run"), (15 * (1 + F.col("l_linenumber") % 4)).cast("int").alias("lead"), ((F.col("l_quantity") - 0.5) / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p_climo"), (F.col("l_tax") * 10).alias("p_nwp"))


def v_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrative blocks: boxes on a lattice by nation, population from the balance."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    b = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    lat, lon = 24.0 + 0.4 * F.floor(F.col("n_nationkey") / 5), 84.0 + 0.4 * (F.col("n_nationkey") % 5)
    shift = (F.col("s_suppkey") % 4) * 0.1
    return b.select("s_suppkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("s_name").alias("block"), (lat + shift).alias("lat0"), (lat + shift + 0.1).alias("lat1"), (lon + shift).alias("lon0"), (lon + shift + 0.1).alias("lon1"), (F.abs("s_acctbal") * 100).cast("long").alias("population"))


def v_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert inputs by order: probability from the price, preset from the priority."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("cell"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 60000000).alias("minute"), F.least(F.col("o_totalprice") / 5e5, F.lit(1.0)).alias("p"), F.when(F.col("o_orderpriority").startswith("1"), "protective").otherwise("operational").alias("preset"))


VIEWS = {f.__name__: f for f in (v_obs, v_flash, v_pix, v_storm, v_cell, v_pred, v_block, v_alert)}

DUCK = {
    "v_obs": """SELECT event_id, user_id, user_id % 8 AS station, CASE event_type WHEN 'view' THEN 'radar' WHEN 'click' THEN 'satellite' WHEN 'purchase' THEN 'lightning' WHEN 'signup' THEN 'surface' WHEN 'error' THEN 'model' END AS modality,
      epoch_us(ts) AS us, (epoch_us(ts) - 1704067200000000) / 1e6 / 24 AS s, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 / 24 / 600) AS BIGINT) AS cycle,
      k // 10 AS i, k % 10 AS j, 26.0::DOUBLE - 0.1::DOUBLE * (k // 10) AS lat, 84.0::DOUBLE + 0.1::DOUBLE * (k % 10) AS lon, value FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
    "v_flash": "SELECT event_id, s, cycle, lat, lon, i, j, value AS energy, 1 + event_id % 5 AS strokes FROM v_obs WHERE modality = 'lightning'",
    "v_pix": "SELECT CAST(floor((us - 1704067200000000) / 86400000000) AS INT) AS frame, i, j, max(value) AS value FROM v_obs GROUP BY ALL",
    "v_storm": "SELECT cycle, i, j, max(value) AS intensity, max(lat) AS lat, max(lon) AS lon FROM v_obs WHERE modality = 'radar' GROUP BY cycle, i, j HAVING max(value) >= 74",
    "v_cell": "SELECT user_id AS track, CAST(floor((us - 1704067200000000) / 21600000000) AS BIGINT) AS b, avg(lat) AS lat, avg(lon) AS lon, max(value) AS intensity, count(*) AS area FROM v_obs GROUP BY ALL",
    "v_pred": "SELECT l_orderkey % 4 AS run, CAST(15 * (1 + l_linenumber % 4) AS INT) AS lead, p, CAST(l_returnflag = 'R' AS INT) AS y, l_discount * 10 AS p_climo, l_tax * 10 AS p_nwp FROM (SELECT *, (l_quantity - 0.5::DOUBLE) / 50 AS p FROM lineitem)",
    "v_block": """SELECT s_suppkey, r_name AS state, n_name AS district, s_name AS block, lat + shift AS lat0, lat + shift + 0.1::DOUBLE AS lat1, lon + shift AS lon0, lon + shift + 0.1::DOUBLE AS lon1, CAST(trunc(abs(s_acctbal) * 100) AS BIGINT) AS population
      FROM (SELECT *, 24.0::DOUBLE + 0.4::DOUBLE * (n_nationkey // 5) AS lat, 84.0::DOUBLE + 0.4::DOUBLE * (n_nationkey % 5) AS lon, (s_suppkey % 4) * 0.1::DOUBLE AS shift FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "v_alert": "SELECT o_orderkey, o_custkey AS cell, epoch_us(o_orderdate) / 60000000 AS minute, least(o_totalprice / 5e5, 1.0::DOUBLE) AS p, CASE WHEN o_orderpriority LIKE '1%' THEN 'protective' ELSE 'operational' END AS preset FROM orders",
}
