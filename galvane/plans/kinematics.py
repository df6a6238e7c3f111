"""Filtered tracks and what follows from their state; as-of joins in blocks of time.

In DuckDB the filter is a recursive query, a step a row; the as-of joins there are one window over each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from galvane.operators import asof, motion
from galvane.plans.catalog import query
from galvane.plans.relational import for_duckdb
from galvane.sources import views

#: A pixel's square kilometres.
PIXEL_KM2 = (0.1 * motion.KM_PER_DEGREE) ** 2


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's detections with the filter's state."""
    rows = views.v_cell(spark, sf_dir).select("track", "b", (F.col("b") * 6.0).alias("hours"), "lat", "lon", "area")
    return motion.filtered(rows, "track", "hours", "lat", "lon")


FILTER = f"""d AS (SELECT track, b, b * 6D AS t, lat, lon, area, row_number() OVER (PARTITION BY track ORDER BY b) AS k FROM {{v_cell}}),
f AS (SELECT track, b, t, lat, lon, area, k, lat AS x, lon AS y, 0D AS u, 0D AS v, pow(0.01D, 2) AS a, 0D AS q, 1D AS c FROM d WHERE k = 1
  UNION ALL SELECT track, b, t, lat, lon, area, k, x + a / (a + r) * (lat - x), y + a / (a + r) * (lon - y), u + q / (a + r) * (lat - x), v + q / (a + r) * (lon - y), (1 - a / (a + r)) * a, (1 - a / (a + r)) * q, c - q / (a + r) * q
  FROM (SELECT d.*, f.x + h * f.u AS x, f.y + h * f.v AS y, f.u, f.v, f.a + 2 * h * f.q + h * h * f.c + 0.8D * h * h * h / 3 AS a, f.q + h * f.c + 0.8D * h * h / 2 AS q, f.c + 0.8D * h AS c, pow(0.005D, 2) AS r
    FROM (SELECT f.*, 0 + greatest(d.t - f.t, 0.0001D) AS h FROM f JOIN d ON d.track = f.track AND d.k = f.k + 1) f JOIN d ON d.track = f.track AND d.k = f.k + 1) p),
s AS (SELECT *, v * 111.32D * cos(radians(x)) AS east, u * 111.32D AS north FROM f), w AS (SELECT *, sqrt(east * east + north * north) AS speed FROM s)"""


def recursive(text: str) -> str:
    return for_duckdb(f"WITH {FILTER} {text}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("kalman_tracks", recursive("SELECT track, b, k - 1 AS age, round(x, 6) AS lat, round(y, 6) AS lon, round(speed, 1) AS velocity_kmh, round(CASE WHEN speed < 0.5D THEN 0D WHEN atan2(east, north) < 0 THEN degrees(atan2(east, north)) + 360 ELSE degrees(atan2(east, north)) END, 1) AS heading FROM w"))
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered place, speed and heading."""
    age = F.row_number().over(Window.partitionBy("track").orderBy("b")) - 1
    return tracks(spark, sf_dir).select("track", "b", age.cast("long").alias("age"), F.round("f_lat", 6).alias("lat"), F.round("f_lon", 6).alias("lon"), F.round(motion.speed(), 1).alias("velocity_kmh"), F.round(motion.heading(), 1).alias("heading"))


@query("kalman_path", recursive("SELECT track, b, lead, round(x + u * (lead / 60D), 4) AS lat, round(y + v * (lead / 60D), 4) AS lon FROM w, (VALUES (15), (30), (45), (60)) AS l(lead)"))
def kalman_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places ahead."""
    found = tracks(spark, sf_dir).select("track", "b", F.posexplode(motion.path()).alias("n", "at"))
    return found.select("track", "b", F.array(*map(F.lit, motion.LEADS))[F.col("n")].alias("lead"), "at.lat", "at.lon")


CONE = recursive("""SELECT track, b, n AS k, round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT track, b, n, CASE WHEN speed < 1 THEN x + (base + 19.74D) / 111.32D * sin(2 * pi() * n / 16) WHEN m < 0 THEN ex + er * cos(atan2(east, north) + pi() / 2 - pi() * (n - 4) / 6) / 111.32D
  ELSE x + u * h + side * (east / speed * rad) / 111.32D END AS lat, CASE WHEN speed < 1 THEN y + (base + 19.74D) / (111.32D * greatest(cos(radians(x)), 0.0001D)) * cos(2 * pi() * n / 16) WHEN m < 0 THEN ey + er * sin(atan2(east, north) + pi() / 2 - pi() * (n - 4) / 6) / (111.32D * greatest(cos(radians(ex)), 0.0001D))
  ELSE y + v * h + side * (-north / speed * rad) / (111.32D * greatest(cos(radians(x + u * h)), 0.0001D)) END AS lon
FROM (SELECT *, x + u AS ex, y + v AS ey, base + 19.74D AS er, greatest(m, 0) / 60D AS h, base + 19.74D * greatest(m, 0) / 60D AS rad FROM (SELECT w.*, n, greatest(8D, sqrt(area * pow(0.1D * 111.32D, 2) / pi())) AS base, CASE WHEN n <= 4 THEN n * 15 WHEN n <= 9 THEN -1 WHEN n <= 14 THEN (14 - n) * 15 ELSE 0 END AS m, CASE WHEN n <= 4 OR n = 15 THEN 1 ELSE -1 END AS side
  FROM w, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16)) AS l(n) WHERE n <= 15 OR speed < 1) r) z) o""")


@query("kalman_cone", CONE)
def kalman_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the region of 90 % over the next hour, around a storm of its own size."""
    ring = motion.cone(motion.base_radius(F.col("area"), PIXEL_KM2))
    return tracks(spark, sf_dir).select("track", "b", F.posexplode(ring).alias("k", "at")).select("track", "b", "k", "at.lat", "at.lon")


@query("kalman_acceleration", recursive("""SELECT track, b, round(CASE WHEN k < 3 THEN 0D ELSE ax END, 2) AS accel_x, round(CASE WHEN k < 3 THEN 0D ELSE ay END, 2) AS accel_y, round(CASE WHEN k < 3 THEN 0D ELSE sqrt(ax * ax + ay * ay) END, 2) AS accel
FROM (SELECT *, (v - lag(v) OVER o) / greatest(t - lag(t) OVER o, 0.0001D) * 111.32D * greatest(cos(radians(lat)), 0.1D) AS ax, (u - lag(u) OVER o) / greatest(t - lag(t) OVER o, 0.0001D) * 111.32D AS ay FROM w WINDOW o AS (PARTITION BY track ORDER BY b)) z"""))
def kalman_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of the filter's velocity."""
    found = motion.accelerated(tracks(spark, sf_dir), "track", "hours", "lat")
    return found.select("track", "b", *[F.round(c, 2).alias(c) for c in ("accel_x", "accel_y", "accel")])


#: Fixed sizes of the blocks of time: an event in seconds, a fortnight in six-hour steps.
EVENT_S, STEPS = views.EVENT_CYCLES * 600.0, 56

NWP_SQL = for_duckdb("""WITH vars AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(var)),
u AS (SELECT i, j, station % 4 AS var, s AS t, 0 AS kind, event_id AS id, value AS m, CAST(NULL AS BIGINT) AS cycle FROM {v_obs} WHERE modality = 'model'
  UNION ALL SELECT i, j, var, (cycle + 1) * 600D, 1, cycle, NULL, cycle FROM {v_storm}, vars),
k AS (SELECT *, count(m) OVER (PARTITION BY i, j, var ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM u),
w AS (SELECT *, max(m) OVER (PARTITION BY i, j, var, k) AS newest FROM k)
SELECT cycle, i, j, max(CASE WHEN var = 0 THEN newest * 10 END) AS cape, max(CASE WHEN var = 1 THEN newest END) AS cin, max(CASE WHEN var = 2 THEN newest / 10 END) AS shear, max(CASE WHEN var = 3 THEN newest / 5 END) AS rh FROM w WHERE cycle IS NOT NULL GROUP BY cycle, i, j""")


@query("nwp_asof", NWP_SQL)
def nwp_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable the newest value of the pixel up to the cycle's end."""
    told = views.v_obs(spark, sf_dir).where("modality = 'model' AND value IS NOT NULL").select("i", "j", (F.col("station") % 4).alias("var"), F.col("s").alias("t"), "event_id", "value")
    asked = views.v_storm(spark, sf_dir).select("i", "j", F.explode(F.expr("sequence(0L, 3L)")).alias("var"), ((F.col("cycle") + 1) * 600.0).alias("t"), "cycle")
    found = asof.latest(asked, told.withColumn("var", F.col("var").cast("long")), ["i", "j", "var"], "t", ["value"], EVENT_S, ["event_id"])
    of = lambda var, scale: F.max(F.when(F.col("var") == var, F.col("value") * scale))
    over = lambda var, by: F.max(F.when(F.col("var") == var, F.col("value") / by))
    return found.groupBy("cycle", "i", "j").agg(of(0, 10).alias("cape"), of(1, 1).alias("cin"), over(2, 10).alias("shear"), over(3, 5).alias("rh"))


CYCLE_SQL = for_duckdb("""WITH m AS (SELECT station % 4 AS var, cycle, avg(value) AS mean FROM {v_obs} WHERE modality = 'model' GROUP BY station % 4, cycle), vars AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(var)), asked AS (SELECT DISTINCT cycle AS t FROM {v_storm})
SELECT a.t, v.var, max(m.cycle) AS cycle, round(max_by(m.mean, m.cycle), 6) AS value, max(m.cycle) > a.t - 72 AS within FROM asked a CROSS JOIN vars v LEFT JOIN m ON m.var = v.var AND m.cycle <= a.t GROUP BY a.t, v.var""")


@query("model_cycle", CYCLE_SQL)
def model_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model cycle that serves each time asked for: the newest of the last 720 minutes, else the nearest before, however old."""
    var = (F.col("station") % 4).cast("long").alias("var")
    told = views.v_obs(spark, sf_dir).where("modality = 'model'").groupBy(var, F.col("cycle").alias("t")).agg(F.avg("value").alias("mean")).withColumn("cycle", F.col("t"))
    asked = views.v_storm(spark, sf_dir).select(F.col("cycle").alias("t")).distinct().withColumn("var", F.explode(F.expr("sequence(0L, 3L)"))).withColumn("asked", F.col("t"))
    found = asof.latest(asked, told, ["var"], "t", ["cycle", "mean"], views.EVENT_CYCLES)
    return found.select("t", "var", "cycle", F.round("mean", 6).alias("value"), (F.col("cycle") > F.col("t") - 72).alias("within"))


OLDER_SQL = for_duckdb("""WITH x AS (SELECT track, b, area FROM {v_cell}), u AS (SELECT track, b AS t, 0 AS kind, b, area, area AS known FROM x UNION ALL SELECT track, b - 2, 1, b, area, NULL FROM x),
k AS (SELECT *, count(known) OVER (PARTITION BY track ORDER BY t, kind, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM u),
w AS (SELECT *, max(known) OVER (PARTITION BY track, k) AS older FROM k)
SELECT track, b, area, CASE WHEN k > 0 THEN older END AS older, CASE WHEN k > 0 THEN area - older END AS growth FROM w WHERE kind = 1""")


@query("growth_older", OLDER_SQL)
def growth_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest older detection of at least two steps before."""
    x = views.v_cell(spark, sf_dir).select("track", "b", "area")
    asked, told = x.select("track", (F.col("b") - 2).alias("t"), "b", "area"), x.select("track", F.col("b").alias("t"), F.col("area").alias("older"))
    found = asof.latest(asked, told, ["track"], "t", ["older"], STEPS)
    return found.select("track", "b", "area", "older", (F.col("area") - F.col("older")).alias("growth"))
