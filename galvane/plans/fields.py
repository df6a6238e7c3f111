"""probability fields with motion, plumes of initiation and smoothing; P4, G4: map projections and regridding.

Statements are shared by Spark SQL and DuckDB, as in relational.py; clusters of initiation come from their query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galvane.operators.ranks import stored
from galvane.plans import stateful  # noqa: F401
from galvane.plans.catalog import QUERIES, SQL, query
from galvane.plans.nowcast import smoothed
from galvane.plans.relational import duck_words, for_duckdb, relational
from galvane.sources import views

LINE = "line AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(k))"
NEAR = "near AS (SELECT a.o AS di, b.o AS dj FROM (VALUES (-2), (-1), (0), (1), (2)) AS a(o), (VALUES (-2), (-1), (0), (1), (2)) AS b(o))"
# A storm's motion in pixels a cycle: from the nearest storm of the cycle before within two pixels, the first in row-major order of equals.
MOVED = f"""{NEAR}, st AS (SELECT cycle, i, j, intensity FROM {{v_storm}}),
from_ AS (SELECT a.cycle, a.i, a.j, a.intensity, -di AS my, -dj AS mx, row_number() OVER (PARTITION BY a.cycle, a.i, a.j ORDER BY CASE WHEN b.cycle IS NULL THEN 1 ELSE 0 END, di * di + dj * dj, di, dj) AS k
  FROM (SELECT st.*, di, dj, cycle - 1 AS was, i + di AS wi, j + dj AS wj FROM st, near) a LEFT JOIN st b ON b.cycle = a.was AND b.i = a.wi AND b.j = a.wj),
storms AS (SELECT f.cycle, f.i, f.j, least(f.intensity / 250, 0.98D) AS p, CASE WHEN b.cycle IS NULL THEN 0D ELSE f.mx * 1D END AS mx, CASE WHEN b.cycle IS NULL THEN 0D ELSE f.my * 1D END AS my
  FROM from_ f LEFT JOIN st b ON b.cycle = f.cycle - 1 AND b.i = f.i - f.my AND b.j = f.j - f.mx WHERE f.k = 1)"""
BACKGROUND = 0.05
# Kernels of storms above the background, 2.5 times as long downwind; their union; plumes of clusters whose lead is within 20 minutes, by maximum.
UNION = f"""{LINE}, {MOVED}, grid AS (SELECT c.cycle, a.k AS i, b.k AS j FROM (SELECT DISTINCT cycle FROM storms) c CROSS JOIN line a CROSS JOIN line b),
g AS (SELECT g.cycle, g.i, g.j, s.p, (g.j - s.j) AS dx, (g.i - s.i) AS dy, s.mx, s.my, sqrt(s.mx * s.mx + s.my * s.my) AS speed FROM grid g JOIN storms s ON s.cycle = g.cycle AND s.p > {BACKGROUND}D),
k AS (SELECT cycle, i, j, p * exp(-0.5D * CASE WHEN speed > 0.001D THEN pow((dx * mx + dy * my) / speed / CASE WHEN (dx * mx + dy * my) > 0 THEN 3.75D ELSE 1.5D END, 2) + pow((-dx * my + dy * mx) / speed / 1.5D, 2) ELSE (dx * dx + dy * dy) / 2.25D END) AS k FROM g),
u AS (SELECT cycle, i, j, 1 - (1 - {BACKGROUND}D) * exp(sum(ln(1 - least(k, 0.999D)))) AS p FROM k GROUP BY cycle, i, j)"""
PLUMED = f"""pl AS (SELECT CAST(frame AS BIGINT) AS frame, ci, cj, p * exp(-0.5D * pow(abs(lead - 30) / 15D, 2)) AS top, greatest(1.5D, sqrt(greatest(10D, area) / (pi() * 100))) AS r FROM clusters WHERE abs(lead - 30) <= 20),
px AS (SELECT u.cycle, u.i, u.j, greatest(u.p, coalesce(max(top * exp(-0.5D * (pow((u.i - ci) / r, 2) + pow((u.j - cj) / r, 2)))), 0D)) AS v FROM (SELECT *, CAST(floor(cycle / 6) AS BIGINT) AS frame FROM u) u LEFT JOIN pl ON pl.frame = u.frame GROUP BY u.cycle, u.i, u.j, u.p),
{smoothed("px", "cycle", out="even")}, field AS (SELECT cycle, i, j, least(greatest(v, 0D), 1D) AS p FROM even)"""
FIELD = f"WITH {UNION}, {PLUMED} SELECT cycle, i, j, round(p, 6) AS p FROM field"


def with_clusters(name: str, text: str) -> None:
    """Register a statement over the views and `clusters`, the clusters of initiation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(QUERIES["initiation_clusters"](spark, sf_dir))
        return spark.sql(text.replace("FROM clusters", "FROM {clusters}"), clusters=found, v_storm=views.v_storm(spark, sf_dir))

    run.__name__ = name
    own = f"(SELECT * FROM ({SQL['initiation_clusters']}) q)"
    QUERIES[name], SQL[name] = run, for_duckdb(text).replace("FROM clusters", f"FROM {own} clusters")


with_clusters("probability_field", FIELD)

# beyond an hour: the field moved on by the mean motion (a cycle is ten minutes, steps are fifteen), decayed towards the background and spread.
AHEAD = f"""WITH {UNION}, {PLUMED},
leads AS (SELECT * FROM (VALUES (90, 2D), (120, 4D)) AS t(lead, steps)), drift AS (SELECT cycle, avg(mx) * 1.5D AS mx, avg(my) * 1.5D AS my FROM storms GROUP BY cycle),
moved AS (SELECT f.cycle * 1000 + lead AS run, f.i, f.j, f.cycle, lead, steps, f.i - CAST(bround(my * steps, 0) AS INT) AS si, f.j - CAST(bround(mx * steps, 0) AS INT) AS sj FROM field f JOIN drift d ON d.cycle = f.cycle CROSS JOIN leads),
spread AS (SELECT m.run, m.i, m.j, {BACKGROUND}D + (coalesce(f.p, 0D) - {BACKGROUND}D) * exp(-15 * steps / 45D) AS v FROM moved m LEFT JOIN field f ON f.cycle = m.cycle AND f.i = m.si AND f.j = m.sj),
{smoothed("spread", "run", 3)}
SELECT CAST(floor(run / 1000) AS BIGINT) AS cycle, CAST(run % 1000 AS INT) AS lead, i, j, round(least(greatest(v, 0D), 1D), 6) AS p FROM b2"""
with_clusters("lagrangian_120", AHEAD)

# plumes carried by the day's mean motion for the time up to the lead asked for (six cycles are a day's hour), within 25 minutes of their own.
CARRIED = f"""WITH {MOVED}, drift AS (SELECT CAST(floor(cycle / 6) AS BIGINT) AS frame, avg(mx) AS mx, avg(my) AS my FROM storms GROUP BY 1), {LINE}, leads AS (SELECT * FROM (VALUES (15), (30), (45), (60)) AS t(lead)),
c AS (SELECT CAST(c.frame AS BIGINT) AS frame, l.lead, c.ci + coalesce(my, 0D) * l.lead / 10D AS ci, c.cj + coalesce(mx, 0D) * l.lead / 10D AS cj, c.p * exp(-0.5D * pow((c.lead - l.lead) / 15D, 2)) AS top, greatest(1.5D, sqrt(greatest(10D, area) / (pi() * 100))) AS r
  FROM (SELECT * FROM clusters) c CROSS JOIN leads l LEFT JOIN drift d ON d.frame = c.frame WHERE abs(c.lead - l.lead) <= 25)
SELECT frame, lead, a.k AS i, b.k AS j, round(1 - exp(sum(ln(1 - least(top * exp(-0.5D * (pow((a.k - ci) / r, 2) + pow((b.k - cj) / r, 2))), 0.999D)))), 6) AS prob FROM c CROSS JOIN line a CROSS JOIN line b GROUP BY frame, lead, a.k, b.k"""
with_clusters("initiation_plumes", CARRIED)

# The equal-area projection (origin 25 N, 84.5 E, sphere of 6371 km) and its inverse, there and back.
TO_KM = """f AS (SELECT event_id, lat, lon, 6371 * k * cos(radians(lat)) * sin(radians(lon - 84.5D)) AS x, 6371 * k * (cos(radians(25D)) * sin(radians(lat)) - sin(radians(25D)) * cos(radians(lat)) * cos(radians(lon - 84.5D))) AS y
  FROM (SELECT event_id, lat, lon, sqrt(2 / (1 + sin(radians(25D)) * sin(radians(lat)) + cos(radians(25D)) * cos(radians(lat)) * cos(radians(lon - 84.5D)))) AS k FROM {v_obs}) o)"""
FROM_KM = """SELECT *, CASE WHEN rho < 0.000000001D THEN 25D ELSE degrees(asin(cos(c) * sin(radians(25D)) + y * sin(c) * cos(radians(25D)) / rho)) END AS lat_b, CASE WHEN rho < 0.000000001D THEN 84.5D ELSE 84.5D + degrees(atan2(x * sin(c), rho * cos(radians(25D)) * cos(c) - y * sin(radians(25D)) * sin(c))) END AS lon_b
  FROM (SELECT *, sqrt(x * x + y * y) AS rho, 2 * asin(sqrt(x * x + y * y) / 12742) AS c FROM {source}) z"""
relational("equal_area_back", f"WITH {TO_KM}, b AS ({FROM_KM.replace('{source}', 'f')}) SELECT event_id, round(x, 5) + 0D AS x_km, round(y, 5) + 0D AS y_km, round(lat_b, 7) AS lat, round(lon_b, 7) AS lon, CASE WHEN abs(lat_b - lat) < 0.000000001D AND abs(lon_b - lon) < 0.000000001D THEN 1 ELSE 0 END AS back FROM b")

# Each frame on a grid of 9 km in the projection: a point's four neighbours weighed bilinearly; outside the pixels there is nothing, and the
# weights of absent pixels go to those that are there.
TARGET = "target AS (SELECT a.k * 12 + b.k AS cell, (a.k - 4) * 9D AS x, (b.k + 3) * 9D AS y FROM line a, line b)"
relational("regrid_equal_area", f"""
WITH {LINE}, {TARGET}, t AS ({FROM_KM.replace('{source}', 'target')}), placed AS (SELECT cell, x, y, (26D - lat_b) / 0.1D AS fi, (lon_b - 84D) / 0.1D AS fj FROM t),
w AS (SELECT cell, x, y, CAST(floor(fi) AS INT) + d.o AS i, CAST(floor(fj) AS INT) + e.o AS j, (CASE WHEN d.o = 0 THEN 1 - (fi - floor(fi)) ELSE fi - floor(fi) END) * (CASE WHEN e.o = 0 THEN 1 - (fj - floor(fj)) ELSE fj - floor(fj) END) AS w
  FROM placed, (VALUES (0), (1)) AS d(o), (VALUES (0), (1)) AS e(o) WHERE fi BETWEEN 0 AND 9 AND fj BETWEEN 0 AND 9)
SELECT p.frame, w.x, w.y, round(sum(w * value) / sum(w), 6) AS value FROM w JOIN {{v_pix}} p ON p.i = w.i AND p.j = w.j WHERE w > 0.000000000001D GROUP BY p.frame, w.x, w.y""")
