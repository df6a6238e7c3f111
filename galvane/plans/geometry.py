"""Storm cells and blocks as polygons.

The blocks' rings are made by rule from their boxes: corners cut off, a notch on the south side, and a
shift by the block's number. In DuckDB the overlap is not clipped but integrated: the area below each edge
within the box, signed by the edge's direction, so the two sides of a comparison share no formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galvane.operators import polygons
from galvane.plans.catalog import query
from galvane.plans.relational import for_duckdb
from galvane.sources import views

#: Corners: latitude above the box's south and multiples of the cut, then longitude likewise.
CORNERS = ((0.0, 1, 0.0, 0), (0.0, 0, 0.0, 1), (0.03, 0, 0.05, 0), (0.0, 0, 0.1, -1), (0.0, 1, 0.1, 0), (0.1, -1, 0.1, 0), (0.1, 0, 0.1, -1), (0.1, 0, 0.0, 1), (0.1, -1, 0.0, 0))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their rings."""
    b = views.v_block(spark, sf_dir)
    size, up, right = 0.02 + 0.01 * (F.col("s_suppkey") % 3), 0.037 * (F.col("s_suppkey") % 3 - 1), 0.023 * (F.col("s_suppkey") % 5 - 2)

    def corner(y: float, cy: int, x: float, cx: int) -> Column:
        return F.struct((F.col("lon0") + x + cx * size + right).alias("x"), (F.col("lat0") + y + cy * size + up).alias("y"))

    return b.select("s_suppkey", "state", "district", "block", "population", F.array(*[corner(*c) for c in CORNERS]).alias("ring"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm cells as boxes of their pixel, with their centre."""
    lat, lon = F.col("lat"), F.col("lon")
    return views.v_storm(spark, sf_dir).select("cycle", "i", "j", (lon - 0.05).alias("x0"), (lat - 0.05).alias("y0"), (lon + 0.05).alias("x1"), (lat + 0.05).alias("y1"), lon.alias("cx"), lat.alias("cy"))


SIDES = ", ".join("(" + ", ".join(f"{v}D" if isinstance(v, float) else str(v) for v in a + b) + ")" for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))
EDGES = f"""ring AS (SELECT b.s_suppkey, state, district, block, population, lon0 + xa + xb * c + r AS x1, lat0 + ya + yb * c + u AS y1, lon0 + xc + xd * c + r AS x2, lat0 + yc + yd * c + u AS y2
  FROM (SELECT *, 0.02D + 0.01D * (s_suppkey % 3) AS c, 0.037D * (s_suppkey % 3 - 1) AS u, 0.023D * (s_suppkey % 5 - 2) AS r FROM {{v_block}}) b, (VALUES {SIDES}) AS s(ya, yb, xa, xb, yc, yd, xc, xd)),
whole AS (SELECT s_suppkey, abs(sum(x1 * y2 - x2 * y1)) / 2 AS whole FROM ring GROUP BY s_suppkey)"""
# The area between the box's south side and an edge, over the edge's part of the box's width.
RISE = "CASE WHEN {y} <= s THEN 0D WHEN {y} >= n THEN pow(n - s, 2) / 2 + (n - s) * ({y} - n) ELSE pow({y} - s, 2) / 2 END"
UNDER = f"""CASE WHEN b <= a THEN 0D WHEN ya = yb THEN (least(greatest(ya, s), n) - s) * (b - a) ELSE ({RISE.format(y="yb")} - ({RISE.format(y="ya")})) / (yb - ya) * (b - a) END * CASE WHEN x1 < x2 THEN 1 ELSE -1 END"""
CLIPPED = f"""along AS (SELECT c.*, e.*, greatest(least(x1, x2), w) AS a, least(greatest(x1, x2), e) AS b FROM boxes c JOIN ring e ON true),
heights AS (SELECT *, CASE WHEN x1 = x2 THEN y1 ELSE y1 + (y2 - y1) * (a - x1) / (x2 - x1) END AS ya, CASE WHEN x1 = x2 THEN y1 ELSE y1 + (y2 - y1) * (b - x1) / (x2 - x1) END AS yb FROM along)"""

OVERLAP_SQL = for_duckdb(f"""WITH {EDGES}, boxes AS (SELECT cycle, i, j, lat, lon, lon - 0.05D AS w, lat - 0.05D AS s, lon + 0.05D AS e, lat + 0.05D AS n FROM {{v_storm}}), {CLIPPED},
met AS (SELECT cycle, i, j, h.s_suppkey, district, population, abs(sum({UNDER})) AS meet, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM heights h GROUP BY cycle, i, j, h.s_suppkey, district, population)
SELECT cycle, i, j, m.s_suppkey, district, round(meet / whole, 3) AS overlap_fraction, round(meet * 111.32D * 111.32D, 2) AS overlap_sqkm, inside, CAST(bround(population * least(1D, greatest(CASE WHEN inside THEN 0.15D ELSE 0.05D END, meet / whole)), 0) AS BIGINT) AS exposed_population
FROM met m JOIN whole w ON w.s_suppkey = m.s_suppkey WHERE meet / whole >= 0.1D OR inside""")


@query("polygon_overlap", OVERLAP_SQL)
def polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each storm with the blocks that it covers by a tenth or whose ring holds its centre."""
    found = polygons.overlaps(cells(spark, sf_dir), regions(spark, sf_dir))
    return found.select("box.cycle", "box.i", "box.j", "region.s_suppkey", "region.district", "overlap_fraction", "overlap_sqkm", "inside", "exposed_population")


#: The box asked for: west, south, east, north.
ASKED = (84.131, 24.142, 85.253, 24.857)
IN_BOX_SQL = for_duckdb(f"""WITH {EDGES}, boxes AS (SELECT {ASKED[0]}D AS w, {ASKED[1]}D AS s, {ASKED[2]}D AS e, {ASKED[3]}D AS n), {CLIPPED},
met AS (SELECT h.s_suppkey, state, district, block, abs(sum({UNDER})) AS meet FROM heights h GROUP BY h.s_suppkey, state, district, block)
SELECT s_suppkey, state, district, block, round(meet * 111.32D * 111.32D, 2) AS sqkm FROM met WHERE meet > 0.000000000001D""")


@query("polygons_in_box", IN_BOX_SQL)
def polygons_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose polygon meets a box, and how much of them lies in it."""
    box = spark.createDataFrame([ASKED], "x0 double, y0 double, x1 double, y1 double")
    met = polygons.meetings(box, regions(spark, sf_dir))
    return met.select("region.s_suppkey", "region.state", "region.district", "region.block", F.round(polygons.area(F.col("ring")) * polygons.KM_PER_DEGREE**2, 2).alias("sqkm"))
