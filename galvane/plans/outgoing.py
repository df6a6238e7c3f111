"""Features, feeds, documents and colours that leave the package, and what they show.

A GeoJSON feature is a row, so any number of them is written in parallel; only what is small by its nature (a
bulletin, a scorecard, a feed of twenty) is put together into one document. Spark builds JSON from structs, DuckDB from its own functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from galvane.operators import tiles
from galvane.operators.ranks import stored
from galvane.plans import baselines, bulletins, nowcast, products, stateful  # noqa: F401
from galvane.plans.bulletins import NAMED, SENT
from galvane.plans.catalog import QUERIES, SQL, query
from galvane.plans.nowcast import CRITERIA, TWO_PLACES
from galvane.plans.relational import duck_words, for_duckdb, relational
from galvane.sources import views

def places(x: str, n: int) -> str:
    """x to n places, half up, alike in both engines: what sums leave behind the ninth place does not decide a tie."""
    return f"floor(round({x}, 9) * {10**n} + 0.5D) / {10**n}"


WHOLE = {"ignoreNullFields": "false"}


def feature(kind: str, coordinates: Column, properties: Mapping[str, Column]) -> Column:
    """A GeoJSON feature as text; nulls among the properties stay."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")), WHOLE)


def duck_feature(kind: str, coordinates: str, properties: Mapping[str, str]) -> str:
    pairs = ", ".join(f"'{k}', {v}" for k, v in properties.items())
    return f"CAST(json_object('type', 'Feature', 'geometry', json_object('type', '{kind}', 'coordinates', {coordinates}), 'properties', json_object({pairs})) AS VARCHAR)"


CORNERS = ("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")
DUCK_BOXED = f"[[{', '.join(f'[{x}, {y}]' for x, y in CORNERS)}]]"


def outline() -> Column:
    """The box of a row as a polygon's coordinates."""
    return F.array(F.array(*[F.array(F.col(x), F.col(y)) for x, y in CORNERS]))


def boxed(rows: DataFrame, i0: str, i1: str, j0: str, j1: str, margin: float = 0.0) -> DataFrame:
    """rows with the degrees that pixels i0 to i1 and j0 to j1 span."""
    edge = lambda base, step, c, m: F.round(F.lit(base) + F.lit(step) * F.col(c) + m, 4)
    return rows.withColumns({"north": edge(26.0, -0.1, i0, margin), "south": edge(26.0, -0.1, i1, -margin), "west": edge(84.0, 0.1, j0, -margin), "east": edge(84.0, 0.1, j1, margin)})


def duck_boxed(i0: str, i1: str, j0: str, j1: str, margin: float = 0.0) -> str:
    return f"round(26D - 0.1D * {i0} + {margin}D, 4) AS north, round(26D - 0.1D * {i1} - {margin}D, 4) AS south, round(84D + 0.1D * {j0} - {margin}D, 4) AS west, round(84D + 0.1D * {j1} + {margin}D, 4) AS east"


STORM = {"cell_id": "i * 10 + j", "max_intensity": "round(intensity, 2)", "flash_history": "{array}(f10, f20, f30)", "centroid_lat": "round((north + south) / 2, 4)", "centroid_lon": "round((west + east) / 2, 4)"}


@query("geojson_storms", f"SELECT cycle, i, j, {duck_feature('Polygon', DUCK_BOXED, {k: v.format(array='json_array') for k, v in STORM.items()})} AS feature FROM (SELECT *, {duck_words(duck_boxed('i', 'i', 'j', 'j', 0.05))} FROM ({SQL['flash_counts_10_20_30']}) q) b")
def geojson_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: each storm cell as a polygon with its flashes of 10, 20 and 30 minutes."""
    rows = boxed(QUERIES["flash_counts_10_20_30"](spark, sf_dir), "i", "i", "j", "j", 0.05)
    return rows.select("cycle", "i", "j", feature("Polygon", outline(), {k: F.expr(v.format(array="array")) for k, v in STORM.items()}).alias("feature"))


#: Clusters below this area in square kilometres count only with two pixels or more.
LEAST_KM2 = 15
FOOTPRINT = {"p_initiation": places("p", 3), "estimated_lead_min": "lead", "cooling_rate_k_per_15m": places("cooling", 2), "pixels": "pixels", "area_km2": places("area", 1)}


@query("geojson_initiation", f"SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY p DESC, label) AS INT) AS place, {duck_words(duck_feature('Polygon', DUCK_BOXED, FOOTPRINT))} AS feature FROM (SELECT *, {duck_words(duck_boxed('i0', 'i1', 'j0', 'j1'))} FROM ({SQL['initiation_clusters']}) q WHERE area >= {LEAST_KM2} OR pixels >= 2) b")
def geojson_initiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's footprint with its place in its frame by probability; small single pixels are left out."""
    rows = boxed(QUERIES["initiation_clusters"](spark, sf_dir).where((F.col("area") >= LEAST_KM2) | (F.col("pixels") >= 2)), "i0", "i1", "j0", "j1")
    place = F.expr("row_number() OVER (PARTITION BY frame ORDER BY p DESC, label)")
    return rows.select("frame", place.alias("place"), feature("Polygon", outline(), {k: F.expr(v) for k, v in FOOTPRINT.items()}).alias("feature"))


def points(flashes: DataFrame, properties: Mapping[str, Column]) -> DataFrame:
    """event_id, feature: each flash as a point."""
    return flashes.select("event_id", feature("Point", F.array(F.round("lon", 4), F.round("lat", 4)), properties).alias("feature"))


DUCK_POINT = "json_array(round(lon, 4), round(lat, 4))"


@query("geojson_flashes", for_duckdb(f"SELECT event_id, {duck_feature('Point', DUCK_POINT, {'t': 'round(s, 3)', 'energy': 'energy', 'mode': chr(39) + 'REPLAY' + chr(39)})} AS feature FROM {{v_flash}}"))
def geojson_flashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: every flash, with its time and the mode that it is shown in."""
    return points(views.v_flash(spark, sf_dir), {"t": F.round("s", 3), "energy": F.col("energy"), "mode": F.lit("REPLAY")})


@query("geojson_recent", for_duckdb(f"WITH n AS (SELECT max(s) AS now FROM {{v_flash}}) SELECT event_id, {duck_feature('Point', DUCK_POINT, {'energy_uj': 'energy', 'time_epoch': 'round(s, 3)', 'sensor': chr(39) + 'ORBIT' + chr(39)})} AS feature FROM {{v_flash}}, n WHERE s > now - 7200"))
def geojson_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: flashes of the last two hours as an orbiting sensor's."""
    flashes = views.v_flash(spark, sf_dir)
    now = flashes.agg(F.max("s").alias("now"))
    recent = flashes.crossJoin(F.broadcast(now)).where("s > now - 7200")
    return points(recent, {"energy_uj": F.col("energy"), "time_epoch": F.round("s", 3), "sensor": F.lit("ORBIT")})


@query("geojson_rings", f"WITH q AS ({SQL['range_rings']}) SELECT station, {duck_feature('Polygon', 'json_array(list_concat(list([lon, lat] ORDER BY n), list([lon, lat] ORDER BY n)[1:1]))', {'station': 'station', 'range_km': '250'})} AS feature FROM q GROUP BY station")
def geojson_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range ring of each station, closed; a ring has 64 points."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("n", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    rows = QUERIES["range_rings"](spark, sf_dir).groupBy("station").agg(ring.alias("ring"))
    return rows.select("station", feature("Polygon", F.array(F.concat("ring", F.slice("ring", 1, 1))), {"station": F.col("station"), "range_km": F.lit(250)}).alias("feature"))


def blocks_of(blocks: DataFrame, district: str | None = None) -> DataFrame:
    """s_suppkey, feature of blocks (v_block); of one district in any case of letters, if given."""
    kept = blocks if district is None else blocks.where(F.lower("district") == district.lower())
    box = kept.select("*", *[F.round(c, 4).alias(n) for c, n in (("lat0", "south"), ("lat1", "north"), ("lon0", "west"), ("lon1", "east"))])
    return box.select("s_suppkey", feature("Polygon", outline(), {c: F.col(c) for c in ("block", "district", "state", "population")}).alias("feature"))


@query("geojson_district", for_duckdb(f"SELECT s_suppkey, {duck_feature('Polygon', DUCK_BOXED, {c: c for c in ('block', 'district', 'state', 'population')})} AS feature FROM (SELECT *, round(lat0, 4) AS south, round(lat1, 4) AS north, round(lon0, 4) AS west, round(lon1, 4) AS east FROM {{v_block}}) b WHERE lower(district) = 'nation_12'"))
def geojson_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the blocks of a district asked for in other letters."""
    return blocks_of(views.v_block(spark, sf_dir), "NaTiOn_12")


# Satellite clusters: 4-connected, three pixels or more, with a confidence from cooling and depth.
PRECURSOR = "ir BETWEEN 180 AND 273.15D AND cooling <= -4 AND ir_wv >= -5"
PRECURSORS = f"WITH {CRITERIA} SELECT frame, i, j, ir, cooling, ir_wv FROM px WHERE {PRECURSOR}"
CLUSTERED = f"""SELECT frame, label, count(*) AS area_px, {places("26D - 0.1D * avg(i)", 3)} AS lat, {places("84D + 0.1D * avg(j)", 3)} AS lon, {places("min(ir)", 1)} AS ir, {places("avg(cooling)", 2)} AS cooling, {places("avg(ir_wv)", 2)} AS ir_wv,
  round(least(1D, 0.4D + 0.1D * abs(avg(cooling)) / 4 + CASE WHEN avg(ir_wv) >= -2 THEN 0.2D ELSE 0D END), 6) AS confidence FROM {{m}} GROUP BY frame, label HAVING count(*) >= 3"""
_mask = for_duckdb(PRECURSORS)


@query("satellite_clusters", f"WITH m AS (SELECT l.label, x.* FROM ({stateful.cc_sql(_mask)}) l JOIN ({_mask}) x ON x.frame = l.frame AND x.i = l.i AND x.j = l.j) {duck_words(CLUSTERED.format(m='m'))}")
def satellite_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are made in tiles and united at their borders."""
    pixels = stored(spark.sql(PRECURSORS, **{v: views.VIEWS[v](spark, sf_dir) for v in ("v_pix", "v_storm")}))
    return spark.sql(CLUSTERED, m=tiles.labelled(pixels).join(pixels, ["frame", "i", "j"]))


# F8: colours of a pixel: probability by risk band, an observation in grey, an echo by its ramp, uncertainty.
# Lower bound, red, green, blue, alpha.
BANDS = "(0D, 0.2D, 59, 130, 246, 0), (0.2D, 0.2D, 250, 204, 21, 110), (0.4D, 0.2D, 249, 115, 22, 140), (0.6D, 0.2D, 239, 68, 68, 170), (0.8D, 0.2001D, 168, 0, 230, 200)"
RAMP = "(-1000D, 0, 0, 0, 0), (5D, 100, 181, 246, 120), (15D, 30, 136, 229, 140), (25D, 67, 160, 71, 160), (35D, 124, 179, 66, 180), (40D, 253, 216, 53, 200), (45D, 251, 140, 0, 215), (50D, 229, 57, 53, 230), (55D, 183, 28, 28, 240), (60D, 216, 27, 96, 250), (65D, 142, 36, 170, 255)"
BYTE = "CAST(floor({x}) AS INT)"
CLIP = "least(greatest({x}, 0D), 1D)"
relational("render_probability", f"""WITH bands AS (SELECT *, lead(low, 1, 2D) OVER (ORDER BY low) AS high FROM (VALUES {BANDS}) AS t(low, width, r, g, b, a)), x AS (SELECT frame, i, j, {CLIP.format(x="coalesce(value, 0D) / 500")} AS p FROM {{v_pix}})
SELECT frame, i, j, r, g, b, {BYTE.format(x="a * (0.6D + 0.4D * least((p - low) / width, 1D))")} AS a FROM x JOIN bands ON p >= low AND p < high""")
relational("render_gray", f"SELECT frame, i, j, {BYTE.format(x=CLIP.format(x='coalesce(value, 0D) / 500') + ' * 255')} AS gray, 165 AS a FROM {{v_pix}}")
relational("render_reflectivity", f"""WITH ramp AS (SELECT *, lead(low, 1, 1000000D) OVER (ORDER BY low) AS high FROM (VALUES {RAMP}) AS t(low, r, g, b, a)), x AS (SELECT cycle, i, j, intensity / 6 AS dbz FROM {{v_storm}})
SELECT cycle, i, j, r, g, b, a FROM x JOIN ramp ON dbz >= low AND dbz < high""")
_hues = {"r": ("(sigma - 0.2D) / 0.8D", 220), "g": ("1 - abs(sigma - 0.5D) * 2", 180), "b": ("(0.8D - sigma) / 0.8D", 240), "a": ("(sigma - 0.1D) / 0.9D", 160)}
HUES = ", ".join(f"{BYTE.format(x=CLIP.format(x=x) + f' * {top}')} AS {c}" for c, (x, top) in _hues.items())


@query("render_uncertainty", f"SELECT frame, i, j, lead, {duck_words(HUES)} FROM ({SQL['uncertainty_terms']}) q")
def render_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT frame, i, j, lead, {HUES} FROM {{sigma}}", sigma=QUERIES["uncertainty_terms"](spark, sf_dir))


def calibrated(scores: DataFrame, knots: DataFrame, method: str = "linear") -> DataFrame:
    """scores (lead, p, ...) with calibrated, by the knots (lead, ord, threshold, value) of their lead.

    linear: straight lines between knots; step: the value of the first knot at or above p. Below the first
    knot and above the last their values hold; a lead without knots keeps its p. Results lie in 0 to 1; a null p stays null.
    """
    w = Window.partitionBy("lead").orderBy("ord")
    ahead = knots.select(F.col("lead").alias("_lead"), F.col("threshold").alias("_x"), F.col("value").alias("_y"), F.lag("threshold").over(w).alias("_x0"), F.lag("value").over(w).alias("_y0"), F.lead("threshold").over(w).isNull().alias("_end"))
    hit = (F.col("lead") == F.col("_lead")) & (F.col("_x0").isNull() | (F.col("p") > F.col("_x0"))) & (F.col("_end") | (F.col("p") <= F.col("_x")))
    line = F.col("_y0") + (F.col("_y") - F.col("_y0")) * (F.col("p") - F.col("_x0")) / (F.col("_x") - F.col("_x0"))
    within = F.when(F.col("_x0").isNull() | (F.col("p") > F.col("_x")), F.col("_y")).otherwise(line) if method == "linear" else F.col("_y")
    value = F.when(F.col("_lead").isNull(), F.col("p")).otherwise(within)
    bounded = F.when(F.col("p").isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return scores.join(ahead, hit, "left").select(*scores.columns, bounded.alias("calibrated"))


STEPS_SQL = f"""WITH knots AS (SELECT * FROM ({SQL['isotonic_fit']}) x), {for_duckdb("WITH g AS (SELECT DISTINCT lead, p FROM {v_pred}) SELECT 1").removeprefix('WITH ').removesuffix(' SELECT 1')},
f AS (SELECT g.lead, g.p, min(ord) AS ord FROM g LEFT JOIN knots k ON k.lead = g.lead AND k.threshold >= g.p GROUP BY g.lead, g.p), z AS (SELECT lead, max(ord) AS last FROM knots GROUP BY lead)
SELECT f.lead, f.p, k.value AS calibrated FROM f JOIN z ON z.lead = f.lead JOIN knots k ON k.lead = f.lead AND k.ord = coalesce(f.ord, z.last)"""


@query("isotonic_step", STEPS_SQL)
def isotonic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step form of the map."""
    scores = views.v_pred(spark, sf_dir).select("lead", "p").distinct()
    return calibrated(scores, stored(QUERIES["isotonic_fit"](spark, sf_dir)), "step").select("lead", "p", F.round("calibrated", 6).alias("calibrated"))


# The rung of each cycle by what it saw and which models are ready: with physics out, persistence serves cells, then climatology.
relational("router_rungs", """WITH seen AS (SELECT cycle, max(CASE WHEN modality = 'radar' THEN 1 ELSE 0 END) AS radar, max(CASE WHEN modality = 'satellite' THEN 1 ELSE 0 END) AS sat, max(CASE WHEN modality = 'lightning' THEN 1 ELSE 0 END) AS ltg, max(CASE WHEN modality = 'surface' THEN 1 ELSE 0 END) AS surf FROM {v_obs} GROUP BY cycle),
c AS (SELECT cycle, 1 AS cells FROM {v_storm} GROUP BY cycle), m AS (SELECT * FROM (VALUES (1, 1, 1, 1), (0, 1, 1, 1), (0, 0, 1, 1), (0, 0, 0, 1), (0, 0, 0, 0)) AS t(unet, fusion, physics, persistence))
SELECT s.cycle, unet, fusion, physics, persistence, CASE WHEN unet = 1 AND sat = 1 THEN CASE WHEN radar = 1 AND ltg = 1 THEN 'FULL_MULTIMODAL' ELSE 'REDUCED_MODALITY' END
  WHEN fusion = 1 THEN CASE WHEN radar = 1 AND sat = 1 AND ltg = 1 THEN 'FULL_FUSION' WHEN sat = 1 OR surf = 1 THEN 'SATELLITE_SURFACE' ELSE 'REDUCED_MODALITY' END
  WHEN physics = 1 AND (radar = 1 OR coalesce(cells, 0) = 1) THEN 'KINEMATIC_PERSISTENCE' WHEN persistence = 1 AND coalesce(cells, 0) = 1 THEN 'PERSISTENCE' ELSE 'CLIMATOLOGY' END AS rung FROM seen s LEFT JOIN c ON c.cycle = s.cycle CROSS JOIN m""")


def in_order(key: str, text: str) -> Column:
    """The texts of a group, which is small, in order of key, a line each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]), "\n")


# The feed of the last twenty alerts, as one document.
ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
COLOUR = "CASE stage WHEN 3 THEN 'RED' WHEN 2 THEN 'ORANGE' ELSE 'YELLOW' END"
ENTRIES = f"""SELECT minute, id, preset, {SENT.format(m="minute")} AS sent, concat('<entry><title>[', {COLOUR}, '] ', {ESCAPED.format(x="region")}, '</title><id>urn:galvane:', {NAMED.format(id="id")}, '</id><updated>', {SENT.format(m="minute")}, '</updated><summary>', verdict, ' at stage ', {COLOUR}, '</summary><link rel="alternate" type="application/cap+xml" href="/alerts/', {NAMED.format(id="id")}, '/cap.xml"/></entry>') AS entry
FROM {{alerts}} ORDER BY minute DESC, id DESC, preset LIMIT 20"""
FEED = """concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>Lightning alerts</title><id>urn:galvane:alerts</id><updated>', max(sent), '</updated><author><name>galvane</name></author>', {listed}, '</feed>') AS feed, count(*) AS entries"""


def feed(alerts: DataFrame) -> DataFrame:
    """feed, entries: one document of the newest twenty of alerts, the newest first; no row where there are no alerts."""
    entries = alerts.sparkSession.sql(ENTRIES, alerts=alerts)
    listed = "array_join(transform(array_sort(collect_list(struct(-minute AS m, -id AS id, preset, entry))), x -> x.entry), '')"
    return alerts.sparkSession.sql(f"SELECT {FEED.replace('{listed}', listed)} FROM {{e}} HAVING count(*) > 0", e=entries)


_listed = "string_agg(entry, '' ORDER BY minute DESC, id DESC, preset)"


@query("atom_document", f"SELECT {FEED.replace('{listed}', _listed)} FROM ({duck_words(ENTRIES).replace('{alerts}', '(SELECT * FROM (' + SQL['alerts'] + ') q)')}) e HAVING count(*) > 0")
def atom_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(stored(QUERIES["alerts"](spark, sf_dir)))


# A run's scorecard with the matrix of the baselines below it.
HEAD = ["### Verification scorecard", "", "| lead | n | POD | FAR | CSI | Brier | BSS | |", "|---|---|---|---|---|---|---|---|"]
SECOND = ["", "#### Baselines", "| model | POD | FAR | CSI | BSS |", "|---|---|---|---|---|"]
_scores = ", ' | ', ".join(TWO_PLACES.format(x=c, plus="+" if c == "bss" else "") for c in ("pod", "far", "csi", "bss"))
MATRIX_LINE = f"concat('| ', model, ' | ', {_scores}, ' |')"
_quoted = lambda lines: "'" + "\\n".join(lines) + "\\n'"


@query("scorecard_document", f"""WITH s AS (SELECT run, string_agg(line, chr(10) ORDER BY lead) AS body FROM ({SQL['scorecard']}) q GROUP BY run), b AS (SELECT string_agg({duck_words(MATRIX_LINE)}, chr(10) ORDER BY model) AS matrix FROM ({SQL['baseline_matrix']}) q)
SELECT run, concat(E{_quoted(HEAD)}, body, chr(10), E{_quoted(SECOND)}, coalesce(matrix, '')) AS doc FROM s, b""")
def scorecard_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = QUERIES["scorecard"](spark, sf_dir).groupBy("run").agg(in_order("lead", "line").alias("body"))
    lines = QUERIES["baseline_matrix"](spark, sf_dir).select("model", F.expr(MATRIX_LINE).alias("row"))
    matrix = lines.agg(in_order("model", "row").alias("matrix"))
    return body.crossJoin(F.broadcast(matrix)).select("run", F.concat(F.lit("\n".join(HEAD) + "\n"), "body", F.lit("\n" + "\n".join(SECOND) + "\n"), "matrix").alias("doc"))


# The bulletin as a document. The wording is this package's own.
PROCEDURES = ["Stop work in the open until the all-clear.", "Go into a solid building and stay away from lone trees and tin roofs.", "Keep off wires, pipes, fences and charging cables.", "Bring boats to the nearest shore.", "District rooms keep watch and pass the alert on."]
BULLETIN_FIELDS = ("headline", "issue_time_utc", "issue_time_ist", "valid_until_ist", "rung", "confidence")


@query("bulletin_document", f"""SELECT preset, CAST(json_object('bulletin_id', concat('GALVANE-', upper(preset)), {', '.join(f"'{c}', {c}" for c in BULLETIN_FIELDS)}, 'affected_regions', string_split(regions, '; '), 'total_population_exposed', people, 'alerts_count', alerts, 'procedures', {PROCEDURES}) AS VARCHAR) AS doc FROM ({SQL['bulletin_now']}) q""")
def bulletin_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QUERIES["bulletin_now"](spark, sf_dir)
    body = F.struct(F.concat(F.lit("GALVANE-"), F.upper("preset")).alias("bulletin_id"), *BULLETIN_FIELDS, F.split("regions", "; ").alias("affected_regions"), F.col("people").alias("total_population_exposed"), F.col("alerts").alias("alerts_count"), F.array(*map(F.lit, PROCEDURES)).alias("procedures"))
    return rows.select("preset", F.to_json(body, WHOLE).alias("doc"))
