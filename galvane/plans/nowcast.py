"""Quality rules, physics, initiation, routing, verification suites and warning products.

Each statement is shared by Spark SQL and DuckDB, as in relational.py. The letters and numbers in
"""

from __future__ import annotations

from collections.abc import Callable

from galvane.plans.products import ALERT, BASE_KM, MOTION, STAGED
from galvane.plans.relational import BOX, HIT, OVERLAP, TRACK, relational

# A history window (t - minutes, t] for each source, and the last frame before it.
relational("history_window", """
WITH t AS (SELECT max(s) AS now FROM {v_obs})
SELECT modality, count(*) FILTER (WHERE s > now - 3600 AND s <= now) AS frames, round(min(s) FILTER (WHERE s > now - 3600 AND s <= now), 3) AS first_s,
  round(max(s) FILTER (WHERE s <= now - 3600), 3) AS last_before
FROM {v_obs}, t GROUP BY modality""")

# A pixel's centre as a closed ring of its corners, in twentieths of a degree.
relational("pixel_ring", """
SELECT DISTINCT i, j, 520 - 2 * i - 1 AS south, 520 - 2 * i + 1 AS north, 1680 + 2 * j - 1 AS west, 1680 + 2 * j + 1 AS east,
  concat_ws(' ', concat(CAST(1680 + 2 * j - 1 AS STRING), ',', CAST(520 - 2 * i - 1 AS STRING)), concat(CAST(1680 + 2 * j + 1 AS STRING), ',', CAST(520 - 2 * i - 1 AS STRING)),
    concat(CAST(1680 + 2 * j + 1 AS STRING), ',', CAST(520 - 2 * i + 1 AS STRING)), concat(CAST(1680 + 2 * j - 1 AS STRING), ',', CAST(520 - 2 * i + 1 AS STRING)),
    concat(CAST(1680 + 2 * j - 1 AS STRING), ',', CAST(520 - 2 * i - 1 AS STRING))) AS ring FROM {v_pix}""")

# Range rules by (source, variable), then by variable, then none; problems of each frame.
# Ranges of the rules.
RULES = """
by_source AS (SELECT * FROM (VALUES ('radar', 'refl', -40D, 95D), ('satellite', 'bt', 150D, 350D), ('lightning', 'flash', 0D, 1000000000D)) AS t(source, variable, lo, hi)),
by_variable AS (SELECT * FROM (VALUES ('refl', -40D, 95D), ('bt', 150D, 330D), ('flash', 0D, 1000000000D), ('precipitation', 0D, 500D), ('cape', 0D, 7500D), ('cin', 0D, 2000D), ('shear', 0D, 120D), ('rh', 0D, 100D)) AS t(variable, lo, hi)),
seen AS (SELECT *, CASE modality WHEN 'radar' THEN 'refl' WHEN 'satellite' THEN 'bt' WHEN 'lightning' THEN 'flash' WHEN 'surface' THEN 'precipitation'
    ELSE CASE station % 4 WHEN 0 THEN 'cape' WHEN 1 THEN 'cin' WHEN 2 THEN 'shear' ELSE 'rh' END END AS variable,
  CASE WHEN event_id % 97 = 0 OR cycle % 50 = 7 AND event_id % 3 > 0 THEN NULL ELSE value END AS v FROM {v_obs}),
frames AS (SELECT modality, variable, cycle, count(*) AS n, avg(CASE WHEN v IS NULL THEN 1D ELSE 0D END) AS missing, min(v) AS low, max(v) AS high, max(s) AS s,
  count(*) FILTER (WHERE lat < 25.2D OR lat > 26.05D) AS outside FROM seen GROUP BY modality, variable, cycle),
ruled AS (SELECT f.*, coalesce(a.lo, b.lo) AS lo, coalesce(a.hi, b.hi) AS hi FROM frames f LEFT JOIN by_source a ON a.source = f.modality AND a.variable = f.variable LEFT JOIN by_variable b ON b.variable = f.variable),
now AS (SELECT max(s) AS top FROM {v_obs}),
flagged AS (SELECT r.*, CASE WHEN missing > 0 THEN 'missing' END AS p1, CASE WHEN low < lo OR high > hi THEN 'range' END AS p2, CASE WHEN low = high THEN 'constant' END AS p3,
  CASE WHEN outside > 0 THEN 'coordinates' END AS p4, CASE WHEN top - s > 5400 THEN 'stale' END AS p5 FROM ruled r, now),
status AS (SELECT *, CASE WHEN missing > 0.5D THEN 'MISSING' WHEN concat_ws(';', p1, p2, p3, p4, p5) <> '' THEN 'SUSPECT' ELSE 'OK' END AS status FROM flagged)"""
relational("qc_frames", f"WITH {RULES} SELECT modality, variable, cycle, n, round(missing, 6) AS missing, concat_ws(';', p1, p2, p3, p4, p5) AS problems, status FROM status")

# A3, A4: a modality's verdict over the last hour, modalities without frames too, and what is available.
# A frame is BAD only if its source says so; the view's sources say so for none.
STATUS = """
modalities AS (SELECT * FROM (VALUES ('radar'), ('satellite'), ('lightning'), ('surface'), ('model'), ('sounding')) AS t(name)),
verdict AS (SELECT m.name, count(s.status) AS frames, CASE WHEN count(s.status) = 0 THEN 'MISSING' WHEN count(*) FILTER (WHERE status = 'BAD') > 0 THEN 'BAD'
    WHEN count(*) FILTER (WHERE status <> 'MISSING') = 0 THEN 'MISSING' WHEN count(*) FILTER (WHERE status <> 'OK' OR p5 IS NOT NULL) > 0 THEN 'SUSPECT' ELSE 'OK' END AS health, max(s.s) AS last_s
  FROM modalities m LEFT JOIN (SELECT status.* FROM status, now WHERE s > top - 14400) s ON s.modality = m.name GROUP BY m.name),
usable AS (SELECT name, frames, health, CASE WHEN health NOT IN ('MISSING', 'BAD') AND top - last_s <= CASE WHEN name = 'model' THEN 43200 ELSE 1800 END THEN 1 ELSE 0 END AS available FROM verdict, now)"""
relational("modality_status", f"WITH {RULES}, {STATUS} SELECT * FROM usable")

# Rung by what is available, in order of decision, with confidence from healthy and suspect modalities.
relational("router", f"""
WITH {RULES}, {STATUS}, a AS (SELECT max(CASE WHEN name = 'radar' THEN available END) AS radar, max(CASE WHEN name = 'satellite' THEN available END) AS sat, max(CASE WHEN name = 'lightning' THEN available END) AS ltg,
  max(CASE WHEN name = 'surface' THEN available END) AS surf, sum(available) AS ok, count(*) FILTER (WHERE health <> 'OK') AS suspect FROM usable),
models AS (SELECT * FROM (VALUES (1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0)) AS t(unet, fusion, cells))
SELECT unet, fusion, cells, CASE WHEN unet = 1 AND radar = 1 AND sat = 1 AND ltg = 1 THEN 'FULL_MULTIMODAL' WHEN unet = 1 AND sat = 1 THEN 'REDUCED_MODALITY'
  WHEN fusion = 1 AND radar = 1 AND sat = 1 AND ltg = 1 THEN 'FULL_FUSION' WHEN fusion = 1 AND (sat = 1 OR surf = 1) THEN 'SATELLITE_SURFACE' WHEN fusion = 1 THEN 'REDUCED_MODALITY'
  WHEN radar = 1 OR cells = 1 THEN 'KINEMATIC_PERSISTENCE' ELSE 'CLIMATOLOGY' END AS rung,
  round(least(greatest(0.35D + 0.15D * greatest(0, ok - 1) - 0.05D * suspect, 0.05D), 0.9D), 6) AS confidence FROM models, a""")

# How each model stands: rows scored and when last.
relational("model_health", "SELECT run, lead, count(*) AS scored, round(avg(p), 6) AS mean_p, CASE WHEN count(*) > 0 THEN 'READY' ELSE 'UNAVAILABLE' END AS health FROM {v_pred} GROUP BY run, lead")

# Infrared counts of a frame are hundredths of a degree if any is negative or above 255, else eight bits.
relational("ir_kelvin", """
WITH r AS (SELECT frame, i, j, CASE WHEN frame % 2 = 0 THEN value * 20 - 6000 ELSE value / 2 END AS raw FROM {v_pix}),
b AS (SELECT frame, min(raw) AS low, max(raw) AS high FROM r GROUP BY frame)
SELECT r.frame, i, j, round(CASE WHEN low < 0 OR high > 255 THEN raw * 0.01D + 273.15D ELSE 150 + raw * (200 / 255D) END, 6) AS kelvin FROM r JOIN b ON r.frame = b.frame""")

# Planck inversion with band correction, and the way back. Wavenumbers, corrections, constants.
BANDS = """bands AS (SELECT * FROM (VALUES ('TIR1', 925.926D, 0.45D, 0.998D), ('WV', 1470.588D, 1.25D, 0.995D), ('TIR2', 833.333D, 0.35D, 0.998D), ('MIR', 2564.103D, 1.8D, 0.992D), ('VIS', 15384.615D, 0D, 1D)) AS t(channel, nu, a, b))"""
relational("planck_channels", f"""
WITH {BANDS}, x AS (SELECT event_id, channel, nu, a, b, least(greatest(value, 0.0001D), 500D) AS radiance FROM {{v_obs}}, bands WHERE modality = 'satellite'),
t AS (SELECT *, 1.43877688D * nu / ln(1 + 0.0000119104276D * nu * nu * nu / radiance) AS tb FROM x)
SELECT event_id, channel, round(least(greatest(a + b * tb, 150D), 350D), 6) AS kelvin, round(0.0000119104276D * nu * nu * nu / (exp(1.43877688D * nu / tb) - 1), 6) AS back FROM t""")

# Eight channels to 0..1, cold ones turned round. Bounds.
BOUNDS = """bounds AS (SELECT * FROM (VALUES ('tir1', 180D, 320D), ('wv', 200D, 280D), ('split_diff', -4D, 6D), ('radar_maxz', 0D, 70D), ('rain', 0D, 60D), ('flash_density', 0D, 25D), ('cape', 0D, 4000D), ('bulk_shear', 0D, 40D)) AS t(channel, lo, hi))"""
SCALED = """least(greatest(CASE WHEN channel IN ('tir1', 'wv') THEN (hi - x) / (hi - lo) ELSE (x - lo) / (hi - lo) END, 0D), 1D)"""
CHANNELS = f"""{BOUNDS}, raw AS (SELECT p.frame, p.i, p.j, channel, lo, hi, CASE channel WHEN 'tir1' THEN 320 - value / 4 WHEN 'wv' THEN 280 - value / 6 WHEN 'split_diff' THEN value / 50 - 4 WHEN 'radar_maxz' THEN value / 7
  WHEN 'rain' THEN value / 8 WHEN 'flash_density' THEN value / 20 WHEN 'cape' THEN value * 8 ELSE value / 12 END AS x FROM {{v_pix}} p, bounds)"""
relational("channel_norm_8", f"WITH {CHANNELS} SELECT frame, i, j, channel, round({SCALED}, 7) AS x FROM raw")

# Eight channels by four steps; a short series repeats its last frame, a missing source is zero.
relational("tensor_8", f"""
WITH {CHANNELS}, f AS (SELECT DISTINCT frame FROM {{v_pix}}), k AS (SELECT frame, row_number() OVER (ORDER BY frame DESC) AS back, least(count(*) OVER (), 4) AS n FROM f),
steps AS (SELECT t, frame FROM k JOIN (VALUES (0), (1), (2), (3)) AS s(t) ON n - back = least(t, n - 1) WHERE back <= 4)
SELECT channel, t, i, j, round(CASE WHEN channel = 'rain' THEN 0D ELSE {SCALED} END, 7) AS x FROM raw r JOIN steps s ON r.frame = s.frame""")

# Resize to 7 x 7 by bilinear interpolation at evenly spaced places.
relational("resize", """
WITH s AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS t(k)),
g AS (SELECT a.k AS r, b.k AS c, a.k * 1.5D AS y, b.k * 1.5D AS x FROM s a, s b),
w AS (SELECT r, c, CAST(floor(y) AS INT) + d.o AS i, CAST(floor(x) AS INT) + e.o AS j, (CASE WHEN d.o = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN e.o = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
  FROM g, (VALUES (0), (1)) AS d(o), (VALUES (0), (1)) AS e(o))
SELECT p.frame, w.r, w.c, round(sum(w * value), 6) AS value FROM {v_pix} p JOIN w ON p.i = w.i AND p.j = w.j WHERE w > 0 GROUP BY p.frame, w.r, w.c""")

# Lifecycle from rates of area and intensity; a pixel is 123 square kilometres.
RATES = f"""rated AS (SELECT *, (area - area_0) * 123D / ((b - b_0) * 6D) AS d_area, (intensity - int_0) / ((b - b_0) * 6D) AS d_int FROM ({TRACK}) t)"""
relational("lifecycle_rates", f"""
WITH {RATES} SELECT track, b, round(coalesce(d_area, 0D), 6) AS d_area, round(coalesce(d_int, 0D), 6) AS d_int, CASE WHEN track % 41 = 0 THEN 'SPLIT' WHEN track % 43 = 0 THEN 'MERGE' WHEN k = 1 THEN 'INITIATING'
  WHEN d_area > 15 OR d_int > 5 THEN 'INTENSIFYING' WHEN d_area < -15 OR d_int < -5 THEN 'DECAYING' WHEN k >= 3 OR area * 123D >= 60 OR intensity >= 40 THEN 'MATURE' ELSE 'INITIATING' END AS state FROM rated""")

# Acceleration, the change of velocity between steps, in km/h and hours.
relational("acceleration", f"""
WITH {MOTION}, v AS (SELECT track, b, vlon * 111.32D * cos(radians(lat)) AS u, vlat * 111.32D AS v FROM m),
l AS (SELECT *, lag(u) OVER w AS u0, lag(v) OVER w AS v0, lag(b) OVER w AS b0 FROM v WINDOW w AS (PARTITION BY track ORDER BY b))
SELECT track, b, round(sqrt(pow((u - u0) / ((b - b0) * 6D), 2) + pow((v - v0) / ((b - b0) * 6D), 2)), 6) AS acceleration FROM l WHERE b0 IS NOT NULL""")

# Flashes in the storm's box of 12 km in five-minute bins between ten times up to the cycle's end, empty ones too; the last two bins against mean and
# deviation of the first eight. Ten times make nine bins: as with the rule that this must agree with, the tenth is always empty.
relational("jump_ten_bins", f"""
WITH bins AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(k)), w AS (SELECT f.*, f.cycle + t.o AS at FROM {{v_flash}} f CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(o)),
f AS (SELECT c.cycle, c.i, c.j, CAST(ceil((f.s - (c.cycle + 1) * 600D + 2700) / 300) AS INT) - 1 AS k, sum(f.strokes) AS n FROM {{v_storm}} c JOIN w f ON f.at = c.cycle AND {BOX.format(r="12.0D")} WHERE f.s > (c.cycle + 1) * 600D - 2700 AND f.s <= (c.cycle + 1) * 600D GROUP BY 1, 2, 3, 4),
c AS (SELECT c.cycle, c.i, c.j, bins.k, coalesce(f.n, 0) AS n FROM {{v_storm}} c CROSS JOIN bins LEFT JOIN f ON f.cycle = c.cycle AND f.i = c.i AND f.j = c.j AND f.k = bins.k),
h AS (SELECT cycle, i, j, avg(CASE WHEN k < 8 THEN n END) AS mu, stddev_pop(CASE WHEN k < 8 THEN n END) AS sd, min(CASE WHEN k >= 8 THEN n END) AS low, sum(CASE WHEN k >= 8 THEN n END) AS recent FROM c GROUP BY cycle, i, j)
SELECT cycle, i, j, round(mu, 6) AS mu, round(sd, 6) AS sd, CAST(recent AS BIGINT) AS recent, CASE WHEN mu = 0 AND sd = 0 THEN CASE WHEN recent >= 6 THEN 1 ELSE 0 END WHEN low > mu + 2 * sd THEN 1 ELSE 0 END AS jump FROM h""")

# Smoothing by two passes of a separable box, edge pixels repeated. Passes along an axis are one table of weights from pixel s to pixel t.
def weights(radius: int, size: int = 10) -> list[tuple[int, int, int]]:
    """(s, t, how often s counts for t in two passes of a box of 2 radius + 1)."""
    once = [[sum(min(max(t + o, 0), size - 1) == s for o in range(-radius, radius + 1)) for t in range(size)] for s in range(size)]
    twice = [[sum(once[s][m] * once[m][t] for m in range(size)) for t in range(size)] for s in range(size)]
    return [(s, t, w) for s, row in enumerate(twice) for t, w in enumerate(row) if w]


def smoothed(source: str, key: str = "frame", radius: int = 2, out: str = "b2") -> str:
    """The table out: the values v of source (key, i, j, v) smoothed; pixels that are absent count 0."""
    table = ", ".join(map(str, weights(radius)))
    n = (2 * radius + 1) ** 2
    return f"""{out}_k AS (SELECT * FROM (VALUES {table}) AS t(s, t, w)), {out}_i AS (SELECT {key}, t AS i, j, sum(v * w) / {n} AS v FROM {source} JOIN {out}_k ON s = i GROUP BY {key}, t, j),
{out} AS (SELECT {key}, i, t AS j, sum(v * w) / {n} AS v FROM {out}_i JOIN {out}_k ON s = j GROUP BY {key}, i, t)"""


BLUR = "px AS (SELECT frame, i, j, value AS v FROM {v_pix}),\n" + smoothed("px")
relational("gaussian_smooth", f"WITH {BLUR} SELECT frame, i, j, round(v, 6) AS smooth FROM b2")

# of every pixel of a frame (one without a value has none): doubt, lead, edges and missing sources, smoothed, then clipped.
relational("uncertainty_terms", f"""
WITH leads AS (SELECT * FROM (VALUES (15), (30), (45), (60)) AS t(lead)), line AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(k)),
s AS (SELECT CAST(floor(cycle / 6) AS INT) AS frame, 0.2D * (1 - max(CASE WHEN modality = 'radar' THEN 1 ELSE 0 END)) + 0.25D * (1 - max(CASE WHEN modality = 'satellite' THEN 1 ELSE 0 END)) + 0.15D * (1 - max(CASE WHEN modality = 'model' THEN 1 ELSE 0 END)) AS sensors FROM {{v_obs}} GROUP BY 1),
g AS (SELECT f.frame, a.k AS i, b.k AS j, least(coalesce(p.value, 0D) / 500, 1D) AS p, least(coalesce(s.sensors, 0.6D), 1D) AS sensors FROM (SELECT DISTINCT frame FROM {{v_pix}}) f CROSS JOIN line a CROSS JOIN line b LEFT JOIN {{v_pix}} p ON p.frame = f.frame AND p.i = a.k AND p.j = b.k LEFT JOIN s ON s.frame = f.frame),
x AS (SELECT frame, i, j, 0.45D * 4 * p * (1 - p) + 0.15D * CASE WHEN i IN (0, 9) OR j IN (0, 9) THEN 0.2D ELSE 0D END + 0.1D * sensors AS v FROM g),
{smoothed("x")}
SELECT frame, i, j, lead, round(least(greatest(v + 0.3D * least(0.4D, 0.05D * (lead / 15D)), 0.05D), 1D), 6) AS sigma FROM b2 CROSS JOIN leads""")

# M5: the mean motion of all cells shifts the field; the cell's probability is the largest in 5 x 5.
relational("advected", f"""
WITH {MOTION}, drift AS (SELECT CAST(floor(b / 4) AS INT) AS frame, CAST(floor(avg(vlat) / -0.1D * 0.5D + 0.5D) AS INT) AS si, CAST(floor(avg(vlon) / 0.1D * 0.5D + 0.5D) AS INT) AS sj FROM m GROUP BY 1),
moved AS (SELECT p.frame, p.i + si AS i, p.j + sj AS j, value FROM {{v_pix}} p JOIN drift d ON d.frame = p.frame WHERE p.i + si BETWEEN 0 AND 9 AND p.j + sj BETWEEN 0 AND 9),
o AS (SELECT a.o AS di, b.o AS dj FROM (VALUES (-2), (-1), (0), (1), (2)) AS a(o), (VALUES (-2), (-1), (0), (1), (2)) AS b(o)),
near AS (SELECT cycle, c.i, c.j, CAST(floor(cycle / 6) AS INT) AS frame, c.i + di AS ni, c.j + dj AS nj FROM {{v_storm}} c, o)
SELECT cycle, n.i, n.j, round(coalesce(max(1 - exp(-0.05D * least(value / 255, 1D) * 30)), 0D), 6) AS p FROM near n LEFT JOIN moved m ON m.frame = n.frame AND m.i = n.ni AND m.j = n.nj GROUP BY cycle, n.i, n.j""")

# Pixels that meet all five criteria of initiation: cooling, freezing level, saturation, split window, no mature echo.
CRITERIA = """px AS (SELECT a.frame, a.i, a.j, 300 - a.value / 4 AS ir, (b.value - a.value) / 8 AS cooling, (a.value - b.value) / 100 - 0.5D AS ir_wv, a.value / 200 AS split, coalesce(z.value, 0D) / 10 AS dbz
  FROM {v_pix} a JOIN {v_pix} b ON b.frame = a.frame - 1 AND b.i = a.i AND b.j = a.j LEFT JOIN (SELECT CAST(floor(cycle / 6) AS INT) AS frame, i, j, max(intensity) AS value FROM {v_storm} GROUP BY 1, 2, 3) z ON z.frame = a.frame AND z.i = a.i AND z.j = a.j),
ci AS (SELECT * FROM px WHERE cooling <= -4 AND ir <= 273.15D AND ir_wv >= -1 AND split <= 3 AND dbz < 35)"""
SCORED = """0.6D * least(greatest(0.4D + 0.55D * (abs(cooling) - 4) / 8, 0.4D), 0.95D) + 0.4D * least(greatest(0.5D + 0.5D * (273.15D - ir) / 40, 0.5D), 1D) + CASE WHEN ir_wv >= 0 THEN 0.05D ELSE 0D END + CASE WHEN split <= 1.5D THEN 0.05D ELSE 0D END"""
relational("initiation_pixels", f"WITH {CRITERIA} SELECT frame, i, j, round(ir, 6) AS ir, round(cooling, 6) AS cooling, round(ir_wv, 6) AS ir_wv, round(split, 6) AS split FROM ci")

# A candidate goes on from the nearest of the day before within 50 km; one may be followed by several.
CANDIDATE = f"{CRITERIA}, c AS (SELECT frame, i, j, 26D - 0.1D * i AS lat, 84D + 0.1D * j AS lon, cooling, least(greatest({SCORED}, 0.4D), 0.98D) AS p FROM ci)"
relational("initiation_candidates", f"WITH {CANDIDATE} SELECT frame, i, j, round(cooling, 6) AS cooling, round(p, 6) AS p FROM c")


def followed(rounded: Callable[[str, int], str] = "round({}, {})".format) -> str:
    return f"""{CANDIDATE}, y AS (SELECT a.frame, a.i, a.j, b.i * 10 + b.j AS prev, (a.lat - b.lat) * 111 AS dy, (a.lon - b.lon) * 111 * cos(radians((a.lat + b.lat) / 2)) AS dx FROM c a JOIN c b ON b.frame = a.frame - 1 AND abs(a.i - b.i) <= 5 AND abs(a.j - b.j) <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, i, j ORDER BY {rounded("sqrt(dx * dx + dy * dy)", 5)}, prev) AS k FROM y WHERE sqrt(dx * dx + dy * dy) <= 50),
tracked AS (SELECT c.frame, c.i, c.j, r.prev, {rounded("r.dx / 0.25D", 4)} + 0D AS u_kmh, {rounded("r.dy / 0.25D", 4)} + 0D AS v_kmh, {rounded("CASE WHEN r.prev IS NULL THEN c.p ELSE least(c.p + 0.05D, 0.98D) END", 6)} AS p FROM c LEFT JOIN r ON r.frame = c.frame AND r.i = c.i AND r.j = c.j AND r.k = 1)"""


def rounded_after_scaling(x: str, places: int) -> str:
    """Spark rounds the shortest decimal of a double, DuckDB the scaled double: this gives DuckDB's result at and near ties too."""
    return f"(round(({x}) * 1e{places}D, 0) / 1e{places}D)"


relational("initiation_tracking", f"WITH {followed()} SELECT * FROM tracked", f"WITH {followed(rounded_after_scaling)} SELECT * FROM tracked")

# The whole suite by run and lead.
SUITE = f"""w AS (SELECT run, lead, count(*) AS n, avg(y) AS base, avg(pow(p - y, 2)) AS brier, avg(pow(p_climo - y, 2)) AS climo, count(*) FILTER (WHERE p >= 0.35D AND y = 1) AS hits,
  count(*) FILTER (WHERE p < 0.35D AND y = 1) AS misses, count(*) FILTER (WHERE p >= 0.35D AND y = 0) AS false_alarms, count(*) FILTER (WHERE p < 0.35D AND y = 0) AS correct_negatives FROM {{v_pred}} GROUP BY run, lead),
b AS (SELECT run, lead, CASE WHEN p >= 0.8D THEN 4 WHEN p >= 0.6D THEN 3 WHEN p >= 0.4D THEN 2 WHEN p >= 0.2D THEN 1 ELSE 0 END AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS oy FROM {{v_pred}} WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2, 3),
d AS (SELECT *, oy - lag(oy) OVER (PARTITION BY run, lead ORDER BY bin) AS step FROM b),
m AS (SELECT d.run, d.lead, sum(d.n * pow(mp - oy, 2)) / max(w.n) AS rel, sum(d.n * pow(oy - base, 2)) / max(w.n) AS res, max(base * (1 - base)) AS unc, CASE WHEN coalesce(min(step), 0D) >= -0.00001D THEN 1 ELSE 0 END AS monotone FROM d JOIN w ON d.run = w.run AND d.lead = w.lead GROUP BY d.run, d.lead),
g AS (SELECT run, lead, p, count(*) AS n, sum(y) AS pos FROM {{v_pred}} GROUP BY run, lead, p),
r AS (SELECT run, lead, pos, n, sum(n) OVER (PARTITION BY run, lead ORDER BY p) - n + (n + 1) / 2.0D AS rank FROM g),
auc AS (SELECT run, lead, (sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0D) / nullif(CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0) AS auc FROM r GROUP BY run, lead),
suite AS (SELECT w.*, hits / nullif(CAST(hits + misses AS DOUBLE), 0) AS pod, false_alarms / nullif(CAST(hits + false_alarms AS DOUBLE), 0) AS far, hits / nullif(CAST(hits + misses + false_alarms AS DOUBLE), 0) AS csi,
  1 - brier / nullif(base * (1 - base), 0) AS bss, 1 - brier / nullif(climo, 0) AS bss_climo, rel, res, unc, monotone, auc FROM w JOIN m ON m.run = w.run AND m.lead = w.lead JOIN auc ON auc.run = w.run AND auc.lead = w.lead)"""
relational("verification_suite", f"""WITH {SUITE} SELECT run, lead, n, round(base, 6) AS pos_rate, hits, misses, false_alarms, correct_negatives, round(pod, 6) AS pod, round(far, 6) AS far, round(csi, 6) AS csi, round(brier, 6) AS brier,
  round(bss, 6) AS bss, round(bss_climo, 6) AS bss_climo, round(auc, 6) AS roc_auc, monotone, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty, round(rel - res + unc, 6) AS decomposed FROM suite""")

# A scorecard line for each run and lead; two decimals, a dash for what has no value, a sign for skill.
TWO_PLACES = "CASE WHEN {x} IS NULL THEN '-' ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '{plus}' END, CAST(CAST(floor(floor(abs({x}) * 100 + 0.5D) / 100) AS BIGINT) AS STRING), '.', lpad(CAST(CAST(floor(abs({x}) * 100 + 0.5D) AS BIGINT) % 100 AS STRING), 2, '0')) END"
relational("scorecard", f"""WITH {SUITE} SELECT run, lead, concat('| +', CAST(lead AS STRING), ' min | ', CAST(n AS STRING), ' | ', {TWO_PLACES.format(x="pod", plus="")}, ' | ', {TWO_PLACES.format(x="far", plus="")}, ' | ', {TWO_PLACES.format(x="csi", plus="")}, ' | ',
  {TWO_PLACES.format(x="brier", plus="")}, ' | ', {TWO_PLACES.format(x="bss", plus="+")}, ' | ', CASE WHEN bss > 0 THEN 'skilled' ELSE 'baseline' END, ' |') AS line FROM suite""")

# Each storm with its blocks: region, districts in order of overlap, exposed population.
relational("geocoded_cells", f"""WITH {OVERLAP}, {HIT} SELECT cycle, i, j, count(*) AS blocks, count(DISTINCT district) AS districts, CAST(sum(exposed) AS BIGINT) AS exposed, max_by(district, fraction * 1000 - s_suppkey / 1000000D) AS first_district FROM hit GROUP BY cycle, i, j""")

# Blocks that a box meets; J14: lookups by name with an alias.
relational("blocks_in_box", "SELECT s_suppkey, state, district, block FROM {v_block} WHERE lat0 <= 24.85D AND lat1 >= 24.15D AND lon0 <= 85.25D AND lon1 >= 84.15D")
relational("event_lookup", "WITH n AS (SELECT * FROM (VALUES (3), (7), (11)) AS t(id)), e AS (SELECT user_id, concat('CASE_', CAST(user_id AS STRING)) AS alias, count(*) AS frames FROM {v_obs} GROUP BY user_id) SELECT e.* FROM e JOIN n ON e.user_id = n.id OR e.alias = concat('CASE_', CAST(n.id AS STRING))")

# What the map of an alert's risk factors holds, and the advice for it. The wording is this package's own.
relational("risk_actions", f"""
WITH {ALERT}, {STAGED}, advice AS (SELECT * FROM (VALUES ('RED', 'protective', 'Go indoors now and stay there.'), ('RED', 'operational', 'Open the emergency room and warn all listed blocks.'), ('ORANGE', 'protective', 'Make ready to go indoors; bring children and animals in.'),
  ('ORANGE', 'operational', 'Tell block officers and check the lines.'), ('YELLOW', 'protective', 'Look at the forecast every half hour.'), ('YELLOW', 'operational', 'Keep to the usual watch and read the next cycle.')) AS t(stage, preset, text))
SELECT o_orderkey, round(p, 4) AS p_flash, people, jump, coalesce(text, 'Look at the next update.') AS action FROM s LEFT JOIN advice a ON a.stage = s.stage AND a.preset = s.preset""")

# Names in Hindi by stage. The wording is this package's own.
relational("hindi_stage", f"""
WITH {ALERT}, {STAGED}, hindi AS (SELECT * FROM (VALUES ('RED', 'तुरंत भीतर जाएँ'), ('ORANGE', 'तैयार रहें'), ('YELLOW', 'ध्यान रखें')) AS t(stage, text)) SELECT s.stage, text, count(*) AS alerts FROM s JOIN hindi h ON h.stage = s.stage GROUP BY s.stage, text""")

# C11: features of cells and flashes; coordinates are pixels' centres in tenths.
relational("geojson_cells", """
SELECT cycle, i, j, concat(chr(123), '"type":"Feature","properties":', chr(123), '"cycle":', CAST(cycle AS STRING), chr(125), ',"geometry":', chr(123), '"type":"Point","coordinates":[84.', CAST(j AS STRING), ',', CASE WHEN i = 0 THEN '26.0' ELSE concat('25.', CAST(10 - i AS STRING)) END, ']', chr(125), chr(125)) AS feature FROM {v_storm}""")

# Slot times from file names; addresses with the right scheme and host.
NAMES = """names AS (SELECT event_id, concat('3B-HHR-E.MS.MRG.3IMERG.2024', lpad(CAST(1 + event_id % 12 AS STRING), 2, '0'), lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '-S', lpad(CAST(event_id % 24 AS STRING), 2, '0'), '3000-E', lpad(CAST(event_id % 24 AS STRING), 2, '0'), '5959.0000.V07B.HDF5') AS name,
  concat(CASE WHEN event_id % 5 = 0 THEN 'http' ELSE 'https' END, '://', CASE event_id % 3 WHEN 0 THEN 'data.example.gov' WHEN 1 THEN 'example.gov' ELSE 'example.gov.evil.org' END, '/x') AS url FROM {v_obs})"""
relational("file_slots", f"WITH {NAMES}, x AS (SELECT event_id, regexp_extract(name, '3IMERG[.]([0-9]+)-S', 1) AS day, regexp_extract(name, '-S([0-9]+)-', 1) AS slot_at FROM names) SELECT event_id, concat(substr(day, 1, 4), '-', substr(day, 5, 2), '-', substr(day, 7, 2), 'T', substr(slot_at, 1, 2), ':', substr(slot_at, 3, 2)) AS slot FROM x")
relational("url_allowed", f"WITH {NAMES}, x AS (SELECT event_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM names) SELECT event_id, CASE WHEN scheme = 'https' AND (host = 'example.gov' OR host LIKE '%.example.gov') THEN 1 ELSE 0 END AS allowed FROM x")

# Lead to index; P23 with the presets' own thresholds.
relational("lead_index", "WITH m AS (SELECT * FROM (VALUES (15, 0), (30, 1), (45, 2), (60, 3)) AS t(lead, place)) SELECT p.lead, place, count(*) AS n FROM {v_pred} p JOIN m ON m.lead = p.lead GROUP BY p.lead, place")

# T4: the cone as a ring from the last step's motion: a circle of 17 points below 1 km/h, else left side, cap of five points, right side and the
# start again. The radius is that of the storm's area, 8 km at least, and grows. kinematics.py has it from the filter.
relational("cone_ring", f"""
WITH {MOTION}, n AS (SELECT *, vlon * 111.32D * cos(radians(lat)) AS u, vlat * 111.32D AS v, {BASE_KM} AS base FROM m), q AS (SELECT *, sqrt(u * u + v * v) AS speed, atan2(v, u) AS way FROM n),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16)) AS t(k)),
e AS (SELECT q.*, k, CASE WHEN speed < 1 THEN 0D WHEN k <= 4 THEN k * 0.25D WHEN k <= 9 THEN 1D WHEN k <= 14 THEN (14 - k) * 0.25D ELSE 0D END AS h,
  CASE WHEN speed < 1 THEN radians(k * 22.5D) WHEN k <= 4 OR k = 15 THEN way + radians(90D) WHEN k <= 9 THEN way - radians(90D) + radians((k - 4) * 30D) ELSE way - radians(90D) END AS turn FROM q, k WHERE speed < 1 OR k <= 15),
r AS (SELECT *, (base + 1.645D * 12 * CASE WHEN speed < 1 THEN 1D ELSE h END) AS r FROM e)
SELECT track, b, k, round(lat + vlat * h + r * sin(turn) / 111.32D, 4) + 0D AS lat, round(lon + vlon * h + r * cos(turn) / (111.32D * greatest(cos(radians(lat + vlat * h)), 0.0001D)), 4) + 0D AS lon FROM r""")

# Live frames are flagged when late or early, replayed ones never.
relational("live_flags", """WITH t AS (SELECT max(s) - 3600 AS now FROM {v_obs}) SELECT modality, CASE WHEN user_id % 2 = 0 THEN 'LIVE' ELSE 'REPLAY' END AS mode, count(*) FILTER (WHERE user_id % 2 = 0 AND now - s > 5400) AS stale, count(*) FILTER (WHERE user_id % 2 = 0 AND s - now > 300) AS early, count(*) AS n FROM {v_obs}, t GROUP BY 1, 2""")
