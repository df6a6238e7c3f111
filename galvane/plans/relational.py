"""Queries whose plan is one relational statement, the same for Spark SQL and for DuckDB."""

from __future__ import annotations

import re

from galvane.plans.catalog import QUERIES, SQL
from galvane.sources import views

BOX = "abs(f.lat - c.lat) <= {r} / 111.32D AND abs(f.lon - c.lon) <= {r} / (111.32D * cos(radians(c.lat)))"


def duck_words(text: str) -> str:
    """Spark's double literals and rounding in DuckDB's words."""
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)D\b", r"(\1::DOUBLE)", text.replace("bround(", "round_even("))


def for_duckdb(text: str) -> str:
    """text with its views as common tables."""
    used = set(re.findall(r"\{(v_\w+)\}", text))
    if used & {"v_flash", "v_pix", "v_storm", "v_cell"}:
        used.add("v_obs")
    heads = ", ".join(f"{v} AS ({views.DUCK[v]})" for v in views.DUCK if v in used)
    body = duck_words(re.sub(r"\{(v_\w+)\}", r"\1", text)).strip()
    return f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"


def relational(name: str, text: str, for_spark: str | None = None) -> None:
    """Register a statement; for_spark is its text for Spark where the engines' words differ."""
    own = for_spark or text

    def run(spark, sf_dir):
        used = set(re.findall(r"\{(v_\w+)\}", own))
        return spark.sql(own, **{v: views.VIEWS[v](spark, sf_dir) for v in used})

    run.__name__ = name
    QUERIES[name], SQL[name] = run, for_duckdb(text)


# A flash is sent to the cycles whose windows can hold it: an equi-join on the cycle, then the box.
PAST = "past AS (SELECT f.*, f.cycle + t.o AS at FROM {v_flash} f CROSS JOIN (VALUES (0), (1), (2)) AS t(o))"
NEXT = "ahead AS (SELECT f.*, f.cycle - t.o AS at FROM {v_flash} f CROSS JOIN (VALUES (1), (2), (3)) AS t(o))"
COUNTS = f"""counts AS (SELECT c.cycle, c.i, c.j, c.intensity, CAST(coalesce(sum(f.strokes) FILTER (WHERE f.cycle = c.cycle), 0) AS BIGINT) AS f10, CAST(coalesce(sum(f.strokes) FILTER (WHERE f.cycle >= c.cycle - 1), 0) AS BIGINT) AS f20, CAST(coalesce(sum(f.strokes), 0) AS BIGINT) AS f30
  FROM {{v_storm}} c LEFT JOIN past f ON f.at = c.cycle AND {BOX.format(r="12.0D")} GROUP BY c.cycle, c.i, c.j, c.intensity)"""
LABELS = f"""labels AS (SELECT c.cycle, c.i, c.j, CAST(count(f.event_id) > 0 AS INT) AS y FROM {{v_storm}} c LEFT JOIN ahead f ON f.at = c.cycle AND {BOX.format(r="5.0D")} GROUP BY c.cycle, c.i, c.j)"""
JUMP = "jumps AS (SELECT *, (f30 - f10) / 2.0D AS before, CAST(f10 >= 6 AND f10 - (f30 - f10) / 2.0D >= 2 * greatest(1.0D, sqrt((f30 - f10) / 2.0D)) AS INT) AS jump FROM counts)"

relational("flash_counts_10_20_30", f"WITH {PAST}, {COUNTS} SELECT * FROM counts")
relational("flash_exists_label", f"WITH {NEXT}, {LABELS} SELECT * FROM labels")
relational("lightning_jump", f"WITH {PAST}, {COUNTS}, {JUMP} SELECT cycle, i, j, f10, f30, jump FROM jumps")
relational("poisson_persistence", f"WITH {PAST}, {COUNTS} SELECT cycle, i, j, f10, round(1 - exp(-(f10 / 10.0D) * 30), 6) AS p30, round(1 - exp(-(f10 / 10.0D) * 60), 6) AS p60 FROM counts")
# Counts and label of a storm from one pass over storms and flashes: those before it and in it (o >= 0) and those after it.
AROUND = f"""around AS (SELECT f.*, f.cycle + t.o AS at, t.o FROM {{v_flash}} f CROSS JOIN (VALUES (-3), (-2), (-1), (0), (1), (2)) AS t(o)),
counts AS (SELECT c.cycle, c.i, c.j, c.intensity, CAST(coalesce(sum(f.strokes) FILTER (WHERE f.o = 0), 0) AS BIGINT) AS f10, CAST(coalesce(sum(f.strokes) FILTER (WHERE f.o >= 0), 0) AS BIGINT) AS f30,
  max(CASE WHEN f.o < 0 AND {BOX.format(r="5.0D")} THEN 1 ELSE 0 END) AS y FROM {{v_storm}} c LEFT JOIN around f ON f.at = c.cycle AND {BOX.format(r="12.0D")} GROUP BY c.cycle, c.i, c.j, c.intensity)"""
relational("nowcast_verification", f"""WITH {AROUND}, {JUMP}, samples AS (SELECT jump, 1 - exp(-(f10 / 10.0D) * 30) AS p, y FROM jumps)
SELECT count(*) AS n, coalesce(sum(jump), 0) AS jumps, count(*) FILTER (WHERE p >= 0.35D AND y = 1) AS hits, count(*) FILTER (WHERE p < 0.35D AND y = 1) AS misses, count(*) FILTER (WHERE p >= 0.35D AND y = 0) AS false_alarms, count(*) FILTER (WHERE p < 0.35D AND y = 0) AS correct_negatives, round(avg((p - y) * (p - y)), 6) AS brier FROM samples""")
IN_GRID = "lat BETWEEN 25.05D AND 26.05D AND lon BETWEEN 83.95D AND 84.95D"
relational("grid_index", f"SELECT event_id, CASE WHEN {IN_GRID} THEN CAST(bround((lat - 26.0D) / -0.1D, 0) AS INT) END AS row_i, CASE WHEN {IN_GRID} THEN CAST(bround((lon - 84.0D) / 0.1D, 0) AS INT) END AS col_j FROM (SELECT event_id, lat + (event_id % 11 - 5) * 0.05D AS lat, lon + (event_id % 13 - 6) * 0.04D AS lon FROM {{v_obs}}) o")
relational("haversine", "SELECT event_id, round(2 * 6371.0088D * asin(sqrt(pow(sin(radians(lat - 25.6D) / 2), 2) + cos(radians(25.6D)) * cos(radians(lat)) * pow(sin(radians(lon - 84.5D) / 2), 2))), 6) AS km FROM {v_obs}")
relational("proxy_intensity", "SELECT event_id, round(least(greatest((300 - (180 + value / 3)) / 95, 0D), 1D) * 255, 6) AS ir_proxy, round(least(greatest(value / 50, 0D), 1D) * 255, 6) AS rain_proxy FROM {v_obs}")
relational("shear_brn", "WITH x AS (SELECT event_id, value * 10 AS cape, least(sqrt(pow(value / 10, 2) + pow(station * 2D, 2)), 100D) AS shear FROM {v_obs} WHERE modality = 'model') SELECT event_id, round(shear, 6) AS shear, round(least(greatest(cape / greatest(0.5D * shear * shear, 1D), 0D), 500D), 6) AS brn FROM x")
relational("planck_bt", "SELECT event_id, round(least(greatest(1.4387769D * 930 / ln(1 + 0.0000119104D * 930D * 930 * 930 / greatest(value, 0.001D)), 150D), 350D), 6) AS kelvin FROM {v_obs} WHERE modality = 'satellite'")
relational("channel_norm", "SELECT event_id, round(least(greatest((value - 0D) / 75, 0D), 1D), 6) AS radar, round(1 - least(greatest((value - 180D) / 140, 0D), 1D), 6) AS tir1 FROM {v_obs}")
relational("risk_band", "SELECT lead, CASE WHEN p <= 0.2D THEN 'LOW' WHEN p <= 0.4D THEN 'MODERATE' WHEN p <= 0.6D THEN 'ELEVATED' WHEN p <= 0.8D THEN 'HIGH' ELSE 'SEVERE' END AS band, count(*) AS n FROM {v_pred} GROUP BY 1, 2")
relational("qc_range_flags", "SELECT modality, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value > 250) AS above, round(min(value), 6) AS lo, round(max(value), 6) AS hi, CAST(min(value) = max(value) AS INT) AS is_constant FROM {v_obs} GROUP BY modality")
relational("modality_health", "WITH f AS (SELECT modality, cycle, CASE WHEN max(value) > 450 THEN 'SUSPECT' ELSE 'OK' END AS status FROM {v_obs} GROUP BY modality, cycle) SELECT modality, CASE WHEN count(*) FILTER (WHERE status = 'SUSPECT') > 0 THEN 'SUSPECT' ELSE 'OK' END AS health, count(*) AS frames FROM f GROUP BY modality")
relational("availability", "WITH t AS (SELECT max(s) AS now FROM {v_obs}) SELECT modality, CAST(max(t.now) - max(s) <= CASE WHEN modality = 'model' THEN 43200 ELSE 1800 END AS INT) AS available FROM {v_obs}, t GROUP BY modality")
relational("contingency_scores", """WITH c AS (SELECT lead, count(*) FILTER (WHERE p >= 0.35D AND y = 1) AS h, count(*) FILTER (WHERE p < 0.35D AND y = 1) AS m, count(*) FILTER (WHERE p >= 0.35D AND y = 0) AS fa, count(*) FILTER (WHERE p < 0.35D AND y = 0) AS cn FROM {v_pred} GROUP BY lead)
SELECT *, round(h / nullif(CAST(h + m AS DOUBLE), 0), 6) AS pod, round(fa / nullif(CAST(h + fa AS DOUBLE), 0), 6) AS far, round(h / nullif(CAST(h + m + fa AS DOUBLE), 0), 6) AS csi FROM c""")
relational("brier_bss", "WITH b AS (SELECT lead, avg(y) AS base FROM {v_pred} GROUP BY lead) SELECT q.lead, round(avg(pow(p - y, 2)), 6) AS brier, round(1 - avg(pow(p - y, 2)) / nullif(avg(pow(base - y, 2)), 0), 6) AS bss FROM {v_pred} q JOIN b ON q.lead = b.lead GROUP BY q.lead")
BINS = "bins AS (SELECT * FROM (VALUES (0, 0D, 0.2D), (1, 0.2D, 0.4D), (2, 0.4D, 0.6D), (3, 0.6D, 0.8D), (4, 0.8D, 1.0D)) AS t(bin, lo, hi))"
BINNED = """found AS (SELECT CASE WHEN p >= 0.8D THEN 4 WHEN p >= 0.6D THEN 3 WHEN p >= 0.4D THEN 2 WHEN p >= 0.2D THEN 1 ELSE 0 END AS k, count(*) AS n, avg(p) AS mp, avg(y) AS oy FROM {v_pred} WHERE p >= 0 AND p <= 1 GROUP BY 1),
binned AS (SELECT bin, coalesce(n, 0) AS n, mp, oy FROM bins LEFT JOIN found ON k = bin)"""
relational("reliability", f"WITH {BINS}, {BINNED} SELECT bin, n, round(mp, 6) AS mean_p, round(oy, 6) AS observed, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS sharpness FROM binned")
relational("murphy", f"""WITH {BINS}, {BINNED}, w AS (SELECT avg(y) AS base, count(*) AS total, avg(pow(p - y, 2)) AS brier FROM {{v_pred}}),
m AS (SELECT sum(n * pow(mp - oy, 2)) / max(total) AS rel, sum(n * pow(oy - base, 2)) / max(total) AS res, max(base * (1 - base)) AS unc, max(brier) AS brier FROM binned, w)
SELECT round(brier, 6) AS brier, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty, round(rel - res + unc, 6) AS decomposed FROM m""")
relational("monotone_reliability", f"WITH {BINS}, {BINNED}, x AS (SELECT oy - lag(oy) OVER (ORDER BY bin) AS d FROM binned WHERE n > 0) SELECT CAST(coalesce(min(d), 0) >= -0.00001D AS INT) AS monotone FROM x")
relational("ece_slope", f"WITH {BINS}, {BINNED} SELECT round(sum(n * abs(mp - oy)) / sum(n), 6) AS ece, round(regr_slope(oy, mp), 6) AS slope, round(regr_intercept(oy, mp), 6) AS intercept FROM binned WHERE n > 0")
relational("climatology", "SELECT lead, round(avg(y), 6) AS p FROM {v_pred} GROUP BY lead")
relational("router_rung", "SELECT cycle, CASE WHEN count(DISTINCT modality) = 5 THEN 'FUSION' WHEN count(*) FILTER (WHERE modality = 'radar') > 0 AND count(*) FILTER (WHERE modality = 'model') > 0 THEN 'PHYSICS' WHEN count(*) FILTER (WHERE modality = 'lightning') > 0 THEN 'PERSISTENCE' ELSE 'CLIMATOLOGY' END AS rung, least(greatest(0.35D + 0.15D * greatest(0, count(DISTINCT modality) - 1), 0.05D), 0.9D) AS confidence FROM {v_obs} GROUP BY cycle")
relational("mosaic_max", "SELECT cycle, i, j, max(least(value, 75D)) AS dbz, count(DISTINCT station) AS coverage FROM {v_obs} WHERE modality = 'radar' AND value >= 5 GROUP BY cycle, i, j")
OFFSETS = "d AS (SELECT a.o AS di, b.o AS dj FROM (VALUES (-1), (0), (1)) AS a(o), (VALUES (-1), (0), (1)) AS b(o))"
relational("box_blur", f"WITH {OFFSETS}, t AS (SELECT p.frame, p.i, p.j, least(greatest(p.i + di, 0), 9) AS si, least(greatest(p.j + dj, 0), 9) AS sj FROM {{v_pix}} p, d) SELECT t.frame, t.i, t.j, round(sum(coalesce(q.value, 0)) / 9, 6) AS blurred FROM t LEFT JOIN {{v_pix}} q ON q.frame = t.frame AND q.i = t.si AND q.j = t.sj GROUP BY t.frame, t.i, t.j")
relational("dilate", f"WITH {OFFSETS} SELECT frame, i + di AS i, j + dj AS j, max(value) AS value FROM {{v_pix}}, d WHERE i + di BETWEEN 0 AND 9 AND j + dj BETWEEN 0 AND 9 GROUP BY 1, 2, 3")
relational("grid_shift", "SELECT p.frame, p.i, p.j, coalesce(q.value, 0) AS value FROM {v_pix} p LEFT JOIN {v_pix} q ON q.frame = p.frame AND q.i = p.i - 1 AND q.j = p.j + 2")
# yesterday's frame as the forecast of today's; values of 500 stand for certainty.
FIELDS = "fc AS (SELECT o.frame, o.i, o.j, coalesce(p.value, 0D) / 500 AS p, o.value / 500 AS q FROM {v_pix} o LEFT JOIN {v_pix} p ON p.frame = o.frame - 1 AND p.i = o.i AND p.j = o.j)"
relational("fss_block", f"""WITH {FIELDS}, x AS (SELECT frame, CASE WHEN p >= 0.5D THEN 1D ELSE 0D END AS f, CASE WHEN q >= 0.5D THEN 1D ELSE 0D END AS o FROM fc)
SELECT frame, round(1 - avg(pow(f - o, 2)) / nullif(avg(f) + avg(o), 0), 6) AS fss FROM x GROUP BY frame""")
relational("btd_cooling", "SELECT a.frame, a.i, a.j, round(a.value - b.value, 6) AS cooling FROM {v_pix} a JOIN {v_pix} b ON b.frame = a.frame - 1 AND b.i = a.i AND b.j = a.j")
relational("regrid_nearest", "WITH g AS (SELECT frame, CAST(floor((i + 0.5D) / 2) AS INT) AS gi, CAST(floor((j + 0.5D) / 2) AS INT) AS gj, i, j, value FROM {v_pix}) SELECT frame, gi, gj, value FROM g WHERE i = 2 * gi AND j = 2 * gj")
relational("regrid_bilinear", "SELECT a.frame, a.i, a.j, round((a.value + b.value + c.value + d.value) / 4, 6) AS value FROM {v_pix} a JOIN {v_pix} b ON b.frame = a.frame AND b.i = a.i + 1 AND b.j = a.j JOIN {v_pix} c ON c.frame = a.frame AND c.i = a.i AND c.j = a.j + 1 JOIN {v_pix} d ON d.frame = a.frame AND d.i = a.i + 1 AND d.j = a.j + 1")
relational("raster_min_bbox", "SELECT c.cycle, c.i, c.j, round(min(p.value), 6) AS ir_min, round(max(p.value), 6) AS rain_max, round(avg(p.value), 6) AS rain_mean FROM {v_storm} c JOIN {v_pix} p ON p.frame = CAST(floor(c.cycle / 6) AS INT) AND p.i BETWEEN c.i - 1 AND c.i + 1 AND p.j BETWEEN c.j - 1 AND c.j + 1 GROUP BY c.cycle, c.i, c.j")
# Flashes with a pixel of 235 or more (the views' stand-in for a cold core) within 25 km, longitudes at a fixed cos(22 degrees).
D5 = "d5 AS (SELECT a.o AS di, b.o AS dj FROM (VALUES (-2), (-1), (0), (1), (2)) AS a(o), (VALUES (-2), (-1), (0), (1), (2)) AS b(o))"
relational("colocation_rate", f"""WITH {D5}, near AS (SELECT event_id, CAST(floor(s / 3600) AS INT) AS frame, i + di AS i, j + dj AS j FROM {{v_flash}}, d5 WHERE pow(di * 0.1D * 111.32D, 2) + pow(dj * 0.1D * 111.32D * cos(radians(22D)), 2) <= 625),
x AS (SELECT event_id, max(CASE WHEN p.value >= 235 THEN 1 ELSE 0 END) AS hit FROM near n LEFT JOIN {{v_pix}} p ON p.frame = n.frame AND p.i = n.i AND p.j = n.j GROUP BY event_id) SELECT count(*) AS flashes, round(avg(hit), 6) AS rate FROM x""")
# F1: union of anisotropic kernels on a background; downwind the scale is 2.5 times as long. Motion in pixels comes from the cell's numbers.
REACH = ", ".join(f"({k})" for k in range(-9, 10))
relational("noisy_or_field", f"""WITH d AS (SELECT a.o AS di, b.o AS dj FROM (VALUES {REACH}) AS a(o), (VALUES {REACH}) AS b(o)),
c AS (SELECT cycle, i, j, least(intensity / 250, 0.98D) AS p, ((cycle * 7 + i) % 5 - 2) * 1D AS mx, ((cycle * 3 + j) % 5 - 2) * 1D AS my, sqrt(pow((cycle * 7 + i) % 5 - 2, 2) + pow((cycle * 3 + j) % 5 - 2, 2)) AS speed FROM {{v_storm}}),
g AS (SELECT cycle, i + di AS i, j + dj AS j, p, CASE WHEN speed > 0.001D THEN (dj * mx + di * my) / speed ELSE dj * 1D END AS along, CASE WHEN speed > 0.001D THEN (-dj * my + di * mx) / speed ELSE di * 1D END AS across, speed FROM c, d WHERE p > 0.05D AND i + di BETWEEN 0 AND 9 AND j + dj BETWEEN 0 AND 9),
k AS (SELECT cycle, i, j, p * exp(-0.5D * (pow(along / CASE WHEN along > 0 AND speed > 0.001D THEN 3.75D ELSE 1.5D END, 2) + pow(across / 1.5D, 2))) AS k FROM g)
SELECT cycle, i, j, round(1 - 0.95D * exp(sum(ln(1 - least(k, 0.999D)))), 6) AS prob FROM k GROUP BY cycle, i, j""")
relational("uncertainty_field", "SELECT frame, i, j, round(least(greatest(0.45D * 4 * (value / 500) * (1 - value / 500) + 0.3D * 0.5D + 0.1D, 0.05D), 1D), 6) AS sigma FROM {v_pix}")
TRACK = "SELECT *, lag(lat) OVER w AS lat_0, lag(lon) OVER w AS lon_0, lag(area) OVER w AS area_0, lag(intensity) OVER w AS int_0, lag(b) OVER w AS b_0, row_number() OVER w AS k FROM {v_cell} WINDOW w AS (PARTITION BY track ORDER BY b)"
relational("motion_heading", f"WITH t AS ({TRACK}) SELECT track, b, k - 1 AS age, round(lat - lat_0, 6) + 0D AS motion_dlat, round(lon - lon_0, 6) + 0D AS motion_dlon, round(sqrt(pow((lat - lat_0) * 111.32D, 2) + pow((lon - lon_0) * 111.32D * cos(radians(lat)), 2)) / ((b - b_0) * 6D), 6) AS speed FROM t")
relational("lifecycle", f"WITH t AS ({TRACK}) SELECT track, b, CASE WHEN k = 1 THEN 'INITIATING' WHEN area - area_0 >= 2 AND intensity > int_0 THEN 'GROWING' WHEN area - area_0 <= -2 AND intensity < int_0 THEN 'DECAYING' WHEN k >= 3 THEN 'MATURE' ELSE 'GROWING' END AS state FROM t")
relational("growth_10", "SELECT track, b, area, max(area) OVER (PARTITION BY track ORDER BY b RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING) AS area_before FROM {v_cell}")
relational("sliding_60_10", "WITH k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) AS t(k)) SELECT cycle + k AS window_end, modality, count(*) AS n, round(max(value), 6) AS top FROM {v_obs}, k GROUP BY cycle + k, modality")
relational("jump_5min_bins", "WITH b AS (SELECT i, j, CAST(floor(s / 300) AS BIGINT) AS b, count(*) AS n FROM {v_flash} GROUP BY 1, 2, 3) SELECT i, j, b, n, round(avg(n) OVER w, 6) AS mean8, round(stddev_pop(n) OVER w, 6) AS sd8 FROM b WINDOW w AS (PARTITION BY i, j ORDER BY b ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING)")
relational("topk_events", "SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id DESC) AS rank FROM (SELECT user_id, count(*) AS n FROM {v_obs} WHERE modality = 'lightning' GROUP BY user_id ORDER BY n DESC, user_id DESC LIMIT 12) t")
relational("modality_intersect", "SELECT user_id FROM {v_obs} WHERE modality = 'radar' INTERSECT SELECT user_id FROM {v_obs} WHERE modality = 'lightning' INTERSECT SELECT user_id FROM {v_obs} WHERE modality = 'satellite'")
relational("buffer_upsert", "SELECT modality, station, cycle, value FROM (SELECT *, row_number() OVER (PARTITION BY modality, station, cycle ORDER BY event_id DESC) AS k FROM {v_obs}) WHERE k = 1")
relational("buffer_retention", "WITH t AS (SELECT modality AS m, max(s) AS top FROM {v_obs} GROUP BY modality), r AS (SELECT modality, event_id, s, row_number() OVER (PARTITION BY modality ORDER BY s DESC, event_id DESC) AS k FROM {v_obs} JOIN t ON modality = m WHERE s >= top - 14400) SELECT modality, event_id, s FROM r WHERE k <= 50")
relational("preset_stage", "SELECT o_orderkey, CASE WHEN p >= CASE preset WHEN 'protective' THEN 0.6D ELSE 0.7D END THEN 'RED' WHEN p >= CASE preset WHEN 'protective' THEN 0.3D ELSE 0.5D END THEN 'ORANGE' WHEN p >= CASE preset WHEN 'protective' THEN 0.15D ELSE 0.2D END THEN 'YELLOW' ELSE 'GREEN' END AS stage FROM {v_alert}")
relational("imd_colour", "SELECT CASE WHEN p >= 0.75D AND cell % 3 = 0 THEN 'RED' WHEN p >= 0.5D THEN 'ORANGE' WHEN p >= 0.2D THEN 'YELLOW' ELSE 'GREEN' END AS colour, preset, count(*) AS n FROM {v_alert} GROUP BY 1, 2")
relational("severity_impact", "SELECT s_suppkey, round(CASE WHEN population <= 0 THEN 0D ELSE least(log10(population + 1.0D) / log10(500001.0D), 1D) END, 6) AS exposure FROM {v_block}")
relational("exposure_rollup", "SELECT state, district, sum(population) AS population, count(*) AS blocks FROM {v_block} GROUP BY ROLLUP (state, district)")
# Boxes of cells and blocks meet on tiles of 0.2 degrees; a pair counts on the first tile that both have.
TWO = "(VALUES (0), (1))"
TILES = f"""bt AS (SELECT b.*, CAST(floor(lat0 * 5) AS INT) + y.o AS ty, CAST(floor(lon0 * 5) AS INT) + x.o AS tx FROM {{v_block}} b, {TWO} AS y(o), {TWO} AS x(o) WHERE floor(lat0 * 5) + y.o <= floor((lat1 + 0.001D) * 5) AND floor(lon0 * 5) + x.o <= floor((lon1 + 0.001D) * 5))"""
OVERLAP = f"""{TILES}, ct AS (SELECT c.*, CAST(floor((lat - 0.05D) * 5) AS INT) + y.o AS cty, CAST(floor((lon - 0.05D) * 5) AS INT) + x.o AS ctx FROM {{v_storm}} c, {TWO} AS y(o), {TWO} AS x(o) WHERE floor((lat - 0.05D) * 5) + y.o <= floor((lat + 0.05D) * 5) AND floor((lon - 0.05D) * 5) + x.o <= floor((lon + 0.05D) * 5)),
o AS (SELECT c.cycle, c.i, c.j, c.lat, c.lon, b.s_suppkey, b.state, b.district, b.block, b.population, round((least(b.lat1, c.lat + 0.05D) - greatest(b.lat0, c.lat - 0.05D)) * (least(b.lon1, c.lon + 0.05D) - greatest(b.lon0, c.lon - 0.05D)) / 0.01D, 4) AS fraction,
  CASE WHEN c.lat > b.lat0 + 0.001D AND c.lat < b.lat1 - 0.001D AND c.lon > b.lon0 + 0.001D AND c.lon < b.lon1 - 0.001D THEN 1 ELSE 0 END AS inside
  FROM ct c JOIN bt b ON b.ty = c.cty AND b.tx = c.ctx AND b.lat0 < c.lat + 0.0499D AND b.lat1 > c.lat - 0.0499D AND b.lon0 < c.lon + 0.0499D AND b.lon1 > c.lon - 0.0499D
  WHERE b.ty = greatest(floor(b.lat0 * 5), floor((c.lat - 0.05D) * 5)) AND b.tx = greatest(floor(b.lon0 * 5), floor((c.lon - 0.05D) * 5)))"""
HIT = "hit AS (SELECT *, CAST(round(population * least(1D, greatest(CASE WHEN inside = 1 THEN 0.15D ELSE 0.05D END, fraction)), 0) AS BIGINT) AS exposed FROM o WHERE fraction >= 0.1D OR inside = 1)"
relational("block_overlap", f"WITH {OVERLAP}, {HIT} SELECT cycle, i, j, s_suppkey, fraction, inside, exposed, row_number() OVER (PARTITION BY cycle, i, j ORDER BY fraction DESC, s_suppkey) AS rank FROM hit")
# A point's tile is one; boxes stand for the blocks' polygons here, geocode_polygons (products.py) has rings.
relational("point_in_block", f"WITH {TILES} SELECT f.event_id, count(*) AS blocks, min(b.s_suppkey) AS first_block FROM {{v_flash}} f JOIN bt b ON b.ty = CAST(floor(f.lat * 5) AS INT) AND b.tx = CAST(floor(f.lon * 5) AS INT) AND f.lat > b.lat0 + 0.001D AND f.lat < b.lat1 + 0.001D AND f.lon > b.lon0 + 0.001D AND f.lon < b.lon1 + 0.001D GROUP BY f.event_id")
relational("bulletin", "SELECT CAST(floor(minute / 1440) AS BIGINT) AS day, count(*) AS alerts, count(DISTINCT cell) AS cells, max(CASE WHEN p >= 0.7D THEN 3 WHEN p >= 0.5D THEN 2 WHEN p >= 0.25D THEN 1 ELSE 0 END) AS stage FROM {v_alert} GROUP BY 1")
# Latitude,longitude pairs of the box, closed; the views' boxes lie on tenths of a degree.
TENTH = "concat(CAST(CAST(floor(floor({x} * 10 + 0.5D) / 10) AS INT) AS STRING), '.', CAST(CAST(floor({x} * 10 + 0.5D) AS INT) % 10 AS STRING))"
RING = "concat_ws(' ', " + ", ".join(f"concat({TENTH.format(x=a)}, ',', {TENTH.format(x=b)})" for a, b in (("lat0", "lon0"), ("lat0", "lon1"), ("lat1", "lon1"), ("lat1", "lon0"), ("lat0", "lon0"))) + ")"
relational("cap_polygon", f"SELECT s_suppkey, {RING} AS ring FROM {{v_block}}")
# The rank of a user is the count of users in lower buckets, of which there are 1009, and its rank within its own.
relational("event_split", """WITH u AS (SELECT DISTINCT user_id, user_id * 7919 % 1009 AS h FROM {v_obs}), b AS (SELECT h, count(*) AS n FROM u GROUP BY h), c AS (SELECT h AS bucket, sum(n) OVER (ORDER BY h) - n AS below, sum(n) OVER () AS total FROM b),
r AS (SELECT user_id, below + row_number() OVER (PARTITION BY h ORDER BY user_id) AS k, total FROM u JOIN c ON h = bucket) SELECT user_id, CASE WHEN k <= 0.7D * total THEN 'train' WHEN k <= 0.85D * total THEN 'calibrate' ELSE 'test' END AS part FROM r""")
# Weak updraft energy and a strong cap reduce a probability, organised shear raises it a little; missing inputs leave it be.
relational("thermo_gating", """WITH x AS (SELECT event_id, CASE WHEN station = 7 THEN NULL ELSE value * 10 END AS cape, user_id * 3D AS cin, station * 4D AS shear FROM {v_obs} WHERE modality = 'model')
SELECT event_id, round(least(greatest(CASE WHEN cape IS NULL THEN 1D ELSE least(greatest(cape / 1000, 0.1D), 1D) END * CASE WHEN cin > 200 THEN least(greatest(1 - (cin - 200) / 200, 0.1D), 1D) ELSE 1D END
  * CASE WHEN shear >= 15 THEN least(greatest(1 + 0.1D * ((shear - 15) / 10), 1D), 1.2D) ELSE 1D END, 0.1D), 1D), 10) AS gamma FROM x""")
