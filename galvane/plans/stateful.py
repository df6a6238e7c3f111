"""Queries over ordered state: kernels in operators, applied by group."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from galvane.operators import kernels, tiles
from galvane.operators.ranks import shared_folder, stored
from galvane.plans.catalog import QUERIES, SQL, query
from galvane.plans.nowcast import CRITERIA, SCORED
from galvane.plans.ranked import isotonic_knots
from galvane.plans.relational import BOX, COUNTS, HIT, JUMP, OVERLAP, PAST, duck_words, for_duckdb
from galvane.sources import store, views
from galvane.streaming import settlement

def cc_sql(mask: str, near: str = "abs(m.i - r.i) + abs(m.j - r.j) = 1") -> str:
    """DuckDB: components of mask (a query of frame, i, j); near: when are two pixels next to each other?"""
    body = f"""SELECT * FROM (WITH RECURSIVE m AS (SELECT frame, i, j, i * 10 + j AS id FROM ({mask})),
r AS (SELECT frame, id, i, j, id AS seed FROM m UNION SELECT m.frame, m.id, m.i, m.j, r.seed FROM r JOIN m ON m.frame = r.frame AND {near}),
c AS (SELECT frame, id, i, j, min(seed) AS seed FROM r GROUP BY ALL)
SELECT frame, i, j, CAST(dense_rank() OVER (PARTITION BY frame ORDER BY seed) AS INT) AS label FROM c) AS cc"""
    return body


AT_60, AT_200 = (for_duckdb(f"SELECT frame, i, j FROM {{v_pix}} WHERE value >= {x}") for x in (60, 200))
CC_SQL = cc_sql(AT_60)
EIGHT_WAYS = "greatest(abs(m.i - r.i), abs(m.j - r.j)) = 1"


def components(spark: SparkSession, sf_dir: str, threshold: float = 60.0) -> DataFrame:
    mask = views.v_pix(spark, sf_dir).where(F.col("value") >= threshold).select("frame", "i", "j")
    return mask.groupBy("frame").applyInPandas(lambda x: kernels.label_components(x), "frame int, i int, j int, label int")


@query("cc_components", CC_SQL)
def cc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir)


@query("cc_tiles", CC_SQL)
def cc_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels from tiles of four pixels a side, united at their borders."""
    return tiles.labelled(views.v_pix(spark, sf_dir).where("value >= 60").select("frame", "i", "j"), tile=4)


#: Levels of a storm's shield, its cores and their tops.
LEVELS = (60, 200, 350)
LEVELS_SQL = "SELECT a.frame, a.i, a.j, a.label AS label_0, coalesce(b.label, 0) AS label_1, coalesce(c.label, 0) AS label_2 FROM ({}) a LEFT JOIN ({}) b ON b.frame = a.frame AND b.i = a.i AND b.j = a.j LEFT JOIN ({}) c ON c.frame = a.frame AND c.i = a.i AND c.j = a.j".format(
    *(cc_sql(for_duckdb(f"SELECT frame, i, j FROM {{v_pix}} WHERE value >= {x}")) for x in LEVELS)
)


@query("storm_levels", LEVELS_SQL)
def storm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.levels(views.v_pix(spark, sf_dir).select("frame", "i", "j", "value"), LEVELS, tile=5)


STATS_SQL = f"""SELECT c.frame, label, count(*) AS area, min(c.i) AS i0, max(c.i) AS i1, min(c.j) AS j0, max(c.j) AS j1, round(max(value), 6) AS top, round(avg(value), 6) AS mean
FROM ({CC_SQL}) c JOIN ({for_duckdb("SELECT * FROM {v_pix}")}) p ON p.frame = c.frame AND p.i = c.i AND p.j = c.j GROUP BY c.frame, label HAVING count(*) >= 2"""


@query("cell_stats", STATS_SQL)
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = components(spark, sf_dir).join(views.v_pix(spark, sf_dir), ["frame", "i", "j"]).groupBy("frame", "label")
    box = [F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")]
    return by.agg(F.count("*").alias("area"), *box, F.round(F.max("value"), 6).alias("top"), F.round(F.avg("value"), 6).alias("mean")).where("area >= 2")


@query("cc_components_8", cc_sql(AT_200, EIGHT_WAYS))
def cc_components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners join too."""
    mask = views.v_pix(spark, sf_dir).where("value >= 200").select("frame", "i", "j")
    return mask.groupBy("frame").applyInPandas(lambda x: kernels.label_components(x, corners=True), "frame int, i int, j int, label int")


CI_PIXELS = f"WITH {CRITERIA} SELECT frame, i, j, ir, cooling, ir_wv, split FROM ci"
CLUSTER = """p AS (SELECT *, least(greatest({scored}, 0.4D), 0.98D) AS raw FROM (SELECT frame, label, count(*) AS pixels, avg(i) AS ci, avg(j) AS cj, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, avg(cooling) AS cooling, min(ir) AS ir, avg(ir_wv) AS ir_wv, avg(split) AS split FROM {labelled} GROUP BY frame, label) x),
lead AS (SELECT *, least(greatest(CAST(bround(45 - 30 * ((raw - 0.4D) / 0.45D), 0) AS INT), 15), 45) AS lead FROM p)
SELECT frame, label, pixels, round(ci, 6) AS ci, round(cj, 6) AS cj, i0, i1, j0, j1, round(cooling, 10) AS cooling, round(ir, 6) AS ir, round(raw, 6) AS p, lead, round(pixels * 11.1D * 11.1D * cos(radians(25.55D)), 6) AS area FROM lead"""
CI_LABELLED = f"""SELECT l.label, x.* FROM ({cc_sql("SELECT frame, i, j FROM (" + for_duckdb(CI_PIXELS) + ")", EIGHT_WAYS)}) l JOIN ({for_duckdb(CI_PIXELS)}) x ON x.frame = l.frame AND x.i = l.i AND x.j = l.j"""
CI_SQL = f"WITH labelled AS ({CI_LABELLED}), " + duck_words(CLUSTER.format(scored=SCORED, labelled="labelled"))


@query("initiation_clusters", CI_SQL)
def initiation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels that meet the criteria as 8-connected clusters with their probability, lead and area."""
    names = ("v_pix", "v_storm")
    pixels = spark.sql(CI_PIXELS, **{v: views.VIEWS[v](spark, sf_dir) for v in names})
    schema = "frame int, i int, j int, ir double, cooling double, ir_wv double, split double, label int"
    labelled = pixels.groupBy("frame").applyInPandas(lambda x: kernels.label_components(x, corners=True), schema)
    return spark.sql("WITH " + CLUSTER.format(scored=SCORED, labelled="{labelled}"), labelled=labelled)


OFFSETS_9 = ", ".join(f"({k})" for k in range(-9, 10))
PLUMES = f"""leads AS (SELECT * FROM (VALUES (15), (30), (45), (60)) AS t(lead)), d AS (SELECT a.o AS di, b.o AS dj FROM (VALUES {OFFSETS_9}) AS a(o), (VALUES {OFFSETS_9}) AS b(o)),
k AS (SELECT frame, l.lead, CAST(floor(ci + 0.5D) AS INT) + di AS i, CAST(floor(cj + 0.5D) AS INT) + dj AS j, ci, cj, p * exp(-0.5D * pow((c.lead - l.lead) / 15D, 2)) AS top, greatest(1.5D, sqrt(greatest(10D, area) / (pi() * 100))) AS r FROM clusters c, leads l, d WHERE abs(c.lead - l.lead) <= 25)
SELECT frame, lead, i, j, round(1 - exp(sum(ln(1 - least(top * exp(-0.5D * (pow((i - ci) / r, 2) + pow((j - cj) / r, 2))), 0.999D)))), 6) AS prob FROM k WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 GROUP BY frame, lead, i, j"""


@query("initiation_grid", f"WITH clusters AS ({CI_SQL}), {duck_words(PLUMES)}")
def initiation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plumes of clusters whose lead is within 25 minutes of the one asked for, as a union of probabilities."""
    return spark.sql("WITH clusters AS (SELECT * FROM {found}), " + PLUMES, found=initiation_clusters(spark, sf_dir))


CORES_SQL = f"""WITH b AS ({CC_SQL}), k AS ({cc_sql(AT_200)}),
c AS (SELECT b.frame, b.label, k.label AS core, avg(b.i) AS ci, avg(b.j) AS cj FROM b JOIN k ON b.frame = k.frame AND b.i = k.i AND b.j = k.j GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT *, count(*) OVER (PARTITION BY frame, label) AS cores FROM c),
d AS (SELECT b.*, coalesce(core, 0) AS core, row_number() OVER (PARTITION BY b.frame, b.i, b.j ORDER BY round(pow(b.i - ci, 2) + pow(b.j - cj, 2), 9), core) AS nth FROM b LEFT JOIN m ON m.frame = b.frame AND m.label = b.label AND cores >= 2)
SELECT frame, i, j, label, CAST(core AS INT) AS core FROM d WHERE nth = 1"""


@query("watershed_cores", CORES_SQL)
def watershed_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with two or more strong cores: each pixel goes to its nearest core; others have core 0."""
    base, strong = components(spark, sf_dir), components(spark, sf_dir, 200.0).withColumnRenamed("label", "core")
    by = base.join(strong, ["frame", "i", "j"]).groupBy("frame", "label", "core")
    cores = by.agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.count("*").alias("n")).where("n >= 2")
    several = cores.withColumn("cores", F.count("*").over(Window.partitionBy("frame", "label"))).where("cores >= 2")
    far = F.round((F.col("i") - F.col("ci")) ** 2 + (F.col("j") - F.col("cj")) ** 2, 9)
    near = base.join(several, ["frame", "label"], "left").groupBy("frame", "i", "j", "label").agg(F.min_by("core", F.struct(far, "core")).alias("core"))
    return near.select("frame", "i", "j", "label", F.coalesce("core", F.lit(0)).alias("core"))


@query("track_cells")
def track_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm cells of each event, tracked over its cycles; galvane.streaming.ordered has the stream."""
    storms = views.v_storm(spark, sf_dir).withColumn("event", F.floor(F.col("cycle") / views.EVENT_CYCLES).cast("long"))
    rows = storms.withColumn("label", (F.col("i") * 10 + F.col("j")).cast("int")).select("event", "cycle", "label", "lat", "lon")

    def one(key, rows):
        out = kernels.track_cells(rows)
        out.insert(0, "event", key[0])
        return out

    return rows.groupBy("event").applyInPandas(one, "event bigint, cycle bigint, label int, cell_id string, age int, merged boolean, split boolean, speed_kmh double")


ALERTS = """WITH p AS (SELECT * FROM (VALUES ('protective', 0.6D, 0.3D, 0.15D, 0.2D), ('operational', 0.7D, 0.5D, 0.2D, 0.35D)) AS t(preset, red, orange, yellow, least_confidence)),
g AS (SELECT cycle, i, j, max_by(district, fraction * 1000 - s_suppkey / 1000000D) AS region, {collected} AS blocks, sum(exposed) AS exposed FROM hit GROUP BY cycle, i, j),
c AS (SELECT c.cycle, c.i, c.j, jump, least(c.intensity / 250, 0.98D) AS p, least(greatest(0.35D + c.f30 / 20D, 0.05D), 0.9D) AS confidence FROM jumps c),
s AS (SELECT c.*, p.preset, CASE WHEN jump = 1 OR c.p >= red THEN 3 WHEN c.p >= orange THEN 2 WHEN c.p >= yellow THEN 1 ELSE 0 END AS stage FROM c, p WHERE confidence >= least_confidence)
SELECT CAST(floor(s.cycle / 144) AS BIGINT) AS event, s.preset, s.cycle * 100 + s.i * 10 + s.j AS id, s.cycle * 10D AS minute, CAST(s.i * 10 + s.j AS BIGINT) AS cell, coalesce(region, concat('open ', CAST(s.i AS STRING), ' ', CAST(s.j AS STRING))) AS region,
  coalesce(blocks, {none}) AS blocks, stage, jump, p, coalesce(exposed, 0) AS exposed FROM s LEFT JOIN g ON g.cycle = s.cycle AND g.i = s.i AND g.j = s.j WHERE stage > 0"""


STAGED = f"WITH {PAST}, {COUNTS}, {JUMP}, {OVERLAP}, {HIT}, " + ALERTS.removeprefix("WITH ")
# DuckDB: row by row of each event and preset; a step holds what went out within the window.
WALK_SQL = """WITH RECURSIVE staged AS ({staged}), r AS (SELECT *, row_number() OVER (PARTITION BY event, preset ORDER BY minute, id) AS k FROM staged),
w AS (SELECT event, preset, k, id, [struct_pack(id := id, minute := minute, cell := cell, region := region, blocks := blocks, stage := stage, jump := jump)] AS sent, 'alert' AS verdict, CAST(NULL AS BIGINT) AS supersedes FROM r WHERE k = 1
UNION ALL SELECT event, preset, k, id, CASE WHEN verdict = 'suppressed' THEN live ELSE list_append(live, own) END, verdict, CASE WHEN verdict = 'update' THEN old.id END
FROM (SELECT *, CASE WHEN old IS NULL THEN 'alert' WHEN own.jump = 1 AND old.jump = 0 OR own.stage > old.stage THEN 'update' ELSE 'suppressed' END AS verdict
FROM (SELECT *, list_filter(live, lambda x: x.cell = own.cell OR x.region = own.region OR list_has_any(x.blocks, own.blocks))[-1] AS old
FROM (SELECT r.event, r.preset, r.k, r.id, struct_pack(id := r.id, minute := r.minute, cell := r.cell, region := r.region, blocks := r.blocks, stage := r.stage, jump := r.jump) AS own, list_filter(w.sent, lambda x: r.minute - x.minute < 45) AS live
FROM w JOIN r ON r.event = w.event AND r.preset = w.preset AND r.k = w.k + 1) a) b) c)
SELECT s.* EXCLUDE (blocks), w.verdict, w.supersedes FROM staged s JOIN w ON w.event = s.event AND w.preset = s.preset AND w.id = s.id WHERE w.verdict <> 'suppressed'"""
ALERTS_SQL = WALK_SQL.replace("{staged}", for_duckdb(STAGED.replace("{collected}", "list_sort(list(DISTINCT s_suppkey))").replace("{none}", "[]")))


def in_cases(text: str) -> str:
    """text with alerts decided within each case of EVENT_CYCLES, as the bundles of cases have them; `alerts` itself walks 144 cycles."""
    return text.replace("s.cycle / 144", f"s.cycle / {views.EVENT_CYCLES}")


def sent_alerts(spark: SparkSession, sf_dir: str, staged_text: str = STAGED) -> DataFrame:
    text = staged_text.replace("{collected}", "array_sort(collect_set(s_suppkey))").replace("{none}", "array()")
    staged = stored(spark.sql(text, **{v: views.VIEWS[v](spark, sf_dir) for v in ("v_flash", "v_storm", "v_block")}))
    names = ["event", "preset", "id", "minute", "cell", "region", "blocks", "stage", "jump"]

    def walk(batches):
        state = kernels.Suppressor()
        for rows in batches:
            yield state.feed(rows)

    dealt = staged.select(*names).repartition("event", "preset").sortWithinPartitions("event", "preset", "minute", "id")
    verdicts = dealt.mapInPandas(walk, "event bigint, preset string, id bigint, verdict string, supersedes bigint")
    return staged.drop("blocks").join(verdicts.where("verdict <> 'suppressed'"), ["event", "preset", "id"])


@query("alerts", ALERTS_SQL)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets by cells, staged, filtered by confidence, placed in blocks, and suppressed within the event.

    The scan depends on what went out before, so it walks an event's alerts of a preset in order of time; only
    those of the last 45 minutes are held.
    """
    return sent_alerts(spark, sf_dir)


# M10 in DuckDB: of the cumulative outcomes those points are knots that lie above no chord between an earlier and a later one.
KNOTS_SQL = for_duckdb("""WITH s AS (SELECT lead, p, y, count(*) AS n FROM {v_pred} GROUP BY lead, p, y),
c AS (SELECT lead, p, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(n * y) OVER w AS cy FROM s WINDOW w AS (PARTITION BY lead ORDER BY p, y)),
z AS (SELECT lead, k, cn, cy FROM c UNION ALL SELECT DISTINCT lead, 0, 0, 0 FROM c),
bent AS (SELECT DISTINCT i.lead, i.k FROM c i JOIN z a ON a.lead = i.lead AND a.k < i.k JOIN z b ON b.lead = i.lead AND b.k > i.k WHERE (i.cy - a.cy) * (b.cn - i.cn) > (b.cy - i.cy) * (i.cn - a.cn)),
e AS (SELECT lead, p, k, cn - lag(cn, 1, 0) OVER w AS n, cy - lag(cy, 1, 0) OVER w AS pos FROM c WHERE NOT EXISTS (SELECT 1 FROM bent x WHERE x.lead = c.lead AND x.k = c.k) WINDOW w AS (PARTITION BY lead ORDER BY k))
SELECT lead, CAST(row_number() OVER (PARTITION BY lead ORDER BY p) - 1 AS INT) AS ord, p AS threshold, round(max_by(pos / CAST(n AS DOUBLE), k), 6) AS value FROM e GROUP BY lead, p""")


@query("isotonic_fit", KNOTS_SQL)
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in order of score, then outcome."""
    return isotonic_knots(spark, sf_dir)


CALIBRATED_SQL = for_duckdb(f"""WITH knots AS (SELECT * FROM ({KNOTS_SQL}) x), g AS (SELECT lead, p FROM {{v_pred}} GROUP BY lead, p),
n AS (SELECT *, lead(threshold) OVER (PARTITION BY lead ORDER BY ord) AS x1, lead(value) OVER (PARTITION BY lead ORDER BY ord) AS y1 FROM knots)
SELECT g.lead, g.p, round(CASE WHEN g.p < threshold OR x1 IS NULL THEN value ELSE value + (y1 - value) * (g.p - threshold) / (x1 - threshold) END, 6) AS calibrated
FROM g JOIN n ON n.lead = g.lead AND (g.p >= threshold AND (x1 IS NULL OR g.p < x1) OR ord = 0 AND g.p < threshold)""")


@query("isotonic_apply", CALIBRATED_SQL)
def isotonic_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation between the knots, ends clamped, by a range join with each knot's next."""
    w = Window.partitionBy("lead").orderBy("ord")
    knots = isotonic_fit(spark, sf_dir).select("lead", F.col("threshold").alias("x0"), F.col("value").alias("y0"), F.lead("threshold").over(w).alias("x1"), F.lead("value").over(w).alias("y1"), (F.col("ord") == 0).alias("first"))
    scores = views.v_pred(spark, sf_dir).select("lead", "p").distinct()
    below = F.col("p") < F.col("x0")
    hit = (F.col("p") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("p") < F.col("x1"))) | F.col("first") & below
    value = F.when(below | F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("p") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return scores.join(knots, "lead").where(hit).select("lead", "p", F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 6).alias("calibrated"))


CLOCK = f"(us - {views.EPOCH_US}) // 24"
SETTLED_SQL = for_duckdb(f"""WITH leads AS (SELECT * FROM (VALUES (10), (20), (30)) AS t(lead)), now AS (SELECT max({CLOCK}) AS top FROM {{v_obs}}),
f AS (SELECT {CLOCK} AS t, lat, lon FROM {{v_obs}} WHERE modality = 'lightning'),
c AS (SELECT *, CAST(cycle + 1 AS BIGINT) * 600000000 AS issued FROM {{v_storm}}, leads)
SELECT c.cycle, c.i, c.j, c.lead, CAST(EXISTS (SELECT 1 FROM f WHERE f.t > c.issued AND f.t <= c.issued + c.lead * 60000000 AND {BOX.format(r="12.0D")}) AS INT) AS y
FROM c, now WHERE c.issued + c.lead * 60000000 <= top""")


def settlement_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecasts (storm cells at the end of their cycle), flashes and the newest time, on the views' clock."""
    seen = views.v_obs(spark, sf_dir).withColumn("time", F.timestamp_micros(F.floor((F.col("us") - views.EPOCH_US) / 24).cast("long")))
    storms = views.v_storm(spark, sf_dir).select(F.timestamp_micros((F.col("cycle") + 1) * settlement.CYCLE_US).alias("issued"), "i", "j")
    return storms, seen.where("modality = 'lightning'").select("time", "lat", "lon"), seen.agg(F.max("time").alias("now"))


@query("event_time_settlement", SETTLED_SQL)
def event_time_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mature (forecast, lead) with its outcome; galvane.streaming.settlement has the stream."""
    storms, flashes, now = settlement_inputs(spark, sf_dir)
    mature = settlement.settled(storms, flashes).where(F.col("due") <= now.scalar())
    return mature.select((F.unix_micros("issued") / settlement.CYCLE_US - 1).cast("long").alias("cycle"), "i", "j", "lead", "y")


SETTLE_SQL = f"SELECT cycle, i, j, lead, y FROM ({SETTLED_SQL}) q WHERE (cycle + 1) * 600 + lead * 60 > (SELECT max({CLOCK}) FROM ({for_duckdb('SELECT * FROM {v_obs}')}) o) / 2000000"


@query("settle_anti", SETTLE_SQL)
def settle_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the first half of the time puts what it settles in the store; the next one settles what is mature and not there."""
    storms, flashes, now = settlement_inputs(spark, sf_dir)
    every = settlement.settled(storms, flashes).select((F.unix_micros("issued") / settlement.CYCLE_US - 1).cast("long").alias("cycle"), "i", "j", "lead", "y", F.unix_micros("due").alias("due"))
    top = now.select(F.unix_micros("now").alias("top"))
    root = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    store.append(every.where(F.col("due") <= F.floor(top.scalar() / 2)).select(F.lit("first").alias("run_id"), F.lit(1).alias("version"), "cycle", "i", "j", "lead", "y"), root, "settlements")
    done = store.scan(spark, root, "settlements").select("cycle", "i", "j", "lead")
    return every.where(F.col("due") <= top.scalar()).join(done, ["cycle", "i", "j", "lead"], "left_anti").drop("due")


IDS_SQL = f"""WITH RECURSIVE t AS (SELECT frame, i, j, i * 10 + j AS pixel, prev FROM ({SQL['initiation_tracking']}) q),
r AS (SELECT frame, i, j, pixel, frame * 100 + pixel AS first FROM t WHERE prev IS NULL UNION ALL SELECT t.frame, t.i, t.j, t.pixel, r.first FROM r JOIN t ON t.frame = r.frame + 1 AND t.prev = r.pixel)
SELECT frame, i, j, CAST(first AS BIGINT) AS first FROM r"""


def lines(steps: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """node, first: the beginning of each node's line, of steps (node, prev; null: a beginning). Pointers double, so rounds are the logarithm of the longest line."""
    open_ = store(steps.select("node", F.coalesce("prev", "node").alias("first"), F.col("prev").isNull().alias("done")))
    while not open_.where("NOT done").isEmpty():
        ahead = open_.select(F.col("node").alias("first"), F.col("first").alias("then"), F.col("done").alias("ended"))
        open_ = store(open_.join(ahead, "first").select("node", F.when(F.col("done"), F.col("first")).otherwise(F.col("then")).alias("first"), (F.col("done") | F.col("ended")).alias("done")))
    return open_.select("node", "first")


@query("initiation_ids", IDS_SQL)
def initiation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate with the first of its line, whose id it inherits."""
    t = QUERIES["initiation_tracking"](spark, sf_dir)
    node = lambda frame, pixel: frame.cast("long") * 100 + pixel
    steps = t.select(node(F.col("frame"), F.col("i") * 10 + F.col("j")).alias("node"), node(F.col("frame") - 1, F.col("prev")).alias("prev"))
    found = lines(steps)
    pixel = F.col("node") % 100
    return found.select(F.floor(F.col("node") / 100).cast("int").alias("frame"), F.floor(pixel / 10).cast("int").alias("i"), (pixel % 10).cast("int").alias("j"), "first")


@query("training_samples", f"SELECT c.cycle, c.i, c.j, c.intensity, c.f10, c.f20, c.f30, s.lead, s.y AS label FROM ({SQL['flash_counts_10_20_30']}) c JOIN ({SETTLED_SQL}) s ON s.cycle = c.cycle AND s.i = c.i AND s.j = c.j")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each storm cell at issue with its settled label by lead; store.append keeps them by run."""
    numbers = QUERIES["flash_counts_10_20_30"](spark, sf_dir)
    return numbers.join(event_time_settlement(spark, sf_dir).withColumnRenamed("y", "label"), ["cycle", "i", "j"])
