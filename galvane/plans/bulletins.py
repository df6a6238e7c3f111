"""What goes out about alerts: messages, their faults, bulletins; first sight in order.

Everything stands on the decisions of `alerts`: an update names the alert that it supersedes, as the
45-minute rule found it, with the time that one was sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galvane.operators.ranks import running, stored
from galvane.plans import stateful  # noqa: F401
from galvane.plans.catalog import QUERIES, SQL, query
from galvane.plans.relational import duck_words, for_duckdb
from galvane.sources import views


def over_alerts(name: str, text: str) -> None:
    """Register a statement over `alerts`, for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.replace("{alerts}", "{sent}"), sent=stored(QUERIES["alerts"](spark, sf_dir)))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, duck_words(text).replace("{alerts}", f"(SELECT * FROM ({SQL['alerts']}) q)")


# Times are whole minutes on the views' clock; coordinates are hundredths of a degree, so no float is printed.
SENT = "concat(CAST(DATE '2024-01-01' + CAST(floor({m} / 1440) AS INT) AS STRING), 'T', lpad(CAST(CAST(floor({m} / 60) AS BIGINT) % 24 AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor({m}) AS BIGINT) % 60 AS STRING), 2, '0'), ':00+00:00')"
PLACE = "concat(CAST(CAST(floor(({x}) / 100) AS INT) AS STRING), '.', lpad(CAST(({x}) % 100 AS STRING), 2, '0'))"
SOUTH, WEST = "2595 - 10 * CAST(floor(cell / 10) AS INT)", "8395 + 10 * CAST(cell % 10 AS INT)"
CELL_RING = "concat_ws(' ', " + ", ".join(f"concat({PLACE.format(x=f'{SOUTH} + {a}')}, ',', {PLACE.format(x=f'{WEST} + {b}')})" for a, b in ((0, 0), (0, 10), (10, 10), (10, 0), (0, 0))) + ")"
NAMED = "concat('galvane-', preset, '-', CAST({id} AS STRING))"
PARAMETERS = {
    "P_FLASH": "concat('0.', lpad(CAST(CAST(floor(p * 1000 + 0.5D) AS INT) AS STRING), 3, '0'))",
    "LEAD_MINUTES": "'60'",
    "PRESET": "preset",
    "STAGE": "CASE stage WHEN 3 THEN 'RED' WHEN 2 THEN 'ORANGE' ELSE 'YELLOW' END",
    "POPULATION_EXPOSED": "CAST(CAST(exposed AS BIGINT) AS STRING)",
}


def info(language: str, event: str) -> str:
    """One language's block."""
    extra = ", ".join(f"'<parameter><valueName>{k}</valueName><value>', {v}, '</value></parameter>'" for k, v in PARAMETERS.items())
    return f"""concat('<info><language>{language}</language><category>Met</category><event>{event}</event><responseType>', CASE stage WHEN 3 THEN 'Shelter' WHEN 2 THEN 'Prepare' ELSE 'Monitor' END, '</responseType><urgency>',
  CASE WHEN stage = 3 OR jump = 1 THEN 'Immediate' ELSE 'Expected' END, '</urgency><severity>', CASE stage WHEN 3 THEN 'Extreme' WHEN 2 THEN 'Severe' ELSE 'Moderate' END, '</severity><certainty>', CASE WHEN p >= 0.5D THEN 'Likely' ELSE 'Possible' END, '</certainty>',
  {extra}, '<area><areaDesc>', region, '</areaDesc><polygon>', ring, '</polygon></area></info>')"""


MESSAGE = f"""msg AS (SELECT a.*, {CELL_RING.replace("cell", "a.cell")} AS ring, o.minute AS old_minute FROM {{alerts}} a LEFT JOIN {{alerts}} o ON o.event = a.event AND o.preset = a.preset AND o.id = a.supersedes),
cap AS (SELECT event, preset, id, concat('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>', {NAMED.format(id="id")}, '</identifier><sender>galvane</sender><sent>', {SENT.format(m="minute")}, '</sent><status>Test</status><msgType>',
  CASE WHEN supersedes IS NULL THEN 'Alert' ELSE 'Update' END, '</msgType><scope>Public</scope>', CASE WHEN supersedes IS NULL THEN '' ELSE concat('<references>galvane,', {NAMED.format(id="supersedes")}, ',', {SENT.format(m="old_minute")}, '</references>') END,
  {info("en-IN", "Lightning")}, {info("hi-IN", "वज्रपात")}, '</alert>') AS xml FROM msg)"""
over_alerts("cap_full", f"WITH {MESSAGE} SELECT event, preset, id, xml FROM cap")

# Every seventh message is broken in one of four ways, so that there is something to find.
BROKEN = """broken AS (SELECT event, preset, id, CASE id % 7 WHEN 1 THEN replace(xml, '<status>Test<', '<status>Real<') WHEN 2 THEN replace(xml, '<scope>Public</scope>', '') WHEN 3 THEN replace(xml, 'Expected', 'Later') WHEN 4 THEN replace(xml, '<polygon>2', '<polygon>1') ELSE xml END AS xml FROM cap)"""
#: The enumerations of the message format.
ALLOWED = {
    "status": ("Actual", "Exercise", "System", "Test", "Draft"),
    "msgType": ("Alert", "Update", "Cancel", "Ack", "Error"),
    "scope": ("Public", "Restricted", "Private"),
    "urgency": ("Immediate", "Expected", "Future", "Past", "Unknown"),
    "severity": ("Extreme", "Severe", "Moderate", "Minor", "Unknown"),
    "certainty": ("Observed", "Likely", "Possible", "Unlikely", "Unknown"),
}
IN_INFO = ("urgency", "severity", "certainty")
_names = ", ".join(f"regexp_extract(xml, '<{c}>([^<]*)<', 1) AS {c}" for c in ("identifier", *ALLOWED, "polygon"))
_faults = ", ".join(f"CASE WHEN {c} NOT IN ({', '.join(repr(x) for x in xs)}) THEN '{c}' END" for c, xs in ALLOWED.items())
FAULTS_SQL = duck_words(f"""WITH {MESSAGE}, {BROKEN}, f AS (SELECT *, {_names} FROM broken),
e AS (SELECT event, preset, id, concat_ws(';', CASE WHEN identifier = '' THEN 'identifier' END, {_faults}, CASE WHEN length(polygon) - length(replace(polygon, ' ', '')) < 3 THEN 'ring' END, CASE WHEN split_part(polygon, ' ', 1) <> split_part(polygon, ' ', -1) THEN 'open' END) AS faults FROM f)
SELECT faults, count(*) AS n FROM e GROUP BY faults""").replace("{alerts}", f"(SELECT * FROM ({SQL['alerts']}) q)")


def faults(messages: DataFrame) -> DataFrame:
    """messages with faults: which required elements of xml are absent or hold what the format does not allow, and open or short rings."""
    at = {c: f"/alert/{'info/' if c in IN_INFO else ''}{c}" for c in ALLOWED}
    read = lambda path: F.coalesce(F.xpath_string("xml", F.lit(path)), F.lit(""))
    ring = F.split(read("/alert/info/area/polygon"), " ")
    checks = [F.when(read("/alert/identifier") == "", "identifier"), *[F.when(~read(path).isin(*ALLOWED[c]), c) for c, path in at.items()]]
    checks += [F.when(F.size(ring) < 4, "ring"), F.when(F.element_at(ring, 1) != F.element_at(ring, -1), "open")]
    return messages.withColumn("faults", F.concat_ws(";", *checks))


@query("cap_faults", FAULTS_SQL)
def cap_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"WITH {MESSAGE}, {BROKEN} SELECT * FROM broken"
    broken = spark.sql(text.replace("{alerts}", "{sent}"), sent=stored(QUERIES["alerts"](spark, sf_dir)))
    return faults(broken).groupBy("faults").agg(F.count("*").alias("n"))


LIVE = """asked AS (SELECT max(minute) AS t FROM {alerts}), live AS (SELECT a.*, t FROM {alerts} a, asked WHERE minute <= t AND minute + 60 >= t)"""
BULLETIN_SQL = duck_words(f"""WITH {LIVE}, rung AS (SELECT * FROM ({{rung}}) r), seen AS (SELECT preset, region, min(minute * 1000000D + id) AS first, sum(exposed) AS exposed, max(stage) AS stage, count(*) AS n, max(t) AS t FROM live GROUP BY preset, region),
b AS (SELECT preset, string_agg(region, '; ' ORDER BY first) AS regions, CAST(sum(n) AS BIGINT) AS alerts, CAST(sum(exposed) AS BIGINT) AS people, max(stage) AS stage, max(t) AS t FROM seen GROUP BY preset)
SELECT preset, concat(CASE stage WHEN 3 THEN 'RED' WHEN 2 THEN 'ORANGE' ELSE 'YELLOW' END, ' WARNING: THUNDERSTORM AND LIGHTNING NOWCAST') AS headline, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(t AS INT)), '%Y-%m-%d %H:%M:%S UTC') AS issue_time_utc,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(t + 330 AS INT)), '%d-%b-%Y %I:%M %p IST') AS issue_time_ist, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(t + 390 AS INT)), '%d-%b-%Y %I:%M %p IST') AS valid_until_ist,
  regions, alerts, people, coalesce(rung, 'CLIMATOLOGY') AS rung, round(coalesce(confidence, 0.05D), 6) AS confidence FROM b LEFT JOIN rung ON cycle = CAST(floor(t / 10) AS BIGINT)""").replace("{alerts}", f"(SELECT * FROM ({SQL['alerts']}) q)").replace("{rung}", SQL["router_rung"])


def bulletin_at(alerts: DataFrame, minute: DataFrame, rungs: DataFrame, valid: int = 60) -> DataFrame:
    """The bulletin of each preset at a minute (t, one row): alerts valid then, regions in order of first sight, times in UTC and IST."""
    live = alerts.join(F.broadcast(minute)).where((F.col("minute") <= F.col("t")) & (F.col("minute") + valid >= F.col("t")))
    seen = live.groupBy("preset", "region").agg(F.min(F.struct("minute", "id")).alias("first"), F.sum("exposed").alias("exposed"), F.max("stage").alias("stage"), F.count("*").alias("n"), F.max("t").alias("t"))
    regions = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "region"))), lambda x: x["region"]), "; ")
    b = seen.groupBy("preset").agg(regions.alias("regions"), F.sum("n").alias("alerts"), F.sum("exposed").cast("long").alias("people"), F.max("stage").alias("stage"), F.max("t").alias("t"))
    clock = lambda plus, shape: F.date_format(F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(t AS INT) + {plus})"), shape)
    ist = "dd-MMM-yyyy hh:mm a 'IST'"
    name = F.when(F.col("stage") == 3, "RED").when(F.col("stage") == 2, "ORANGE").otherwise("YELLOW")
    b = b.join(rungs.withColumnRenamed("cycle", "at"), F.floor(F.col("t") / 10) == F.col("at"), "left")
    return b.select("preset", F.concat(name, F.lit(" WARNING: THUNDERSTORM AND LIGHTNING NOWCAST")).alias("headline"), clock(0, "yyyy-MM-dd HH:mm:ss 'UTC'").alias("issue_time_utc"), clock(330, ist).alias("issue_time_ist"), clock(330 + valid, ist).alias("valid_until_ist"), "regions", "alerts", "people", F.coalesce("rung", F.lit("CLIMATOLOGY")).alias("rung"), F.round(F.coalesce("confidence", F.lit(0.05)), 6).alias("confidence"))


@query("bulletin_now", BULLETIN_SQL)
def bulletin_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulletin at the newest alert's minute."""
    sent = stored(QUERIES["alerts"](spark, sf_dir))
    return bulletin_at(sent, sent.agg(F.max("minute").alias("t")), QUERIES["router_rung"](spark, sf_dir))


@query("first_seen", for_duckdb("WITH x AS (SELECT cell, min(minute * 10000000D + o_orderkey) AS first FROM {v_alert} GROUP BY cell) SELECT cell, row_number() OVER (ORDER BY first, cell) AS place FROM x"))
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell once, in order of its first alert; places are counted by ranges."""
    x = views.v_alert(spark, sf_dir).groupBy("cell").agg(F.min(F.struct("minute", "o_orderkey")).alias("first"))
    return running(x, [], [F.col("first"), F.col("cell")], {"place": F.lit(1)}).select("cell", "place")
