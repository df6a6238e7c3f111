"""Bulletins, messages and baselines: made alerts, message faults, references to what is superseded."""

import re

from galvane.plans import bulletins, catalog

SF = "/root/testdata/sf0.01"
ALERT = "event bigint, preset string, id bigint, minute double, cell bigint, region string, stage int, jump int, p double, exposed bigint"


def test_bulletin_of_made_alerts(spark):
    """Valid for 60 minutes, ends included; regions in order of first sight; the highest stage; people summed."""
    rows = [
        (0, "operational", 1, 39.0, 1, "too old", 3, 0, 0.9, 7),
        (0, "operational", 2, 40.0, 1, "second", 2, 0, 0.6, 10),
        (0, "operational", 3, 90.0, 2, "third", 1, 0, 0.3, 5),
        (0, "operational", 4, 95.0, 1, "second", 2, 0, 0.6, 1),
        (0, "operational", 5, 101.0, 3, "too new", 3, 0, 0.9, 9),
        (0, "protective", 6, 100.0, 3, "other", 3, 1, 0.9, 9),
    ]
    t = spark.createDataFrame([(100.0,)], "t double")
    rungs = spark.createDataFrame([(10, "FUSION", 0.8)], "cycle bigint, rung string, confidence double")
    got = {r["preset"]: r for r in bulletins.bulletin_at(spark.createDataFrame(rows, ALERT), t, rungs).collect()}
    b = got["operational"]
    assert (b["regions"], b["alerts"], b["people"], b["headline"].split()[0]) == ("second; third", 3, 16, "ORANGE")
    assert (b["issue_time_utc"], b["issue_time_ist"], b["valid_until_ist"]) == ("2024-01-01 01:40:00 UTC", "01-Jan-2024 07:10 AM IST", "01-Jan-2024 08:10 AM IST")
    assert (b["rung"], b["confidence"], got["protective"]["regions"]) == ("FUSION", 0.8, "other")


def test_updates_name_what_they_supersede(spark):
    alerts = {(r["event"], r["preset"], r["id"]): r for r in catalog.QUERIES["alerts"](spark, SF).collect()}
    updates = 0
    for r in catalog.QUERIES["cap_full"](spark, SF).collect():
        a = alerts[r["event"], r["preset"], r["id"]]
        named = re.search("<references>(.*)</references>", r["xml"])
        if a["supersedes"] is None:
            assert named is None and "<msgType>Alert<" in r["xml"]
            continue
        updates += 1
        old = alerts[r["event"], r["preset"], a["supersedes"]]
        sent = f"2024-01-{1 + int(old['minute'] // 1440):02d}T{int(old['minute'] // 60) % 24:02d}:{int(old['minute']) % 60:02d}:00+00:00"
        assert named[1] == f"galvane,galvane-{r['preset']}-{a['supersedes']},{sent}" and "<msgType>Update<" in r["xml"]
        assert 0 <= a["minute"] - old["minute"] < 45 and (a["stage"] > old["stage"] or a["jump"] > old["jump"])
    assert updates


def test_faults(spark):
    good = catalog.QUERIES["cap_full"](spark, SF).limit(1).first()["xml"]
    swaps = [("", "", ""), ("<status>Test<", "<status>Real<", "status"), ("<scope>Public</scope>", "", "scope"), ("<msgType>Alert", "<msgType>Note", "msgType")]
    rows = [(re.sub("<references>.*</references>", "", good.replace("Update", "Alert")).replace(a, b) if a else good, want) for a, b, want in swaps]
    ring = re.search("<polygon>([^<]*)<", good)[1]
    rows += [(good.replace(ring, ring.rsplit(" ", 1)[0]), "open"), (good.replace(ring, "25.1,84.0 25.1,84.0"), "ring"), (good.replace("<identifier>", "<identifier></identifier><old>").replace("</identifier><sender>", "</old><sender>"), "identifier")]
    got = bulletins.faults(spark.createDataFrame(rows, "xml string, want string")).collect()
    assert [r["faults"] for r in got] == [r["want"] for r in got]
