"""alerts: what went out counts for 45 minutes, also at the ends of the 36-cycle cases."""

from galvane.plans import nested
from galvane.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_no_region_or_cell_is_alerted_twice_within_the_window(spark):
    got = QUERIES["alerts"](spark, SF).select("event", "preset", "cell", "region", "minute", "verdict").collect()
    new = [r for r in got if r["verdict"] == "alert"]
    again = [(a, b) for a in got for b in new if a["preset"] == b["preset"] and (a["cell"] == b["cell"] or a["region"] == b["region"]) and a["minute"] // 1440 == b["minute"] // 1440 and 0 < b["minute"] - a["minute"] < 45]
    assert new and not again
    assert all(r["event"] == r["minute"] // 1440 for r in got)


def test_cases_keep_their_own_events(spark):
    events = {r["event_id"] for r in nested.case_bundles(spark, SF).select("event_id").collect()}
    assert max(events) > max(r["event"] for r in QUERIES["alerts"](spark, SF).select("event").collect())
