"""wind_direction: due north is 0 or 360 by the last bit of a mean, so places are added up in order of event_id however rows are dealt."""

import duckdb
import pytest

from galvane.plans import products  # noqa: F401
from galvane.plans.catalog import QUERIES, SQL

COPIES = "SELECT * EXCLUDE (k) REPLACE (event_id + k * 10000 AS event_id) FROM range(8) AS r(k), '/root/testdata/sf0.01/events.parquet' ORDER BY event_id"
LATE = "INSERT INTO e SELECT * REPLACE (event_id + 1000000 AS event_id, NULL AS ts) FROM e WHERE event_id < 500"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE e AS {COPIES}")
    con.execute(LATE)
    con.execute("CREATE VIEW events AS SELECT * FROM e ORDER BY event_id")
    return con


@pytest.mark.parametrize("dealt", ["event_id // 7000", "event_id * 7919 % 12", "0"])
def test_headings_however_rows_are_dealt(spark, con, tmp_path, dealt):
    (tmp_path / "events.parquet").mkdir()
    for (part,) in con.execute(f"SELECT DISTINCT {dealt} FROM e").fetchall():
        con.execute(f"COPY (SELECT * FROM e WHERE {dealt} = {part} ORDER BY event_id % 13, event_id) TO '{tmp_path}/events.parquet/{part}.parquet'")
    want = con.execute(f"SELECT track, b, heading FROM ({SQL['wind_direction']}) ORDER BY ALL").fetchall()
    got = [tuple(r) for r in QUERIES["wind_direction"](spark, str(tmp_path)).collect()]
    assert {r[2] for r in want} >= {0.0, 360.0} and None in {r[1] for r in want}
    assert sorted(got, key=str) == sorted(want, key=str)
