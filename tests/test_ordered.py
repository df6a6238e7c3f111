"""Suppression and tracking as streams: two starts from one checkpoint give what the batch form gives, whatever the order of arrival."""

import datetime as dt
import random

import pandas as pd
import pytest

from galvane.operators import kernels
from galvane.streaming import ordered

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def store(spark):
    before = {k: spark.conf.get(k, None) for k in ordered.STORE}
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def swept(spark, tmp_path, rows, schema, build, cuts):
    """rows (time first) in batches up to the cuts, each a start of its own from the same checkpoint."""
    come, out = str(tmp_path / "in"), str(tmp_path / "out")
    low = None
    for high in [*cuts, None]:
        part = [r for r in rows if (low is None or r[0] > low) and (high is None or r[0] <= high)]
        random.Random(len(part)).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(come)
        stream = build(spark.readStream.schema(schema).parquet(come))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        low = high
    return spark.read.parquet(out)


ALERTS = "time timestamp, event bigint, preset string, id bigint, minute double, cell bigint, region string, blocks array<bigint>, stage int, jump int"


def test_suppression(spark, store, tmp_path):
    rnd = random.Random(3)
    rows = []
    for n in range(160):
        minute = rnd.randrange(400)
        rows.append((T0 + dt.timedelta(minutes=minute), rnd.randrange(2), rnd.choice(["operational", "protective"]), n, float(minute), rnd.randrange(12), f"region {rnd.randrange(10)}", [rnd.randrange(20) for _ in range(rnd.randrange(3))], rnd.randrange(1, 4), int(rnd.random() < 0.1)))
    end = [(T0 + dt.timedelta(minutes=900), 9, "operational", 999, 900.0, 0, "r", [], 1, 0)]  # moves the watermark past all others
    got = swept(spark, tmp_path, rows + end, ALERTS, ordered.suppressed, [T0 + dt.timedelta(minutes=130), T0 + dt.timedelta(minutes=260)]).collect()
    frame = pd.DataFrame([r[1:] for r in rows], columns=["event", "preset", *kernels.Alert._fields]).sort_values(["event", "preset", "minute", "id"])
    want = kernels.Suppressor().feed(frame)
    key = lambda r: (r.event, r.preset, r.id, r.verdict, None if pd.isna(r.supersedes) else int(r.supersedes))
    assert sorted(map(key, got), key=str) == sorted((key(r) for r in want.itertuples()), key=str)
    assert {r.verdict for r in got} == {"alert", "update", "suppressed"}


SEEN = "time timestamp, event bigint, cycle bigint, label int, lat double, lon double"


def test_tracking(spark, store, tmp_path):
    rnd = random.Random(7)
    rows = []
    for event in range(2):
        for cycle in range(24):
            if cycle == 11:
                continue  # no coasting
            for label in range(rnd.randrange(1, 5)):
                rows.append((T0 + dt.timedelta(minutes=10 * cycle), event, cycle, label, 25 + 0.15 * label + 0.05 * rnd.random(), 84 + 0.02 * cycle + 0.1 * rnd.random()))
    end = [(T0 + dt.timedelta(minutes=900), 9, 90, 0, 25.0, 84.0)]
    got = swept(spark, tmp_path, rows + end, SEEN, ordered.tracked, [T0 + dt.timedelta(minutes=95)]).toPandas()
    for event in range(2):
        want = kernels.track_cells(pd.DataFrame([r[2:] for r in rows if r[1] == event], columns=["cycle", "label", "lat", "lon"]))
        mine = got[got.event == event].sort_values(["cycle", "label"], ignore_index=True)
        pd.testing.assert_frame_equal(mine[want.columns.tolist()], want, check_dtype=False)
    assert got.merged.any() and got.split.any() and got.age.max() > 5
