"""The buffer against a loop that puts frames one after another, as batches and as a stream of several starts."""

import random

import pytest
from pyspark.sql import functions as F

from galvane.streaming import live

SCHEMA = live.FRAMES + ", clear boolean"


class Plain:
    """A list for each modality; prune after each put."""

    def __init__(self, retention, cap):
        self.retention, self.cap, self.held = retention, cap, {}

    def put(self, modality, time, variable, order, value, clear):
        if clear:
            for m in list(self.held) if modality is None else [modality]:
                self.held[m] = {}
            return
        if None in (modality, time, variable, order):
            return
        own = self.held.setdefault(modality, {})
        own[time, variable] = (order, value)
        top = max(t for t, _ in own)
        stay = sorted((k for k in own if k[0] >= top - self.retention), key=lambda k: (k[0], own[k][0]))[-self.cap :]
        self.held[modality] = {k: own[k] for k in stay}

    def rows(self):
        return {(m, t, v, *x) for m, own in self.held.items() for (t, v), x in own.items()}


def made(seed, n=160):
    """Times rise with jitter far smaller than the retention, so that pruning by batch and by put agree."""
    rng = random.Random(seed)
    out = [(rng.choice("ab"), float(k // 4 * 60 + rng.choice((0, 60))), rng.choice("xyz"), k, rng.random() if rng.random() < 0.9 else None, False) for k in range(n)]
    out[n // 3] = ("a", None, None, n // 3, None, True)
    out[n // 2] = (None, None, None, n // 2, None, True)
    return [*out, ("a", None, "x", n, 1.0, False), (None, 1.0, "x", n + 1, 1.0, False)]


def as_set(df):
    return {tuple(r) for r in df.select(*live.KEY, "order", "value").collect()}


@pytest.mark.parametrize(("retention", "cap"), [(600.0, 50), (1e9, 7), (300.0, 4)])
def test_batches_equal_single_puts(spark, retention, cap):
    rows, plain = made(int(retention) + cap), Plain(retention, cap)
    held, counts = spark.createDataFrame([], live.FRAMES), spark.createDataFrame([], live.COUNTS)
    for a in range(0, len(rows), 60):
        held, counts = live.put(held, counts, spark.createDataFrame(rows[a : a + 60], SCHEMA).repartition(3), retention, cap)
        for r in rows[a : a + 60]:
            plain.put(*r)
        assert as_set(held) == plain.rows()
    got = {r["modality"]: r for r in live.summary(held, counts).collect()}
    assert {m: r["count"] for m, r in got.items()} == {m: len(x) for m, x in plain.held.items()}
    assert all(r["latest"] == max(t for t, _ in plain.held[m]) for m, r in got.items())


def test_dropped_counts(spark):
    rows = [("a", float(k), "x", k, 1.0, False) for k in range(10)] + [("b", 0.0, "x", 10, 1.0, False)]
    none = spark.createDataFrame([], live.FRAMES), spark.createDataFrame([], live.COUNTS)
    held, counts = live.put(*none, spark.createDataFrame(rows, SCHEMA), 1e9, 3)
    held, counts = live.put(held, counts, spark.createDataFrame([("a", 20.0, "x", 11, 1.0, False)], SCHEMA), 1e9, 3)
    assert {r["modality"]: r["dropped"] for r in counts.collect()} == {"a": 8, "b": 0}
    assert {r["time"] for r in live.history(held.where("modality = 'a'"), F.lit(9.0), 1 / 60).collect()} == {8.0, 9.0}
    assert {r["modality"]: r["time"] for r in live.latest(held).collect()} == {"a": 20.0, "b": 0.0}
    assert live.summary(*none).count() == 0


def test_stream_of_two_starts(spark, tmp_path):
    rows, plain, root = made(5), Plain(600.0, 9), str(tmp_path / "buffer")
    assert live.snapshot(spark, root)[0].isEmpty()
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(live.keeper(root, 600.0, 9, keep=1)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(90)
        for r in part:
            plain.put(*r)
        assert as_set(live.snapshot(spark, root)[0]) == plain.rows()
    assert live.versions(spark, root) == [1]
    live.keeper(root, 600.0, 9)(spark.createDataFrame(rows[70:], SCHEMA), 2)  # the same frames once more change nothing
    assert as_set(live.snapshot(spark, root)[0]) == plain.rows()
    assert as_set(live.snapshot(spark, root, 2)[0]) == plain.rows() and live.snapshot(spark, root, 1)[0].isEmpty()


def test_limit_before_the_shuffle(spark):
    plan = live.pruned(live.deduplicated(spark.createDataFrame([("a", 1.0, "x", 1, 1.0)], live.FRAMES)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
