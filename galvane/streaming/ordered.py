"""Alert suppression and storm tracking as streams: rows wait in state until the watermark passes them, then go in order.

What a group decides depends on what it decided before, so arrival must not matter. Each row is kept in a map by
its time with a timer at that time; when event time has passed it, the rows due are taken out in order and
handed to the same step as in the batch form (operators.kernels). State is the rows that wait and what the step
carries: the alerts of the last 45 minutes, or the cells of the last cycle. A query that starts again from its
checkpoint goes on from there. The session needs the RocksDB state store (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from galvane.operators import kernels

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
VERDICTS = "event bigint, preset string, id bigint, verdict string, supersedes bigint"
ALERT = "id bigint, minute double, cell bigint, region string, blocks array<bigint>, stage int, jump int"
TRACKED = "event bigint, cycle bigint, label int, cell_id string, age int, merged boolean, split boolean, speed_kmh double"
CELL = "cell_id string, age int, lat double, lon double, f_lat double, f_lon double, v_lat double, v_lon double, a double, b double, c double"


class InOrder(StatefulProcessor):
    """Rows (at: milliseconds, id, fields) of a group in order of (at, id); a row that comes again replaces the one that waits."""

    FIELDS = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, id bigint", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.strip().split(" ")[0] for f in self.FIELDS.split(",")]
        for r in rows:
            self.waiting.updateValue((r.at, r.id), tuple(r[n] for n in names))
            self.handle.registerTimer(r.at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= upto), key=lambda x: x[0])
        for k, _ in due:
            self.waiting.removeKey(k)
        return iter(self.taken(key, due))

    def taken(self, key, due: list) -> list[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Suppression(InOrder):
    FIELDS = ALERT

    def init(self, handle) -> None:
        super().init(handle)
        self.sent = handle.getListState("sent", ALERT)

    def taken(self, key, due: list) -> list[Row]:
        if not due:
            return []
        sent = [kernels.Alert(*x) for x in self.sent.get()] if self.sent.exists() else []
        out = []
        for _, fields in due:
            alert = kernels.Alert(*fields)
            sent, verdict, old = kernels.decided(sent, alert)
            out.append(Row(event=key[0], preset=key[1], id=alert.id, verdict=verdict, supersedes=old))
        self.sent.put([tuple(x) for x in sent])
        return out


class Tracking(InOrder):
    FIELDS = "cycle bigint, label int, lat double, lon double"

    def init(self, handle) -> None:
        super().init(handle)
        self.cells = handle.getListState("cells", CELL)
        self.at = handle.getValueState("at", "cycle bigint, number int")

    def taken(self, key, due: list) -> list[Row]:
        if not due:
            return []
        last, number = self.at.get() if self.at.exists() else (None, 0)
        tracker = kernels.Tracker([tuple(x) for x in self.cells.get()] if self.cells.exists() else [], last, number)
        out, by = [], {}
        for _, (cycle, *seen) in due:
            by.setdefault(cycle, []).append(tuple(seen))
        for cycle in sorted(by):
            for label, *rest in tracker.step(cycle, sorted(by[cycle])):
                cell_id, age, merged, split, speed = rest
                out.append(Row(event=key[0], cycle=cycle, label=label, cell_id=cell_id, age=age, merged=merged, split=split, speed_kmh=speed))
        self.cells.put(tracker.previous)
        self.at.update((tracker.last, tracker.number))
        return out


def suppressed(alerts: DataFrame, late: str = "30 minutes") -> DataFrame:
    """A stream of alerts (time, event, preset and the fields of ALERT) -> a verdict for each, once the watermark has passed it."""
    rows = alerts.withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    return rows.groupBy("event", "preset").transformWithState(Suppression(), VERDICTS, "Append", "EventTime")


def tracked(detections: DataFrame, late: str = "30 minutes") -> DataFrame:
    """A stream of detections (time, event, cycle, label, lat, lon), those of a cycle at one time -> their tracks, a cycle at a time."""
    rows = detections.withWatermark("time", late).withColumn("at", F.unix_millis("time")).withColumn("id", F.col("label").cast("long"))
    return rows.groupBy("event").transformWithState(Tracking(), TRACKED, "Append", "EventTime")
