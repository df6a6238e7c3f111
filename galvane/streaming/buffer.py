"""The sliding buffer as a stream: last writer wins by (modality, station, cycle), bounded per modality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "modality string, kept int, dropped bigint, newest double"
STATE = "keys array<string>, times array<double>, orders array<bigint>, dropped bigint"


def bounded(retention_s: float = 14400.0, cap: int = 50):
    """The state function: upsert, then drop what is older than the newest by more, then the cap."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = {}, 0
        if state.exists:
            keys, times, orders, dropped = state.get
            held = {k: (t, o) for k, t, o in zip(keys, times, orders, strict=True)}
        for batch in batches:
            for r in batch.itertuples():
                name = f"{r.station}/{r.cycle}"
                if name not in held or held[name][1] < r.event_id:
                    held[name] = (r.s, r.event_id)
        top = max((t for t, _ in held.values()), default=0.0)
        keep = sorted((x for x in held.items() if x[1][0] >= top - retention_s), key=lambda x: (-x[1][0], -x[1][1]))[:cap]
        dropped += len(held) - len(keep)
        state.update(([k for k, _ in keep], [t for _, (t, _) in keep], [o for _, (_, o) in keep], dropped))
        yield pd.DataFrame({"modality": [key[0]], "kept": [len(keep)], "dropped": [dropped], "newest": [top]})

    return step


def buffer_stream(observations: DataFrame, retention_s: float = 14400.0, cap: int = 50) -> DataFrame:
    """A streaming DataFrame of observations -> the buffer's summary by modality after each batch."""
    rows = observations.select("modality", "station", "cycle", "s", "event_id")
    return rows.groupBy("modality").applyInPandasWithState(bounded(retention_s, cap), OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def sliding_counts(observations: DataFrame, window: str = "60 minutes", slide: str = "10 minutes", late: str = "240 minutes") -> DataFrame:
    """Windowed counts and maxima by modality with a watermark; observations need a timestamp column time."""
    by = observations.withWatermark("time", late).groupBy(F.window("time", window, slide), "modality")
    return by.agg(F.count("*").alias("n"), F.max("value").alias("top"))
