"""Ordered-state kernels: what needs a sequence, by event, frame, track or model.

Each takes one group's rows and is applied with applyInPandas; groups are single frames, tracks,
alert keys or models, so their size follows the grid or one event's length, not the table's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd

from galvane.operators import motion

KM_PER_DEG = motion.KM_PER_DEGREE


def label_components(frame: pd.DataFrame, corners: bool = False) -> pd.DataFrame:
    """i, j of pixels that are set -> label: 4-connected (corners: 8-connected), numbered in row-major order of first pixel."""
    cells = sorted(zip(frame["i"].tolist(), frame["j"].tolist(), strict=True))
    label: dict[tuple[int, int], int] = {}
    todo, n = set(cells), 0
    for start in cells:
        if start not in todo:
            continue
        n += 1
        stack = [start]
        todo.discard(start)
        while stack:
            i, j = stack.pop()
            label[i, j] = n
            for near in ways(i, j, corners):
                if near in todo:
                    todo.discard(near)
                    stack.append(near)
    out = frame.copy()
    out["label"] = [label[i, j] for i, j in zip(frame["i"], frame["j"], strict=True)]
    return out


def ways(i: int, j: int, corners: bool) -> list[tuple[int, int]]:
    """The pixels next to one."""
    return [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not a or not b)]


class Tracker:
    """Greedy matching, in the order of detections, to the last cycle's nearest unmatched cell in the gate.

    previous holds the last cycle's cells: (id, age, lat, lon) and the filter's state (motion.State).
    """

    def __init__(self, previous: Sequence[tuple] = (), last: int | None = None, number: int = 0, gate_kmh: float = 120.0, step_h: float = 1 / 6):
        self.previous, self.last, self.number, self.step_h = list(previous), last, number, step_h
        self.gate = gate_kmh * step_h / KM_PER_DEG

    def step(self, cycle: int, seen: list[tuple[int, float, float]]) -> list[tuple]:
        """seen: (label, lat, lon) in order -> (label, cell_id, age, merged, split, speed_kmh), speed as filtered."""
        before = self.previous if self.last is not None and cycle == self.last + 1 else []  # no coasting over a missing cycle
        self.last, taken, current, out = cycle, set(), [], []
        for label, lat, lon in seen:
            near = sorted((math.hypot(lat - p[2], lon - p[3]), k) for k, p in enumerate(before))
            match = next((k for d, k in near if k not in taken and d <= self.gate), None)
            others = [k for d, k in near if match is not None and k != match and k not in taken and d <= 1.2 * self.gate]
            split = match is None and any(d <= 1.5 * self.gate for d, _ in near)
            if match is None:
                self.number += 1
                cell = (f"C{self.number:04d}", 0, lat, lon, *motion.first(lat, lon))
            else:
                taken |= {match, *others}  # cells that merge into this one are used up
                old = before[match]
                cell = (old[0], old[1] + 1, lat, lon, *motion.step(old[4:], self.step_h, lat, lon))
            current.append(cell)
            y, v_lat, v_lon = cell[4], cell[6], cell[7]
            speed = KM_PER_DEG * math.hypot(v_lat, v_lon * math.cos(math.radians(y)))
            out.append((label, cell[0], cell[1], bool(others), split, round(speed, 6)))
        self.previous = current
        return out


def track_cells(rows: pd.DataFrame) -> pd.DataFrame:
    """rows of one event: cycle, label, lat, lon -> cycle, label, cell_id, age, merged, split, speed_kmh."""
    tracker, out = Tracker(), []
    for cycle, now in rows.sort_values(["cycle", "label"]).groupby("cycle", sort=True):
        seen = list(zip(now["label"].tolist(), now["lat"].tolist(), now["lon"].tolist(), strict=True))
        out += [(int(cycle), *r) for r in tracker.step(int(cycle), seen)]
    return pd.DataFrame(out, columns=["cycle", "label", "cell_id", "age", "merged", "split", "speed_kmh"])


class Alert(NamedTuple):
    id: int
    minute: float
    cell: int
    region: str
    blocks: Sequence[int]
    stage: int
    jump: int


def decided(sent: list[Alert], alert: Alert, minutes: float = 45.0) -> tuple[list[Alert], str, int | None]:
    """What went out within the window with this alert, the verdict on it, and the alert that it supersedes.

    Of the alerts that went out, the newest within the window that has the cell, the region or any block in
    common decides: a jump that it did not have, or a higher stage, makes an update that supersedes it,
    all else is suppressed.
    """
    live = [x for x in sent if alert.minute - x.minute < minutes]
    own = set(alert.blocks)
    old = next((x for x in reversed(live) if x.cell == alert.cell or x.region == alert.region or own & set(x.blocks)), None)
    verdict = "alert" if old is None else "update" if alert.jump and not old.jump or alert.stage > old.stage else "suppressed"
    return live if verdict == "suppressed" else [*live, alert], verdict, old.id if verdict == "update" else None


class Suppressor:
    """Which alerts go out (see decided), for rows sorted by event, preset and time.

    rows: event, preset, id, minute, cell, region, blocks, stage, jump. Only alerts within the window are held.
    """

    def __init__(self, minutes: float = 45.0):
        self.minutes, self.key, self.sent = minutes, None, []

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for event, preset, *fields in zip(*(rows[c] for c in ("event", "preset", *Alert._fields)), strict=True):
            if (event, preset) != self.key:
                self.key, self.sent = (event, preset), []
            alert = Alert(*fields)
            self.sent, verdict, old = decided(self.sent, alert, self.minutes)
            out.append((event, preset, alert.id, verdict, old))
        return pd.DataFrame(out, columns=["event", "preset", "id", "verdict", "supersedes"]).astype({"supersedes": "Int64"})


def pava(score: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic knots (right edge of each block, its mean) of scores in ascending order."""
    blocks: list[list[float]] = []
    for s, w, m in zip(score, weight, mean, strict=True):
        blocks.append([m, w, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0] + 1e-12:
            m1, w1, s1 = blocks.pop()
            m0, w0, _ = blocks.pop()
            blocks.append([(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1, s1])
    return [b[2] for b in blocks], [b[0] for b in blocks]


def fit_isotonic(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: lead, p, n, mean -> lead, ord, threshold, value; of knots at one score the last stays."""
    rows = rows.sort_values(["p", "mean"])
    knots = dict(zip(*pava(rows["p"].to_numpy(), rows["n"].to_numpy(), rows["mean"].to_numpy()), strict=True))
    edges, values = list(knots), list(knots.values())
    return pd.DataFrame({"lead": rows["lead"].iloc[0], "ord": range(len(edges)), "threshold": edges, "value": np.round(values, 6)})
