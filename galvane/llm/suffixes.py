"""A suffix order with common-prefix values by external induced sorting.

The suffixes whose left neighbour is larger and right neighbour smaller (LMS) are sorted first;
all others follow by induction: a queue hands out suffix tuples in order, and the tuple that each
induces goes back to the queue under its own first byte. Tuples carry the length of the prefix
that they share with the one before, up to a cap. The queue's keys only ever move one way, so it
is a row of runs by first byte; runs beyond a memory budget lie in an unnamed file on disk.
"""

from __future__ import annotations

import tempfile

import numpy as np

from galvane.llm.common import U64, prefix_hash, span

_BASE = 0xA0761D6478BD642F | 1


class RunQueue:
    """A monotone priority queue of (position, shared prefix) runs by first byte."""

    def __init__(self, budget: int = 64 << 20):
        self.runs: dict[int, list] = {}
        self.budget, self.held, self.file = budget, 0, None

    def push(self, key: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.runs.setdefault(key, []).append((at, shared))
        self.held += at.nbytes + shared.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for i, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    place = self.file.tell()
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    runs[i] = (place, len(run[0]))
        self.held = 0

    def pop(self, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for run in self.runs.pop(key, []):
            if isinstance(run[0], np.ndarray):
                self.held -= run[0].nbytes + run[1].nbytes
                out.append(run)
            else:
                self.file.seek(run[0])
                out.append((np.frombuffer(self.file.read(8 * run[1]), np.int64), np.frombuffer(self.file.read(run[1]), np.uint8)))
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """The least of values[a:b] for many a < b."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.uint8)
        level = (np.frexp((b - a).astype(np.float64))[1] - 1).astype(np.int8)
        for k in np.flatnonzero(np.bincount(level)):
            here = np.flatnonzero(level == k)
            low = self.levels[k]
            out[here] = np.minimum(low[a[here]], low[b[here] - (1 << int(k))])
        return out


class _Text:
    def __init__(self, text: np.ndarray, cap: int):
        self.t, self.cap = text, cap
        self.h = prefix_hash(text.astype(U64) * U64(0xE7037ED1A0B428DB) + U64(1), _BASE)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes at a and b, up to the cap."""
        n, low = len(self.t), np.zeros(len(a), np.int64)
        step = 1 << (self.cap.bit_length() - 1)
        while step:
            to = low + step
            fits = (to <= self.cap) & (np.maximum(a, b) + to <= n)
            x, y, z = a[fits], b[fits], to[fits]
            same = span(self.h, x, x + z, _BASE) == span(self.h, y, y + z, _BASE)
            low[np.flatnonzero(fits)[same]] += step
            step >>= 1
        return low.astype(np.uint8)


def _pass(text: _Text, wanted: np.ndarray, seeds: dict[int, tuple[np.ndarray, np.ndarray]], keys: list[int], budget: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One induction: keys in the order of sweep; wanted[p]: suffix p is of the kind to induce.

    The order of sweep of a first byte is: the induced, then the seeds. Returns the induced.
    """
    queue, t, cap = RunQueue(budget), text.t, text.cap
    since = np.full(int(t.max()) + 1, 0, np.uint8)  # least shared prefix since the last tuple of a byte
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def induce(at: np.ndarray, shared: np.ndarray) -> None:
        hit = np.flatnonzero(at > 0)
        hit = hit[wanted[at[hit] - 1]]
        low = int(shared.min())
        if len(hit):
            new = at[hit] - 1
            order = np.argsort(t[new], kind="stable")
            hit, new = hit[order], new[order]
            byte = t[new]
            head = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            begin = np.concatenate([[0], hit[:-1] + 1])
            begin[head] = 0
            least = _Least(shared)
            got = least.of(begin, hit + 1)
            got[head] = np.minimum(got[head], since[byte[head]])
            got = np.minimum(got.astype(np.int64) + 1, cap).astype(np.uint8)
            tail = np.append(head[1:], len(hit)) - 1
            np.minimum(since, low, out=since)
            rest = hit[tail] + 1
            inner = rest < len(shared)
            since[byte[tail]] = 255
            since[byte[tail][inner]] = least.of(rest[inner], np.full(int(inner.sum()), len(shared)))
            for a, b in zip(head, tail + 1, strict=True):
                queue.push(int(byte[a]), new[a:b], got[a:b])
        else:
            np.minimum(since, low, out=since)

    for key in keys:
        done = []
        while runs := queue.pop(key):
            at, shared = (np.concatenate(x) for x in zip(*runs, strict=True))
            if not done:
                shared = shared.copy()
                shared[0] = 0
            done.append((at, shared))
            induce(at, shared)
        if done:
            out[key] = tuple(np.concatenate(x) for x in zip(*done, strict=True))
        if key in seeds:
            at, shared = seeds[key]
            shared = shared.copy()
            shared[0] = text.common(out[key][0][-1:], at[:1])[0] if done else 0
            induce(at, shared)
    queue.close()
    return out


def _by_key(t: np.ndarray, at: np.ndarray, shared: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if not len(at):
        return {}
    cut = np.flatnonzero(np.concatenate([[True], t[at[1:]] != t[at[:-1]]]))
    return {int(t[at[a]]): (at[a:b], shared[a:b]) for a, b in zip(cut, [*cut[1:], len(at)], strict=True)}


def _induced(text: _Text, small: np.ndarray, seeds: np.ndarray, shared: np.ndarray, budget: int):
    keys = [int(k) for k in np.unique(text.t)]
    large = _pass(text, ~small, _by_key(text.t, seeds, shared), keys, budget)
    turned = {}
    for k, (at, common) in large.items():  # shared prefix with the next in lieu of the one before
        turned[k] = at[::-1], np.concatenate([[0], common[:0:-1]]).astype(np.uint8)
    return large, _pass(text, small, turned, keys[::-1], budget), keys


def suffix_order(data: np.ndarray, cap: int, budget: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of data's suffixes in order of their first cap items, and shared prefixes up to cap.

    The end of data counts as an item below all others.
    """
    t = np.concatenate([data.astype(np.int64) + 1, [0]])
    n = len(t)
    if n < 3:
        return np.argsort(t[:-1], kind="stable"), np.zeros(n - 1, np.uint8)
    text = _Text(t, cap)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    small = np.append(t[nearest] < t[nearest + 1], True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # order of LMS substrings: the same induction from seeds in order of their first item alone
    rough = lms[np.argsort(t[lms], kind="stable")]
    _, lower, keys = _induced(text, small, rough, np.zeros(len(rough), np.uint8), budget)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = np.concatenate([lower[k][0][::-1] for k in keys if k in lower]) if lower else lms
    found = found[is_lms[found]]
    if len(found) < len(lms):  # the end itself is induced by none
        found = np.concatenate([np.setdiff1d(lms, found), found])
    stop = np.append(lms[1:], n - 1)
    end = np.minimum(stop[np.searchsorted(lms, found)] + 1, n)
    same = (np.diff(end - found) == 0) & (span(text.h, found[1:], end[1:], _BASE) == span(text.h, found[:-1], end[:-1], _BASE)) if len(found) > 1 else np.zeros(0, bool)
    rank = np.zeros(len(lms), np.int64)
    rank[np.searchsorted(lms, found)] = np.concatenate([[0], np.cumsum(~same)])
    # the reduced string of ranks: pairs of ranks are ranked anew, twice as far each time, to the cap
    reach = 1
    while reach < cap and len(np.unique(rank)) < len(rank):
        nxt = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1]
        reach *= 2
    seeds = lms[np.argsort(rank, kind="stable")]
    common = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        common[1:] = text.common(seeds[:-1], seeds[1:])
    large, lower, keys = _induced(text, small, seeds, common, budget)
    order, shared = [], []
    for k in keys:
        part = []
        if k in large:
            part.append(large[k])
        if k in lower:
            at, c = lower[k]
            at, c = at[::-1], np.concatenate([[0], c[:0:-1]]).astype(np.uint8)
            if part:
                c[0] = text.common(part[0][0][-1:], at[:1])[0]
            part.append((at, c))
        elif k == 0:
            part.append((np.array([n - 1]), np.zeros(1, np.uint8)))
        order += [x[0] for x in part]
        shared += [x[1] for x in part]
    order, shared = np.concatenate(order), np.concatenate(shared)
    keep = order < n - 1
    return order[keep], shared[keep]
