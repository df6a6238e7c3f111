"""Suffix-array dedup: bytes of strings that also start earlier are removed.

A string of `width` bytes that stands twice has the same anchor twice (see repeats). Around each
such anchor the text from the first to the last window that it stands for is a stretch, a row with
its places. Stretches are dealt to shards by their anchor, so equal strings meet. Of equal stretches,
compared byte by byte, the earliest stands for all; where one anchor has different stretches, the
shard's suffix order (induced sorting with shared prefixes, its queues on disk) groups equal strings,
and all but the earliest are marked.

Defined results: null and empty texts are 0 bytes; matches never cross texts; a row without a
doc_id has no place in the order and is kept whole; rows repeat as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from galvane.llm.common import U64, buckets_for, by_id, chunks, column_bytes
from galvane.llm.repeats import anchor_rows, byte_windows, finished, frequent, gathered, keyed, mark_keys, marked, owner, shared, with_copies
from galvane.llm.suffixes import suffix_order

SHARD_BYTES = 6 << 20
SORT_BYTES = 1 << 20


def stretches(part: np.ndarray, poff: np.ndarray, keys: np.ndarray, windows, width: int):
    """anchor hash, text, first window and last window of each stretch around a shared anchor."""
    at, anchor, grams, _ = windows(part, poff)
    if not len(at) or not len(keys):
        return None
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    tail = np.append(head[1:], len(at)) - 1
    text = owner(poff, at[head])
    h = grams[anchor[head]]
    keep = np.isin(keyed(h, text), keys)
    return h[keep], text[keep], at[head][keep], at[tail][keep]


def blocks(group: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Runs of whole groups of about SORT_BYTES: equal strings are always in one group."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else []
    total, a = np.concatenate([[0], np.cumsum(size)]), 0
    for i, b in enumerate(ends):
        if i + 1 == len(ends) or total[ends[i + 1]] - total[a] > SORT_BYTES:
            yield slice(a, int(b))
            a = int(b)


STRETCH = "shard int, h bigint, content binary, ids array<bigint>, starts array<bigint>"


def repeated_windows(docs: DataFrame, flagged: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, marks: for each document, runs (first, last) of windows that also start earlier."""
    windows, shards = byte_windows(width, gram), buckets_for(docs, each=SHARD_BYTES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off) = batch.column(0).to_numpy(zero_copy_only=False), column_bytes(batch.column(1))
            seen: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
            for a, b, part, poff in chunks(data, off):
                got = stretches(part, poff, mark_keys(batch.column(2), a, b), windows, width)
                if got is None:
                    continue
                h, text, lo, hi = got
                raw = part.tobytes()
                for anchor, x, y, doc, start in zip(h.tolist(), lo.tolist(), (hi + width).tolist(), ids[a + text].tolist(), (lo - poff[text]).tolist(), strict=True):
                    places = seen.setdefault((anchor, raw[x:y]), ([], []))
                    places[0].append(doc)
                    places[1].append(start)
            heads = np.array([k[0] for k in seen], U64)
            cols = [pa.array((heads % U64(shards)).astype(np.int32)), pa.array(heads.view(np.int64)), pa.array([k[1] for k in seen], pa.binary())]
            cols += [pa.array([v[i] for v in seen.values()], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "h", "content", "ids", "starts"])

    def judge(key, table):
        by: dict[bytes, int] = {}
        own = np.array([by.setdefault(x, len(by)) for x in table.column("content").to_pylist()])
        heads = np.zeros(len(by), U64)
        heads[own] = table.column("h").to_numpy().view(U64)
        kind = np.repeat(own, pc.list_value_length(table.column("ids")).to_numpy())
        ids, starts = (pc.list_flatten(table.column(c)).to_numpy() for c in ("ids", "starts"))
        contents = list(by)
        size = np.array([len(x) for x in contents])
        order = np.lexsort((starts, ids, kind))
        first = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
        one = order[first]  # by kind: its earliest place
        rest = order[~first]
        out = [(ids[rest], starts[rest], starts[rest] + size[kind[rest]] - width)]
        _, group, many = np.unique(heads, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(many[group] > 1)
        mixed = mixed[np.argsort(group[mixed], kind="stable")]
        for part in blocks(group[mixed], size[mixed]):
            kinds_ = mixed[part]
            off = np.concatenate([[0], np.cumsum(size[kinds_])])
            at, common = suffix_order(np.frombuffer(b"".join(contents[k] for k in kinds_), np.uint8), width)
            run = np.cumsum(common < width)  # suffixes with one first string
            many_ = np.bincount(run)[run] > 1
            at, run = at[many_], run[many_]
            piece = np.searchsorted(off, at, "right") - 1
            whole = off[piece + 1] - at >= width
            at, piece, run = at[whole], piece[whole], run[whole]
            d, s = ids[one[kinds_[piece]]], starts[one[kinds_[piece]]] + at - off[piece]
            order = np.lexsort((s, d, run))
            later = order[np.concatenate([[False], run[order][1:] == run[order][:-1]])] if len(order) else order
            out.append((d[later], s[later], s[later]))
        d, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((lo, d))
        d, lo, hi = d[order], lo[order], hi[order]
        new = np.ones(len(d), bool)  # windows next to each other are one run
        new[1:] = (d[1:] != d[:-1]) | (lo[1:] > hi[:-1] + 1)
        return pa.table({"doc_id": d[new], "first": lo[new], "last": hi[np.append(np.flatnonzero(new)[1:], len(d)) - 1] if len(d) else hi})

    hot = frequent(docs, [windows])[0]
    texts = marked(flagged, shared(anchor_rows(flagged.where("copy is null"), windows, hot), False))
    return gathered(texts.mapInArrow(emit, STRETCH).groupBy("shard").applyInArrow(judge, "doc_id bigint, first bigint, last bigint"), "first", "last")


def drop_repeated_bytes(docs: DataFrame, width: int = 100, gram: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, off), lists, copy = column_bytes(batch.column(1)), batch.column(2), batch.column(3).to_pylist()
            removed, spans, kept = [], [], []
            for k in range(len(off) - 1):
                part, marks = data[off[k] : off[k + 1]], lists[k]
                if copy[k] and len(part) >= width:
                    removed.append(len(part))
                    spans.append(1)
                    kept.append(b"")
                    continue
                if not marks.is_valid or not len(marks):
                    removed.append(0)
                    spans.append(0)
                    kept.append(part.tobytes())
                    continue
                runs = np.stack([marks.values.field(i).to_numpy() for i in (0, 1)], 1)
                gone = np.zeros(len(part) + 1, np.int64)
                np.add.at(gone, runs[:, 0], 1)
                np.add.at(gone, np.minimum(runs[:, 1] + width, len(part)), -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(part[~gone].tobytes())
            cols = [pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    flagged = with_copies(docs)
    return finished(docs, flagged, repeated_windows(docs, flagged, width, gram)).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
