"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are compared as lower-case word characters, runs of anything else as one space, with
a space before and after, so an item stands for whole words. An item may be found with up to max_edit_rate of its length in edits. Cut into one piece more than
that budget, at least one piece of any such occurrence is exact: one automaton over the pieces of
a block of items finds those, and Myers' bit-parallel distance verifies the text around each.

Defined results: null and empty texts match nothing; items that are null or hold no word characters
match nothing; items with one item_id are one item with several wordings, those without one are an item each;
rows repeat as they are. Items beyond block_bytes are taken in several blocks by item_id, each a pass
over the documents; the rows are the same for any number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galvane.llm.common import row_key, without_rows, written

MAX_EDIT_RATE = 0.06
BLOCK_BYTES = 4 << 20
_OTHER = re.compile(r"[\W_]+")
SCHEMA = "doc_id bigint, text_hash bigint, item_id bigint, edits int"


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def padded(text: str) -> str:
    return f" {normal(text)} "


def cut(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item (with its outer spaces) and its pieces with their places."""
    budget = int((len(item) - 2) * rate)
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, text: str, limit: int) -> int:
    """The least edit distance of pattern to any part of text; limit + 1 if it is more than limit."""
    m, best = len(pattern), limit + 1
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.budgets, at = [], [], {}
        for item_id, text in items:
            wording = padded(text or "")
            if not wording.strip():
                continue
            budget, parts = cut(wording, rate)
            for a, piece in parts:
                at.setdefault(piece, []).append((len(self.items), a))
            self.items.append((item_id, wording))
            self.budgets.append(budget)
        self.machine = ahocorasick.Automaton()
        for piece, places in at.items():
            self.machine.add_word(piece, (len(piece), places))
        if at:
            self.machine.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """item_id and edits of each item in a padded text."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.machine.iter(text):
            for k, a in places:
                start, slack, whole = end + 1 - size - a, self.budgets[k], len(self.items[k][1])
                lo, hi = max(0, start - slack), start + whole + slack
                runs = windows.setdefault(k, [])
                if runs and lo <= runs[-1][1] and lo >= runs[-1][0]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
        found: dict[tuple[int | None, int], int] = {}
        for k, runs in windows.items():
            item_id, wording = self.items[k]
            for lo, hi in runs:
                part = text[lo:hi]
                edits = 0 if wording in part else myers(wording, part, self.budgets[k])
                if edits <= self.budgets[k]:
                    item = item_id, k if item_id is None else 0
                    found[item] = min(edits, found.get(item, edits))
        return [(item_id, edits) for (item_id, _), edits in found.items()]


def leaks(docs: DataFrame, items: DataFrame, max_edit_rate: float = MAX_EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, item_id and edits of each item found in each row."""
    items = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    out = None
    for b in range(n):
        block = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), "text")), F.lit(n)) == b).collect()]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, max_edit_rate)
            for batch in batches:
                rows = []
                for doc, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if text and matcher.any:
                        rows += [(doc, key, item, edits) for item, edits in matcher.find(padded(text))]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "text_hash", "item_id", "edits"])

        found = docs.select(row_key()[0], "text", row_key()[1]).mapInArrow(run, SCHEMA)
        found = written(found, "leaks") if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, max_edit_rate: float = MAX_EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id and the least edits of each item found in each row."""
    return leaks(docs, items, max_edit_rate, block_bytes).drop("text_hash")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in which an item is found; other rows of their doc_id, or without one, stay."""
    return without_rows(docs, leaks(docs, items))
