"""Repeated passages of words or bytes: which windows of a text also stand elsewhere.

Level-wise doubling. At each length the grams that several documents have, alone, go on to twice
that length, until the length is the window's or no candidate survives. Of the grams of one length
inside a window the one with the least hash is the window's anchor, so only anchors are compared
below the window's own length: equal windows have equal anchors at every length, and a window
whose anchor stands nowhere else is unique. Lengths without candidates are empty relations, which
adaptive execution ends there.

What is compared are plain rows (hash, doc_id), one for each distinct gram of a document, so they
grow with the text and not with partitions. A document whose whole text an earlier one has is left
out of it from the start: all its windows start in that one. Hashes that many documents of a bounded
sample have are dealt by document too (salt), and their groups are joined in a second, small step:
the sample says which groups are split, not what is found.

Defined results: null and empty texts have no windows and are kept with counts of 0; a row without
a doc_id has no place in the order of documents, and is kept whole with its own counts; rows with
one doc_id are texts of one document, each told apart in the output only by its counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from galvane.llm.common import U64, byte_grams, chunks, column_bytes, inside, mix, sliding_argmin, word_grams, word_hashes, words, written

#: (places of windows, place of each one's anchor, hashes of grams, number of each text's first item)
Windows = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
SAMPLE_DOCS, SHARE, MOST, SALTS = 4000, 0.01, 4096, 256


def word_windows(width: int, gram: int) -> Windows:
    """Windows of width words and their anchors of gram words."""

    def windows(data: np.ndarray, off: np.ndarray):
        starts, ends, first = words(data, off)
        grams = word_grams(word_hashes(data, starts, ends), gram)
        at = np.flatnonzero(inside(len(starts), first, width))
        return at, sliding_argmin(grams, width - gram + 1)[at] if len(at) else at, grams, first

    return windows


def byte_windows(width: int, gram: int) -> Windows:
    """Windows of width bytes and their anchors of gram bytes. Hashes only name candidates here."""

    def windows(data: np.ndarray, off: np.ndarray):
        at = np.flatnonzero(inside(len(data), off, width))
        grams = byte_grams(data, gram)
        return at, sliding_argmin(grams, width - gram + 1)[at] if len(at) else at, grams, off

    return windows


def owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each item is in, by the number of each text's first item."""
    return np.searchsorted(first, at, "right") - 1


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(text.astype(U64) + U64(1)))


def mark_keys(marks: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Keys (text, mark) of the marks of texts lo to hi, texts counted from lo."""
    part = marks.slice(lo, hi - lo)
    size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return keyed(part.flatten().to_numpy(zero_copy_only=False).view(U64), np.repeat(np.arange(hi - lo), size))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have a doc_id."""
    plain = dict(docs.dtypes)["doc_id"] == "bigint"  # even a cast to the same type would keep plans apart
    return docs.where("doc_id is not null").select("doc_id" if plain else F.col("doc_id").cast("long"), "text")


def with_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text and copy (true or null: does a smaller doc_id have all the texts of this one?).

    Documents of several different texts are never copies.
    """
    rows = identified(docs)
    keys = written(rows.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")), "keys")
    own = keys.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").drop("other")
    least = keys.groupBy("key").agg(F.min("doc_id").alias("least"))
    copies = written(own.join(least, "key").where("doc_id > least").select("doc_id", F.lit(True).alias("copy")), "copies")
    return rows.join(copies, "doc_id", "left").select("doc_id", "text", "copy")


def frequent(docs: DataFrame, levels: list[Windows]) -> list[np.ndarray]:
    """For each level the hashes of anchors, MOST at most, that many of a bounded sample of documents have."""
    rows = identified(docs)
    every = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for _, _, part, poff in chunks(data, off):
                for k, windows in enumerate(levels):
                    _, anchor, grams, first = windows(part, poff)
                    u = np.unique(anchor)
                    h = grams[u][np.unique(keyed(grams[u], owner(first, u)), return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64))], names=["level", "h"])

    counts = sample.mapInArrow(emit, "level int, h bigint").groupBy("level", "h").agg(F.count("*").alias("n"))
    ranked = counts.where(F.col("n") >= max(8, int(SAMPLE_DOCS * SHARE))).withColumn("k", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "h")))
    top = ranked.where(F.col("k") <= MOST).select("level", "h").collect()
    return [np.sort(np.array([r[1] for r in top if r[0] == k], np.int64).view(U64)) for k in range(len(levels))]


def salts(hashes: np.ndarray, hot: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0, or for hot hashes a number from 1 to SALTS by document."""
    salt = np.zeros(len(hashes), np.int32)
    if len(hot):
        here = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes)
        salt[here] = 1 + (mix(ids[here].astype(np.int64).view(U64)) % U64(SALTS)).astype(np.int32)
    return salt


def candidates(batch: pa.RecordBatch, a: int, b: int, part: np.ndarray, poff: np.ndarray, before: Windows | None) -> np.ndarray | None:
    """Places of the windows whose anchor of the level before is marked; None: all of them."""
    if before is None:
        return None
    at, anchor, grams, first = before(part, poff)
    return at[np.isin(keyed(grams[anchor], owner(first, at)), mark_keys(batch.column(2), a, b))] if len(at) else at


ENTRY = "h bigint, salt int, doc_id bigint"


def anchor_rows(texts: DataFrame, windows: Windows, hot: np.ndarray, before: Windows | None = None) -> DataFrame:
    """h, salt, doc_id: each distinct anchor of the documents' candidate windows; twice if it stands twice in a text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off) = batch.column(0).to_numpy(zero_copy_only=False), column_bytes(batch.column(1))
            for a, b, part, poff in chunks(data, off):
                kept = candidates(batch, a, b, part, poff, before)
                at, anchor, grams, first = windows(part, poff)
                u = np.unique(anchor if kept is None else anchor[np.isin(at, kept, assume_unique=True)])
                key, one, many = np.unique(keyed(grams[u], owner(first, u)), return_index=True, return_counts=True)
                u = np.concatenate([u[one], u[one[many > 1]]])
                h, d = grams[u], ids[a + owner(first, u)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salts(h, hot, d)), pa.array(d, pa.int64())], names=["h", "salt", "doc_id"])

    return texts.mapInArrow(emit, ENTRY)


def gathered(replies: DataFrame, *of: str | Column) -> DataFrame:
    """One row for each document: its marks in a list."""
    return replies.groupBy("doc_id").agg(F.collect_list(F.struct(*of) if len(of) > 1 else of[0]).alias("marks"))


def shared(entries: DataFrame, across: bool) -> DataFrame:
    """doc_id, marks: hashes that several entries have (across: of several documents). Hot hashes are known to be such."""
    w = Window.partitionBy("h", "salt")
    several = F.min("doc_id").over(w) != F.max("doc_id").over(w) if across else F.count("*").over(w) > 1
    return gathered(entries.withColumn("several", several).where("salt > 0 or several").select("doc_id", "h"), "h")


def drop_repeated_words(docs: DataFrame, width: int = 13, start: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without words in windows that a smaller doc_id starts.

    Levels are start, twice that, and so on, and last the width. Windows of the last level are
    compared by 128 bits of hash.
    """
    lengths = [n for n in (start << k for k in range(width.bit_length())) if n < width] + [width]
    levels = [word_windows(width, n) for n in lengths]
    hot = frequent(docs, levels)
    flagged = with_copies(docs)

    def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off) = batch.column(0).to_numpy(zero_copy_only=False), column_bytes(batch.column(1))
            for a, b, part, poff in chunks(data, off):
                starts, ends, first = words(part, poff)
                at = candidates(batch, a, b, part, poff, levels[-2] if len(levels) > 1 else None)
                if at is None:
                    at = np.flatnonzero(inside(len(starts), first, width))
                h = word_grams(word_hashes(part, starts, ends), width)[at]
                g = word_grams(word_hashes(part, starts, ends, 1), width)[at]
                text = owner(first, at)
                one = np.unique(keyed(h ^ mix(g), text), return_index=True)[1]
                h, g, d = h[one], g[one], ids[a + text[one]]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(salts(h, hot[-1], d)), pa.array(d, pa.int64())], names=["h", "g", "salt", "doc_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, off), copy = column_bytes(batch.column(1)), batch.column(3).to_pylist()
            count, removed, kept = [], [], []
            for a, b, part, poff in chunks(data, off):
                keys = mark_keys(batch.column(2), a, b)
                starts, ends, first = words(part, poff)
                gone = np.zeros(len(starts) + 1, np.int64)
                if len(keys):
                    at = np.flatnonzero(inside(len(starts), first, width))
                    h = word_grams(word_hashes(part, starts, ends), width)[at]
                    at = at[np.isin(keyed(h, owner(first, at)), keys)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                for k in range(b - a):
                    own = gone[first[k] : first[k + 1]]
                    w = part[poff[k] : poff[k + 1]].tobytes().split()
                    if copy[a + k] and len(w) >= width:
                        own = np.ones(len(w), bool)
                    count.append(len(w))
                    removed.append(int(own.sum()))
                    kept.append(b" ".join([x for x, out in zip(w, own, strict=True) if not out] if removed[-1] else w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    texts = flagged.where("copy is null")
    for k, windows in enumerate(levels[:-1]):
        texts = marked(flagged, shared(anchor_rows(texts, windows, hot[k], levels[k - 1] if k else None), True))
    least = F.min("doc_id").over(Window.partitionBy("h", "g", "salt")).alias("least")
    ranked = texts.mapInArrow(last_rows, "h bigint, g bigint, salt int, doc_id bigint").select("*", least)
    later = ranked.where("doc_id > least").select("doc_id", "h")
    heads = ranked.where(F.when(F.col("salt") > 0, F.col("least")) == F.col("doc_id")).select("h", "g", "doc_id")  # of split groups
    heads = heads.select("*", F.min("doc_id").over(Window.partitionBy("h", "g")).alias("least")).where("doc_id > least").select("doc_id", "h")
    return finished(docs, flagged, gathered(later.unionByName(heads), "h")).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def marked(flagged: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents that have marks. Spark shuffles flagged once and reads that again for each level."""
    return flagged.join(marks, "doc_id").select("doc_id", "text", "marks", "copy")


def finished(docs: DataFrame, flagged: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, marks, copy of all rows, those without a doc_id too."""
    every = flagged.join(marks, "doc_id", "left").select("doc_id", "text", "marks", "copy")
    kind = dict(marks.dtypes)["marks"]
    return every.unionByName(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text", F.lit(None).cast(kind).alias("marks"), F.lit(None).cast("boolean").alias("copy")))
