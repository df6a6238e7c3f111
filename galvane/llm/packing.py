"""Best-fit packing: best-two-fit.

Each document becomes token ids and an end id; longer ones are cut into whole sequences and a
first piece with the rest. Pieces are dealt to packing groups of bounded size by a hash of their
identity. Within a group a sequence is filled greedily, longest fitting piece first; then its
smallest piece gives way to two unpacked ones if those fill the enlarged gap more tightly.
A group wastes less than one sequence more than it must, so groups of tens of thousands of
pieces cost next to nothing against packing everything at once.

Defined results: a null or empty text is the end id alone; rows repeat as they are and are packed
each; a null doc_id is kept; ties go to the smaller (doc_id, copy, piece).
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GROUP_PIECES = 40_000
_made: dict[tuple[str, str | None], object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_path(name: str = "byte_bpe_50k.json") -> str:
    """The same vocabulary as merge ranks."""
    return os.path.splitext(tokenizer_path(name))[0] + ".tiktoken"


def encoder(path: str, ranks: str | None = None):
    """A function from a text to its ids, as the tokenizer file at path gives them.

    ranks: a file with the same vocabulary as merge ranks. If it is given, texts in Latin letters take
    the faster merge over those ranks; it gives the same ids (tests hold both against each other). All
    other texts, and those with the tokenizer's control string, take the tokenizer file itself.
    """
    if (path, ranks) in _made:
        return _made[path, ranks]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if ranks is None:
        _made[path, ranks] = slow
        return slow
    import re

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    odd = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ſ]")

    def encode(text: str) -> list[int]:
        return slow(text) if odd.search(text) or "<|" in text else fast.encode_ordinary(text)

    _made[path, ranks] = encode
    return encode


def pieces(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, with_ids: bool = True, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids of each piece."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            rows, ids_of = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % limit or limit
                start = 0
                for k, stop in enumerate(range(first, len(ids) + 1, limit)):
                    part = ids[start:stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
                    start = stop
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.concatenate(ids_of) if ids_of else np.zeros(0, np.int32)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids_of])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its sequence and its place there."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(limit + 2))
    left = np.diff(first)  # unpacked pieces by length 0..limit
    taken = np.zeros(limit + 1, np.int64)
    bins, places, number, todo = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, n
    have = np.zeros(limit + 1, bool)
    have[:] = left > 0
    longest_upto = np.maximum.accumulate(np.where(have, np.arange(limit + 1), 0))

    def refresh() -> None:
        nonlocal longest_upto
        longest_upto = np.maximum.accumulate(np.where(have, np.arange(limit + 1), 0))

    def use(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            have[size] = False
            refresh()

    def back(size: int) -> None:
        left[size] += 1
        if not have[size]:
            have[size] = True
            refresh()

    while todo:
        chosen, gap = [], limit
        while gap and (size := int(longest_upto[gap])):
            chosen.append(size)
            gap -= size
            use(size)
        if gap and todo > len(chosen) + 1:
            least = chosen[-1]
            room = gap + least
            sizes = np.flatnonzero(have[: room + 1])
            mate = longest_upto[room - sizes]
            sums = np.where((mate > 0) & ((mate != sizes) | (left[sizes] > 1)), sizes + mate, 0)
            if len(sums) and (best := int(sums.argmax()), sums.max())[1] > least:
                back(least)
                chosen[-1:] = sorted((int(sizes[best]), int(mate[best])), reverse=True)
                for size in chosen[-2:]:
                    use(size)
        at = 0
        for size in chosen:
            k = order[first[size] + taken[size]]
            taken[size] += 1
            bins[k], places[k] = number, at
            at += size
        number += 1
        todo -= len(chosen)
    return bins, places


def pack(parts: DataFrame, limit: int = 1024) -> DataFrame:
    """parts with sequence_id and offset; groups follow the number of pieces."""
    groups = max(1, -(-parts.count() // GROUP_PIECES))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema)}, sequence_id bigint, offset bigint"
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    names = parts.columns

    def run(key, table):
        table = table.select(names).combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, places = two_fit(table.column("length").to_numpy(), limit)
        return table.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(places))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_with_ids(parts: DataFrame, limit: int = 1024) -> DataFrame:
    """parts (with ids and row, a number that names the piece) packed; groups hold all but the ids, which join by row."""
    slim = pack(parts.drop("ids"), limit)
    return slim.join(parts.select("row", "ids"), "row").drop("row")
