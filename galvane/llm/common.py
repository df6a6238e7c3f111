"""What the operators share: work folders, text as byte arrays, gram hashes, packed shuffles.

Texts reach the tasks as Arrow string columns and are worked on as numpy byte arrays, a few MB
at a time, so a task's memory follows its chunk and its longest text, not its partition.
"""

from __future__ import annotations

import contextlib
import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 3 << 20
U64 = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that is unset a local session gets a folder of its own; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(work_path, "own", None) or tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
        work_path.own = root
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    for held in _held:
        held.append(path)
    return path


_held: list[list[str]] = []


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end: all that is wanted must be stored elsewhere by then."""
    own: list[str] = []
    _held.append(own)
    try:
        yield
    finally:
        _held.remove(own)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in own:
            where = hadoop(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors don't matter."""
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key() -> list[Column]:
    """doc_id and text_hash: what tells a document's row from others of its doc_id."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def without_rows(docs: DataFrame, gone: DataFrame, *more: str) -> DataFrame:
    """docs without the rows whose doc_id (null too), text and columns more are in gone (doc_id, text_hash, more)."""
    named = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in ("doc_id", "text_hash", *more)]).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(named["_gone_doc_id"]) & (F.xxhash64(docs["text"]) == named["_gone_text_hash"])
    for c in more:
        same &= docs[c].cast("string").eqNullSafe(named[f"_gone_{c}"])
    return docs.join(named, same, "left_anti").select(docs.columns)


def buckets_for(docs: DataFrame, text: str = "text", each: int = BUCKET_BYTES) -> int:
    """A number of shuffle buckets in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(8, total // each))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column end to end, and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of whole texts of about size bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept while they are small."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = got
    return got


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """h with h[i] the hash of values[:i]; span() takes differences of it."""
    h = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=h[1:])
    return h


def span(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return (h[end] - h[start]) * powers(base, len(h))[1][start]


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes in a row, by first byte."""
    if len(data) < n:
        return np.zeros(0, U64)
    h = prefix_hash(_TABLE[data], _BASE)
    return mix((h[n:] - h[:-n]) * powers(_BASE, len(data))[1][: len(data) - n + 1])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+ and, for each text, the number of its first."""
    ink = ~_SPACE[data]
    before, after = np.empty_like(ink), np.empty_like(ink)
    if len(ink):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = ink[:-1], ink[1:]
        edge = off[(off > 0) & (off < len(data))]
        before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(ink & ~before)
    return starts, np.flatnonzero(ink & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: its bytes are taken in eight at a time, so no two words collide by their shape."""
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    out = mix(size.astype(U64) ^ U64(seed * _WORD_BASE & 0xFFFFFFFFFFFFFFFF))
    for k in np.flatnonzero(size > 4096):  # few words, and too many rounds for them
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    live, at = np.flatnonzero(size <= 4096), 0
    while len(live):
        rest = size[live] - at
        block = eight[starts[live] + at]
        short = rest < 8
        block[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        out[live] = join_hashes(out[live], block)
        at += 8
        live = live[rest > 8]
    return out


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in order."""
    return mix(mix(b + U64(_BASE)) ^ a * U64(_WORD_BASE))


def word_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, by first word: of two runs of words that cover them, doubled up to there."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    width, h = 1, mix(hashes + U64(n))
    while width < n:
        step = min(width, n - width)
        h = join_hashes(h[:-step], h[step:])
        width += step
    return h


def whole_grams(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words first to last, for each pair of bounds."""
    out = mix((last - first).astype(U64) * U64(0x2545F4914F6CDD1D))
    for k in range(int((last - first).max(initial=0))):
        more = first + k < last
        out[more] = join_hashes(out[more], hashes[first[more] + k])
    return out


def inside(n_items: int, off: np.ndarray, width: int) -> np.ndarray:
    """For each start among n_items - width + 1: does the run of width items stay in one text?"""
    m = n_items - width + 1
    if m <= 0:
        return np.zeros(0, bool)
    crossing = np.zeros(m + 1, np.int64)
    edge = off[(off > 0) & (off < n_items)]
    edge = np.unique(edge)
    np.add.at(crossing, np.clip(edge - width + 1, 0, m), 1)
    np.add.at(crossing, np.clip(edge, 0, m), -1)
    return np.cumsum(crossing)[:m] == 0


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The place of the smallest of each w values in a row, the first of equals.

    The place stands in the low half in lieu of the value's own, so that one minimum finds both;
    which place wins depends on the w values alone.
    """
    m = len(values) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low = U64(0xFFFFFFFF)
    keyed = np.full(len(values) + -len(values) % w, np.iinfo(U64).max, U64)
    keyed[: len(values)] = (values & ~low) | np.arange(len(values), dtype=U64)
    v = keyed.reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & low).astype(np.int64)


def dealt(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The arrays split by bucket number."""
    kind = np.uint16 if n <= 65536 else np.int64
    order = np.argsort(bucket.astype(kind), kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket, prepend=-1))
    for i, a in enumerate(cut):
        part = order[a : cut[i + 1] if i + 1 < len(cut) else len(order)]
        yield int(sorted_bucket[a]), tuple(x[part] for x in arrays)


PACKED = "bucket int, data binary"


def packed(rows: list[tuple[int, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([pickle.dumps(x, protocol=5) for _, x in rows], pa.binary())], names=["bucket", "data"])


def unpacked(table: pa.Table) -> list:
    return [pickle.loads(x) for x in table.column("data").to_pylist()]


def by_id(ids: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The arrays split by id."""
    order = np.argsort(ids, kind="stable")
    got = ids[order]
    cut = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]])) if len(got) else []
    for i, a in enumerate(cut):
        part = order[a : cut[i + 1] if i + 1 < len(cut) else len(order)]
        yield int(got[a]), tuple(x[part] for x in arrays)
