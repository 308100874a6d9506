"""Shared helpers: the shared folder, sorted group streaming and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; a longer single text is one step of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset on
    one machine (tests) a folder under the temporary directory is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a Python worker gets; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches between the JVM and its Python workers by bytes, unless the session bounds them closer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if have <= 0 or have > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: it returns memory in its own time
        return None


_TRIM = _trimmer()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, with freed memory given back to the system now and then and at its end: Python workers stay between tasks and stages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            yield b
            done += b.nbytes
            if done >= 4 * BATCH_BYTES:
                give_back()
                done = 0

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return wrapped


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_tables(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where ``key`` changes, from batches of a partition sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(key)
        last = batch.num_rows - 1
        # first row of the run that the batch ends in
        lo, hi = 0, last
        end = col[last]
        while lo < hi:
            mid = (lo + hi) // 2
            if col[mid] == end:
                hi = mid
            else:
                lo = mid + 1
        same = held and held[-1].column(key)[held[-1].num_rows - 1] == col[0]
        if lo == 0 and same:
            held.append(batch)
            continue
        if lo > 0:
            held.append(batch.slice(0, lo))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


# --- words and hashes -------------------------------------------------------

#: The bytes x20 and x09-x0D; bytes.split() cuts at the same six.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base), np.full(size, self.inv)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least a row each; they cover all rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word; a text's end ends a word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal in every process."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 17), "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _BYTES.to(b - a + 1)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _Q)
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, over text ends too: callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(len(words) + 1)
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[k:] - total[:n]) * down[:n])


# --- tables of bits: sets of 64-bit hashes that let a few others through ------


def bit_place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a hash in a table of 2**bits bits."""
    return (h >> np.uint64(64 - bits + 6)).astype(np.int64), (h >> np.uint64(64 - bits)) & np.uint64(63)


def in_table(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bit = bit_place(h, 6 + (len(words) - 1).bit_length())
    return ((words[word] >> bit) & np.uint64(1)).astype(bool)


def gathered_bits(rows: DataFrame, bits: int) -> np.ndarray:
    """The table of rows (word, bits): 2**bits / 8 bytes whatever the rows."""
    t = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return out


def bits_of(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """The table of a column of hashes (bigint)."""
    word = F.shiftrightunsigned(col, 64 - bits + 6).cast("bigint")
    bit = F.shiftrightunsigned(col, 64 - bits).bitwiseAND(63).cast("int")
    return gathered_bits(df.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits")), bits)


def binary_array(data: bytes, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data)])
