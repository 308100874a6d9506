"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a slice of texts are concatenated and indexed by a
suffix array, sorted as deep as the longest piece; every piece of the vocabulary
is found by binary search, as a range of the array. Its occurrences are edges;
they are put in order of position and length and then relaxed: in each segment
the edge of the best score that joins two neighbours, the leftmost of equal ones,
is contracted until none is left. That is byte-pair encoding as defined, so ids
equal those of the library. What has no piece falls back to bytes.

A segment is a run of blanks and the word after it: no piece reaches over a word's
end (checked when the vocabulary is read; else a text is one segment). Within a
segment, edges never join what stands on two sides of a place that no edge spans,
so a long segment falls into parts there, and memory doesn't follow its length.

Texts are independent: nothing is shuffled, and memory follows a slice, not a batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.llm.common import bounded_batches, slices, table, text_buffers, tidy, word_hashes

#: The vocabulary file, read by the driver alone.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SLICE_TEXT = 1 << 20
#: Code points that one index holds.
INDEX = 1 << 17
#: Segments from this length on are contracted with a heap.
LONG = 64
_NONE = np.iinfo(np.int32).max
_JOINED = re.compile(f"[^{BLANK}]{BLANK}")


class Vocabulary(NamedTuple):
    pieces: list[str]
    codes: np.ndarray  # for each code point a small number, 0 if no piece has it
    ids: np.ndarray  # of the pieces that text can have
    lengths: np.ndarray
    grams: np.ndarray  # their codes, a row each, padded with 0
    rank: np.ndarray  # by id: 0 for the best score, equal for equal scores
    byte_ids: np.ndarray
    surface: list[bytes]  # by id
    segmented: bool


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """The fields of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            x = b[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", b[i : i + n])[0]
            i += n


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """A byte-pair model file with byte fallback, no normalisation and a blank put before each text."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    rows = []
    for _, raw in (p for p in parts if p[0] == 1):
        d = dict(_fields(raw))
        rows.append((d[1].decode(), d.get(2, 0.0), d.get(3, 1)))
    trainer = dict(_fields(next(p[1] for p in parts if p[0] == 2)))
    normal = dict(_fields(next(p[1] for p in parts if p[0] == 3)))
    if trainer.get(3) != 2 or normal.get(1) != b"identity" or not normal.get(3, 1) or normal.get(4, 1) or {r[2] for r in rows} - {1, 2, 3, 6}:
        raise ValueError(f"{path}: only byte-pair models without normalisation and own pieces are supported")
    byte_ids = np.full(256, -1, np.int32)
    surface = []
    for i, (p, _, kind) in enumerate(rows):
        if kind == 6:
            byte_ids[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]))
        else:
            surface.append(p.replace(BLANK, " ").encode() if kind == 1 else b"")
    if (byte_ids < 0).any():
        raise ValueError(f"{path}: no byte fallback")
    ids = np.array([i for i, r in enumerate(rows) if r[2] == 1], np.int32)
    lengths = np.array([len(rows[i][0]) for i in ids])
    letters = sorted({c for i in ids for c in rows[i][0]})
    codes = np.zeros(0x110000, np.uint16)
    codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    depth = 4
    while depth < lengths.max():
        depth *= 2
    grams = np.zeros((len(ids), depth), np.uint64)
    for k, i in enumerate(ids):
        grams[k, : lengths[k]] = codes[[ord(c) for c in rows[i][0]]]
    rank = np.full(len(rows), _NONE, np.int32)
    rank[ids] = np.unique([-rows[i][1] for i in ids], return_inverse=True)[1]
    return Vocabulary([r[0] for r in rows], codes, ids, lengths, grams, rank, byte_ids, surface, not any(_JOINED.search(rows[i][0]) for i in ids))


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each key, given the order that sorts them."""
    s = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
    return out


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(x), x.dtype)
    out[: max(0, len(x) - n)] = x[n:]
    return out


def edges(x: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece ids by length and position: row n - 1 has the piece of length n that starts there, or -1.

    Suffixes are sorted by 4, 8, 16 ... codes; at each depth the pieces that it
    covers are looked up with two binary searches.
    """
    table_ = np.full((int(v.lengths.max()), len(x)), -1, np.int32)
    four = lambda g, at: (g[:, at] << np.uint64(48)) | (g[:, at + 1] << np.uint64(32)) | (g[:, at + 2] << np.uint64(16)) | g[:, at + 3]
    w = x.astype(np.uint64)
    key = (w << np.uint64(48)) | (_ahead(w, 1) << np.uint64(32)) | (_ahead(w, 2) << np.uint64(16)) | _ahead(w, 3)
    full = np.uint64(0xFFFF)
    depth = 4
    # what a piece's codes from a multiple of depth on are as a range of keys of that depth
    blocks = v.grams.shape[1] // 4
    low = [four(v.grams, 4 * b) for b in range(blocks)]
    high = []
    for b in range(blocks):
        g = v.grams[:, 4 * b : 4 * b + 4].copy()
        g[np.arange(4 * b, 4 * b + 4)[None, :] >= v.lengths[:, None]] = full
        high.append(four(g, 0))
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        here = np.flatnonzero((v.lengths <= depth) & (v.lengths > (depth // 2 if depth > 4 else 0)))
        a, b = np.searchsorted(s, low[0][here], "left"), np.searchsorted(s, high[0][here], "right")
        n = np.maximum(b - a, 0)
        at = order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        table_[np.repeat(v.lengths[here] - 1, n), at] = np.repeat(v.ids[here], n)
        if depth >= v.grams.shape[1]:
            return table_
        rank = _dense(key, order)
        first = np.concatenate((rank[order], [np.uint64(rank.max() + 1) if len(rank) else np.uint64(0)]))
        shift = np.uint64(32)
        # a key's rank if it occurs; bounds that don't occur become the ranks around them
        lo = [first[np.searchsorted(s, k, "left")] for k in low]
        hi = [np.concatenate(([0], first[:-1] + 1))[np.searchsorted(s, k, "right")].astype(np.uint64) for k in high]
        top = np.uint64(0xFFFFFFFF)
        new = [], []
        for i in range(0, len(lo), 2):
            rest = v.lengths - depth * i  # the piece's codes from here on
            whole = rest > depth  # the first half is one key, the second a range of them
            some = (hi[i] > lo[i]) & (~whole | (hi[i + 1] > lo[i + 1]))
            new[0].append(np.where(some, (lo[i] << shift) | np.where(whole, lo[i + 1], np.uint64(0)), np.uint64(1)))
            new[1].append(np.where(some, ((np.maximum(hi[i], 1) - np.uint64(1)) << shift) | np.where(whole, np.maximum(hi[i + 1], 1) - np.uint64(1), top), np.uint64(0)))
        low, high = new
        key = (rank << shift) | _ahead(rank, depth)
        depth *= 2


def _contract_long(table_: np.ndarray, rank: np.ndarray, a: int, b: int, size: np.ndarray) -> None:
    """Contract one segment with a heap; ``size`` gets the symbols' lengths, 0 inside a symbol."""
    most = len(table_)
    after, before = array("q", range(a + 1, b + 1)), array("q", range(a - 1, b - 1))
    heap: list[int] = []
    bits = most.bit_length()
    low = (1 << bits) - 1

    def offer(i: int) -> None:
        j = after[i - a]
        if j < b and size[i] + size[j] <= most:
            p = table_[size[i] + size[j] - 1, i]
            if p >= 0:  # score, place and both lengths as one number
                heapq.heappush(heap, (((int(rank[p]) << 40 | i) << bits | int(size[i])) << bits) | int(size[j]))

    for i in range(a, b - 1):
        offer(i)
    while heap:
        x = heapq.heappop(heap)
        i, n, m = (x >> 2 * bits) & ((1 << 40) - 1), (x >> bits) & low, x & low
        j = after[i - a]
        if size[i] != n or j >= b or size[j] != m:
            continue
        size[i], size[j] = n + m, 0
        after[i - a] = after[j - a]
        if after[j - a] < b:
            before[after[j - a] - a] = i
        if before[i - a] >= a:
            offer(before[i - a])
        offer(i)


def _contract(table_: np.ndarray, rank: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Symbol lengths by position (0 inside a symbol) of the segments between ``bounds``."""
    size = np.ones(bounds[-1], np.int64)
    n = np.diff(bounds)
    for k in np.flatnonzero(n >= LONG):
        _contract_long(table_, rank, int(bounds[k]), int(bounds[k + 1]), size)
    short = np.flatnonzero((n < LONG) & (n > 1))
    seg = np.repeat(np.arange(len(short)), n[short])
    at = np.arange(len(seg)) + np.repeat(bounds[:-1][short] - (np.cumsum(n[short]) - n[short]), n[short])
    wide = np.append(rank, _NONE)  # -1 is no piece
    most = len(table_)
    while len(at):
        both = size[at] + np.append(size[at[1:]], 0)
        ok = np.append(seg[1:] == seg[:-1], False) & (both <= most)
        cost = np.full(len(at), _NONE, np.int64)
        cost[ok] = wide[table_[both[ok] - 1, at[ok]]]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        count = np.diff(np.append(first, len(seg)))
        best = np.minimum.reduceat(cost, first)
        # the leftmost best pair of each segment that has one
        hit = np.flatnonzero((cost == np.repeat(best, count)) & (cost < _NONE))
        hit = hit[np.append(True, seg[hit[1:]] != seg[hit[:-1]])] if len(hit) else hit
        size[at[hit]] = both[hit]
        size[at[hit + 1]] = 0
        keep = np.repeat(best < _NONE, count)
        keep[hit + 1] = False
        at, seg = at[keep], seg[keep]
    return size


def _cuts(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places that no piece reaches over, and ``bounds``: what stands between two of them is contracted by itself."""
    n = found.shape[1]
    over = np.zeros(n + 1, np.int32)
    for k in range(1, len(found)):
        at = np.flatnonzero(found[k] >= 0)
        over[at + 1] += 1
        over[np.minimum(at + k + 1, n)] -= 1
    free = np.cumsum(over) == 0
    free[bounds] = True
    return np.flatnonzero(free)


def _encode_segments(code: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and where each segment's begin.

    An index holds ``INDEX`` code points and ends where no piece reaches over, so a
    segment of any length is taken in parts; only a longer stretch without such a
    place has an index of its own.
    """
    most = int(v.lengths.max())
    places, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    at, size = 0, INDEX
    while at < len(code):
        end = min(at + size, len(code))
        x = code[at:end]
        found = edges(v.codes[x], v)
        own = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end, "right")] - at
        cuts = _cuts(found, np.append(own, 0))
        if end < len(code):
            # a piece that begins near the end may reach over it: only given bounds count there
            cuts = cuts[(cuts <= len(x) - most) | np.isin(cuts, own)]
        if len(cuts) < 2:
            size *= 2
            continue
        width = int(cuts[-1])
        lengths = _contract(found, v.rank, cuts)
        here = np.flatnonzero(lengths)
        places.append(here + at)
        out.append(found[lengths[here] - 1, here])
        at, size = at + width, INDEX
    at, ids = np.concatenate(places), np.concatenate(out)
    cp = code[at].astype(np.int64)
    width = np.where(ids >= 0, 1, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))
    ends = np.cumsum(width)
    flat = np.repeat(ids, width)
    raw = np.flatnonzero(flat < 0)
    if len(raw):
        symbol = np.searchsorted(ends, raw, "right")
        c, w = cp[symbol], width[symbol]
        nth = raw - (ends[symbol] - w)
        rest = w - 1 - nth  # bytes that follow
        lead = np.where(w == 1, c, (c >> (6 * (w - 1))) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[w])
        flat[raw] = v.byte_ids[np.where(nth == 0, lead, 0x80 | ((c >> (6 * rest)) & 0x3F))]
    return flat, np.concatenate(([0], ends))[np.searchsorted(at, bounds)]


def _distinct(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segment of each kind, and each segment's kind. Hashes that meet by chance leave all segments apart."""
    _, one, kind = np.unique(word_hashes(code, first, last), return_index=True, return_inverse=True)
    size = last - first
    if (size == size[one][kind]).all():
        shift = np.repeat(first[one][kind] - first, size)
        if (code == code[np.arange(len(code)) + shift]).all():
            return one, kind
    return np.arange(len(first)), np.arange(len(first))


def encode_texts(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other (int32), and offsets; an empty text has none."""
    code = np.frombuffer("".join(BLANK + t.replace(" ", BLANK) for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))))
    if not len(code):
        return np.zeros(0, np.int32), upto
    start = np.zeros(len(code) + 1, bool)
    start[upto] = True
    if v.segmented:
        blank = code == ord(BLANK)
        start[1:-1] |= blank[1:] & ~blank[:-1]
    start[-1] = False
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(code))
    one, kind = _distinct(code, first, last)
    size = (last - first)[one]
    bounds = np.concatenate(([0], np.cumsum(size)))
    flat, at = _encode_segments(code[np.repeat(first[one] - bounds[:-1], size) + np.arange(bounds[-1])], bounds, v)
    n = np.diff(at)[kind]
    total = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(at[:-1][kind] - total[:-1], n) + np.arange(total[-1])]
    return ids.astype(np.int32, copy=False), total[np.searchsorted(first, upto)]


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The text of some ids: without the blank put before it; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(v.surface.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _encoded(batch: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    data, off = text_buffers(batch.column("text"))
    for i, j in slices(off, SLICE_TEXT):
        raw = data[off[i] : off[j]].tobytes()
        texts = [raw[off[k] - off[i] : off[k + 1] - off[i]].decode("utf-8", "replace") for k in range(i, j)]
        yield i, texts, *encode_texts(texts, v)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ids (array of int), the whole text encoded.

    A null or empty text has no ids; U+2581 in a text counts as a blank, as in the
    library. Equal texts get equal ids, repeated rows too; an empty table gives an
    empty one. Other columns pass through; one named ids is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts, ids, off in _encoded(b, vocabulary):
                part = b.slice(i, len(texts))
                col = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "ids"])

    bounded_batches(docs.sparkSession)
    docs = docs.drop("ids")
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *StructType.fromDDL("ids array<int>").fields]))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of ids with decoded, their text; null ids give an empty one. An id outside the vocabulary stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_ids(x or [], vocabulary) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(tidy(run), StructType([*encoded.schema.fields, *StructType.fromDDL("decoded string").fields]))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip."""
    vocabulary = read_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts, ids, off in _encoded(b, vocabulary):
                sha, back, same = [], [], []
                for k, t in enumerate(texts):
                    own = ids[off[k] : off[k + 1]]
                    d = decode_ids(own.tolist(), vocabulary)
                    sha.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(d.encode()).hexdigest())
                    same.append(d == t)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(texts)), pa.array(np.diff(off)), pa.array(sha), pa.array(back), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
