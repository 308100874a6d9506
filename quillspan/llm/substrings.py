"""Substring removal: seed and extend over winnowed anchors.

A window is ``LENGTH`` consecutive words. Of the runs of ``SEED`` words inside a
window the leftmost one with the smallest hash is the window's anchor, so equal
windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs. A first scan counts the anchors: one that occurs once has no repeat.
Occurrences of the others are joined on the anchor; each carries fingerprints of
the windows that extend it to both sides, which tell how far a match reaches.
Runs of matching windows are the maximal repeats. Windows are equal if 128 bits of
their words' hashes agree.

Scale: a task first compares what it has itself, so a passage that a third of
all texts share leaves each slice of texts once. One shuffle moves anchors (about
one for eight words, 8 bytes), one the windows of those that repeat, one the texts
to their intervals. The repeating anchors are sent as a table of 2**27 bits, which
lets a few others through, to no effect. An anchor with more than ``HOT``
occurrences isn't gathered: its windows are dealt out one by one, by their
fingerprints, and pass in order. Nothing is collected, no pairs are made and no
group is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SLICE_BYTES, binary_array, bits_of, bounded_batches, gram_hashes, in_table, materialise, mix64, run_tables, slices, table, text_buffers, tidy, word_bounds, word_hashes

LENGTH = 20
SEED = 6
#: Occurrences (in slices of texts) from which on an anchor's windows are dealt out one by one.
HOT = 4096
#: Bits of the table of repeating anchors, as a power of two.
BITS = 27

_SEEDS = "key bigint, doc_id bigint, place bigint, n int, prints binary"
_SPANS = "doc_id bigint, mark bigint, first bigint, last bigint"
# place: mark (28 bits), first window (27), the anchor's offset in it (4), windows (4)
_MARK, _FIRST, _OFFSET = 35, 8, 4
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _mark() -> F.Column:
    """28 bits of the text, which tell texts of one doc_id apart."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 36)


def _leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of ``width``."""
    n = len(x) - width + 1
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(x[b] < x[a], b, a), have + step
    return at[:n]


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs that ``breaks`` (true at a run's first element) cuts."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.append(first, len(breaks)))


def _batch(key: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, prints: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(n.astype(np.int32)), prints], ["key", "doc_id", "place", "n", "prints"])


class Windows(NamedTuple):
    """The windows of one slice of texts: text, place, first word (in the slice), anchor, two fingerprints, and the first equal window."""

    own: np.ndarray
    at: np.ndarray
    word: np.ndarray
    anchor: np.ndarray
    seeds: np.ndarray
    prints: np.ndarray
    more: np.ndarray
    first: np.ndarray


def _windows(data: np.ndarray, off: np.ndarray) -> Windows | None:
    starts, ends, first_word = word_bounds(data, off)
    if len(starts) < LENGTH:
        return None
    words = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first_word))
    w = np.flatnonzero(owner[: len(owner) - LENGTH + 1] == owner[LENGTH - 1 :])
    if not len(w):
        return None
    seeds = gram_hashes(words, SEED)
    anchor = _leftmost_min(seeds, LENGTH - SEED + 1)[w]
    prints, more = gram_hashes(words, LENGTH)[w], gram_hashes(mix64(words ^ _C), LENGTH)[w]
    # texts stand in order of doc_id and mark, so the first index is the earliest occurrence
    _, first, back = np.unique(prints, return_index=True, return_inverse=True)
    first = first[back]
    if (more[first] != more).any():  # half of the bits agree by chance
        _, first, back = np.unique(np.stack([prints, more]), axis=1, return_index=True, return_inverse=True)
        first = first[back.ravel()]
    return Windows(owner[w], w - first_word[owner[w]], w, anchor, seeds, prints, more, first)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Windows]]:
    """doc_id and mark of the texts of each slice, in that order, and their windows."""
    for b in batches:
        doc = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        mark = b.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((mark, doc))
        data, off = text_buffers(b.column("text").take(pa.array(order)))
        doc, mark = doc[order], mark[order]
        for i, j in slices(off, SLICE_BYTES):
            x = _windows(data[off[i] : off[j]], off[i : j + 1] - off[i])
            if x is not None:
                yield doc[i:j], mark[i:j], x


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: the anchors of a slice's windows, and 2 for those that it has at several places, else 1.

    Where a slice ends may differ from scan to scan, so repeats inside one count too.
    """
    for _, _, x in _slices(batches):
        keys, n = np.unique(x.seeds[np.unique(x.anchor)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2))], ["key", "n"])


def _pairs(x: Windows, at: np.ndarray) -> np.ndarray:
    return np.stack([x.prints[at], x.more[at]], axis=1).astype("<u8")


def _finder(repeating: np.ndarray, hot: np.ndarray | None):
    """A slice's own repeats (n > 0), and anchors with the windows that it has first (n = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, mark, x in _slices(batches):
            mine, own, at = np.arange(len(x.at)), x.own, x.at
            f = x.first
            same = (doc[own[f]] == doc[own]) & (mark[own[f]] == mark[own]) & (at[f] == at)
            g = np.flatnonzero((f != mine) & ~same)
            if len(g):
                i, n = _runs(np.concatenate(([True], (np.diff(at[g]) != 1) | (np.diff(own[g]) != 0))))
                i = g[i]
                place = (mark[own[i]] << _MARK) | (at[i] << _FIRST)
                # spread by a hash: these rows only pass through
                key = mix64(doc[own[i]].astype(np.uint64) * _C + at[i].astype(np.uint64))
                yield _batch(key, doc[own[i]], place, n + LENGTH - 1, pa.nulls(len(i), pa.binary()))
            key = x.seeds[x.anchor]
            c = np.flatnonzero((f == mine) & in_table(repeating, key))
            if hot is not None:
                c = c[~in_table(hot, key[c])]
            if len(c):
                a = x.anchor[c]
                i, n = _runs(np.concatenate(([True], (np.diff(at[c]) != 1) | (np.diff(own[c]) != 0) | (np.diff(a) != 0))))
                i0 = c[i]
                place = (mark[own[i0]] << _MARK) | (at[i0] << _FIRST) | ((a[i] - x.word[i0]) << _OFFSET) | n
                yield _batch(key[i0], doc[own[i0]], place, np.zeros(len(i)), binary_array(_pairs(x, c).tobytes(), np.concatenate(([0], np.cumsum(n) * 16))))

    return run


def _single(hot: np.ndarray):
    """The windows of hot anchors that a slice has first, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, mark, x in _slices(batches):
            c = np.flatnonzero((x.first == np.arange(len(x.first))) & in_table(hot, x.seeds[x.anchor]))
            if len(c):
                cols = (x.prints[c].view(np.int64), x.more[c].view(np.int64), doc[x.own[c]], mark[x.own[c]], x.at[c])
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in cols], ["key", "more", "doc_id", "mark", "first"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all but the first of equal windows, from rows sorted by window, doc_id, mark and place; one row is remembered."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        key, more, doc, mark, at = (b.column(c).to_numpy() for c in ("key", "more", "doc_id", "mark", "first"))
        new = np.concatenate(([held is None or held[:2] != (key[0], more[0])], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        known = held if held is not None else (0, 0, 0, 0, 0)
        d, m, f = (np.where(head >= 0, x[np.maximum(head, 0)], k) for x, k in zip((doc, mark, at), known[2:], strict=True))
        # repeated rows are one window
        gone = ~new & ~((doc == d) & (mark == m) & (at == f))
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(mark[gone]), pa.array(at[gone]), pa.array(at[gone] + LENGTH)], ["doc_id", "mark", "first", "last"])
        if head[-1] >= 0:
            i = head[-1]
            held = (key[i], more[i], doc[i], mark[i], at[i])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from rows sorted by key, doc_id and place; a key's rows are all in one table."""
    for t in run_tables(batches, "key"):
        key, doc, place, n = (t.column(c).to_numpy() for c in ("key", "doc_id", "place", "n"))
        passed = n > 0
        out = [(doc[passed], place[passed] >> _MARK, (place[passed] >> _FIRST) & 0x7FFFFFF, n[passed].astype(np.int64))]
        r = np.flatnonzero(~passed)
        if len(r):
            prints, _ = text_buffers(t.column("prints").combine_chunks())
            prints = prints.view("<u8").astype(np.uint64).reshape(-1, 2)
            many = place[r] & 15
            row = np.repeat(r, many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            offset = ((place[row] >> _OFFSET) & 15) - step
            at = ((place[row] >> _FIRST) & 0x7FFFFFF) + step
            mark = place[row] >> _MARK
            # rows of a key come by doc_id, mark and start; of one document's windows the earlier stand first
            order = np.lexsort((np.arange(len(row)), prints[:, 1], prints[:, 0], offset, key[row]))
            s = (key[row][order], offset[order], prints[order, 0], prints[order, 1])
            head = np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in s])))
            first = np.empty(len(row), np.int64)
            first[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            same = (doc[row[first]] == doc[row]) & (mark[first] == mark) & (at[first] == at)
            g = np.flatnonzero((first != np.arange(len(row))) & ~same)
            if len(g):
                i, m = _runs(np.concatenate(([True], (np.diff(at[g]) != 1) | (np.diff(row[g]) != 0))))
                i = g[i]
                out.append((doc[row[i]], mark[i], at[i], m + LENGTH - 1))
        d, k, f, m = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(f), pa.array(f + m)], ["doc_id", "mark", "first", "last"])


def repeat_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, mark, first, last: word spans (end exclusive) whose windows start earlier somewhere.

    Earlier: smaller doc_id, or the same document and an earlier start. Spans may
    touch and overlap. Null and empty texts, and those under ``LENGTH`` words, have none.
    A null doc_id counts as the smallest. Rows that share a doc_id are told apart
    by their text (``mark``): of equal rows each keeps what the others keep, and of
    different texts under one doc_id the one with the smaller mark is the earlier.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), _mark().alias("mark"), "text")
    counts = d.mapInArrow(tidy(_anchors), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("n > 1"), "anchors")
    repeating = bits_of(counts, "key", BITS)
    common = counts.where(F.col("n") > hot)
    often = None if common.isEmpty() else bits_of(common, "key", BITS)
    seeds = d.mapInArrow(tidy(_finder(repeating, often)), _SEEDS)
    out = seeds.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(tidy(_extend), _SPANS)
    if often is None:
        return out
    one = d.mapInArrow(tidy(_single(often)), "key bigint, more bigint, doc_id bigint, mark bigint, first bigint")
    return out.unionByName(one.repartition("key", "more").sortWithinPartitions("key", "more", "doc_id", "mark", "first").mapInArrow(tidy(_later), _SPANS))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column("text"))
        raw = data.tobytes()
        spans = b.column("spans").to_pylist()
        total, gone, kept = [], [], []
        for i, s in enumerate(spans):
            words = raw[off[i] : off[i + 1]].split()
            total.append(len(words))
            if s:
                out, at = [], 0
                for x in sorted((y["first"], y["last"]) for y in s):
                    if x[0] > at:
                        out += words[at : x[0]]
                    at = max(at, x[1])
                words = out + words[at:]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, text: each row's text without the words of repeated windows.

    What is left is joined by single spaces. A row comes back for each row of
    ``docs``; null and empty texts give empty ones. Only doc_id and text are read.
    """
    spans = repeat_spans(docs, hot).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "spans")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.join(spans, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_d")) & (_mark() == F.col("_m")), "left")
    return d.select("doc_id", "text", "spans").mapInArrow(tidy(_cut), "doc_id bigint, n_words bigint, n_removed bigint, text string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The rule itself, for tests on small tables with unique ids."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc_id, text in sorted(rows):
        w = (text or "").encode().split()
        gone: set[int] = set()
        for i in range(len(w) - LENGTH + 1):
            k = tuple(w[i : i + LENGTH])
            if k in seen:
                gone |= set(range(i, i + LENGTH))
            seen.add(k)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


OP2_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS l FROM documents),
u AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w),
v AS (SELECT doc_id, n, p, word, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) AS win FROM u),
x AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM (SELECT doc_id, p, md5(array_to_string(win, ' ')) AS win FROM v WHERE p <= n - {LENGTH - 1})),
y AS (SELECT u.doc_id, u.p, u.word, coalesce(max(CASE WHEN x.again THEN 1 ELSE 0 END) OVER (PARTITION BY u.doc_id ORDER BY u.p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.p = x.p),
z AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, len(w.l)::BIGINT AS n_words, coalesce(z.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM w LEFT JOIN z USING (doc_id)
"""
