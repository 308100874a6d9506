"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all factors of the normalised test items, as words. Training
words are streamed through it; the length of the longest match that ends at each
word tells which words lie inside an occurrence of a window, and the state tells
whose window it is.

The items are the query set: they are read in blocks of bounded size, each block
one automaton against all rows. Texts are never shuffled for one block; beyond it
only what is joined with the hits found.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.llm.common import bounded_batches, materialise, slices, table, text_buffers, tidy

WINDOW = 13
#: A document is contaminated if ``COVERAGE`` times its hit words are at least its words.
COVERAGE = 20
#: Bytes of item texts in one automaton (some 10 bytes in its arrays for each); more items make more blocks.
BLOCK_BYTES = 4 << 20
#: Words of a run that one step streams.
STRIDE = 512

#: A-Z in lower case; what no word has is a blank. Bytes from x80 on are letters.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, in arrays: some 50 bytes a state; words are numbered by ``vocabulary``.

    Transitions are sorted by state and word, so that many places are streamed at
    once, by binary search. ``top`` is the state whose factors include the last
    ``window`` words of a state's factors; ``short`` the nearest state on the way to
    the root, itself included, that is an item of fewer words.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(name, [number(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.width = len(self.vocabulary) + 1
        self.least = min([window, *(len(w) for _, w in coded)])
        self._next: dict[int, int] = {}
        self._link, self._length = array("i", [-1]), array("i", [0])
        # the words of a state's transitions, as chains: copies of a state need them
        self._head, self._word, self._after = array("i", [-1]), array("i"), array("i")
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.link, self.length = np.array(self._link, np.int32), np.array(self._length, np.int32)
        keys = np.fromiter(self._next, np.int64, len(self._next))
        order = np.argsort(keys)
        self.keys, self.target = keys[order], np.fromiter(self._next.values(), np.int32, len(keys))[order]
        by_length = np.argsort(self.length, kind="stable").tolist()
        link, length = self._link, self._length
        top = array("i", bytes(4 * len(link)))
        for v in by_length[1:]:
            if length[v] >= window:
                top[v] = v if length[link[v]] < window else top[link[v]]
        self.top = np.array(top, np.int32)
        self.names = sorted({name for name, _ in coded})
        at = {name: i for i, name in enumerate(self.names)}
        short: set[tuple[int, int, int]] = set()  # state, words, item
        for name, words in coded:
            if len(words) < window:
                v = 0
                for w in words:
                    v = self._next[v * self.width + w]
                while length[link[v]] >= len(words):
                    v = link[v]
                short.add((v, len(words), at[name]))
        rows = np.array(sorted(short), np.int64).reshape(-1, 3)
        self.short_states, self.short_from = np.unique(rows[:, 0], return_index=True)
        self.short_from = np.append(self.short_from, len(rows))
        self.short_size, self.short_item = rows[:, 1], rows[:, 2]
        near = array("i", bytes(4 * len(link)))
        own = set(self.short_states.tolist())
        for v in by_length[1:]:
            near[v] = v if v in own else near[link[v]]
        self.short = np.array(near, np.int32)
        del self._next, self._link, self._length, self._head, self._word, self._after
        long = [(at[name], words) for name, words in coded if len(words) >= window]
        ids = np.array([w for _, words in long for w in words], np.int32)
        ends = np.cumsum([len(words) for _, words in long], dtype=np.int64)
        place, state, n = self.stream(ids, np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends)
        full = n >= window
        item = np.array([i for i, _ in long], np.int64)[np.searchsorted(ends, place[full], "right")]
        owned = np.unique(np.stack([self.top[state[full]].astype(np.int64), item], axis=1), axis=0).reshape(-1, 2)
        self.item_states, self.item_from = np.unique(owned[:, 0], return_index=True)
        self.item_from = np.append(self.item_from, len(owned))
        self.item = owned[:, 1]

    def _add(self, v: int, w: int, u: int) -> None:
        self._next[v * self.width + w] = u
        self._word.append(w)
        self._after.append(self._head[v])
        self._head[v] = len(self._word) - 1

    def _new(self, length: int, link: int) -> int:
        self._length.append(length)
        self._link.append(link)
        self._head.append(-1)
        return len(self._link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for p's factors with ``w``: q, or a copy of it if q has longer ones."""
        if self._length[q] == self._length[p] + 1:
            return q
        copy = self._new(self._length[p] + 1, self._link[q])
        t = self._head[q]
        while t >= 0:
            self._add(copy, self._word[t], self._next[q * self.width + self._word[t]])
            t = self._after[t]
        self._link[q] = copy
        while p >= 0 and self._next.get(p * self.width + w) == q:
            self._next[p * self.width + w] = copy
            p = self._link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        known = self._next.get(last * self.width + w)
        if known is not None:
            return self._split(last, known, w)
        state, p = self._new(self._length[last] + 1, 0), last
        while p >= 0 and p * self.width + w not in self._next:
            self._add(p, w, state)
            p = self._link[p]
        if p >= 0:
            self._link[state] = self._split(p, self._next[p * self.width + w], w)
        return state

    def stream(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, state and length (``window`` and above are right as such) of the matches of ``least`` words or more that end in the runs first..last of ``ids``.

        Long runs are cut into steps of ``STRIDE`` words with ``window`` - 1 words before
        them: longer matches tell no more. All steps go forward side by side.
        """
        many = np.maximum(1, -(-(last - first) // STRIDE))
        begin = np.repeat(first, many) + STRIDE * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        end = np.minimum(begin + STRIDE, np.repeat(last, many))
        at = np.maximum(begin - self.window + 1, np.repeat(first, many))
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those still on their way stand in front
        at, begin, end = at[order], begin[order], end[order]
        size = end - at
        state, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))
            w = ids[at[:live] + k]
            open_ = np.arange(live)
            while len(open_):
                key = state[open_].astype(np.int64) * self.width + w[open_]
                pos = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                hit = (self.keys[pos] == key) if len(self.keys) else np.zeros(len(key), bool)
                on = open_[hit]
                state[on] = self.target[pos[hit]]
                n[on] += 1
                off = open_[~hit]
                lost = state[off] == 0
                n[off[lost]] = 0
                open_ = off[~lost]
                state[open_] = self.link[state[open_]]
                n[open_] = self.length[state[open_]]
            found = np.flatnonzero((n[:live] >= self.least) & (at[:live] + k >= begin[:live]))
            if len(found):
                out.append((at[found] + k, state[found].copy(), n[found].copy()))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        place, state, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return place, state, n

    def hits(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Last place and words of the windows found, and (last place, item) of those that have them."""
        place, state, n = self.stream(ids, first, last)
        at, size, where, item = [], [], [], []
        full = n >= self.window
        p, i, k = _lists(place[full], self.top[state[full]], self.item_states, self.item_from)
        at.append(p[k == 0])
        size.append(np.full(int((k == 0).sum()), self.window))
        where.append(p)
        item.append(self.item[i])
        u = self.short[state]
        bound = np.where(u == state, n, np.iinfo(np.int32).max)
        while (u > 0).any():
            go = u > 0
            u, place, bound = u[go], place[go], bound[go]
            p, i, _ = _lists(np.arange(len(u)), u, self.short_states, self.short_from)
            ok = self.short_size[i] <= bound[p]
            p, i = p[ok], i[ok]
            at.append(place[p])
            size.append(self.short_size[i])
            where.append(place[p])
            item.append(self.short_item[i])
            u = self.short[self.link[u]]
            bound = np.full(len(u), np.iinfo(np.int32).max)
        return np.concatenate(at), np.concatenate(size), np.concatenate(where), np.concatenate(item)


def _lists(what: np.ndarray, state: np.ndarray, states: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of ``what`` with every entry of its state's list, and the entry's number in the list; states without a list have none."""
    if not len(states):
        z = np.zeros(0, np.int64)
        return what[:0], z, z
    k = np.minimum(np.searchsorted(states, state), len(states) - 1)
    ok = states[k] == state
    k, what = k[ok], what[ok]
    many = bounds[k + 1] - bounds[k]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(what, many), np.repeat(bounds[k], many) + nth, nth


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _words(raw: bytes, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words of some texts, and each text's first."""
    words: list[bytes] = []
    ends = []
    for i in range(len(off) - 1):
        words += raw[off[i] : off[i + 1]].translate(NORMAL).split()
        ends.append(len(words))
    return words, np.concatenate(([0], np.array(ends, np.int64)))


def _texts_hits(raw: bytes, off: np.ndarray, auto: Automaton) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Word counts of some texts, and the hits of those that have any: spans (end exclusive, merged) and items."""
    words, first = _words(raw, off)
    ids = np.fromiter(map(auto.vocabulary.get, words, repeat(-1)), np.int32, len(words))
    # a word that no item has, or a text's end, leads back to the root: only runs of known words are streamed
    known = ids >= 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
    end = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = end - begin >= auto.least
    at, size, where, item = auto.hits(ids, begin[long], end[long])
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    if len(at):
        inside = np.zeros(len(ids) + 1, np.int64)
        np.add.at(inside, at - size + 1, 1)
        np.add.at(inside, at + 1, -1)
        hit = np.cumsum(inside[:-1]) > 0
        # a text's first word begins a span of its own
        a = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
        b = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) + 1
        for d, x, y in zip((np.searchsorted(first, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
            out.setdefault(d, ([], set()))[0].append((x - int(first[d]), y - int(first[d])))
        have = np.unique(np.stack([np.searchsorted(first, where, "right") - 1, item], axis=1), axis=0)
        for d, i in have.tolist():
            out[d][1].add(auto.names[i])
    return np.diff(first), out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _columns(spans: list[list[tuple[int, int]]], names: list[list[str]]) -> list[pa.Array]:
    return [pa.array([[{"first": p, "last": q} for p, q in s] for s in spans], _SPANS), pa.array(names, pa.list_(pa.string()))]


def _mapper(auto: Automaton, text_col: str):
    """Adds n_words, hit_spans and hit_items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(text_col))
            for i, j in slices(off):
                n, hits = _texts_hits(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i], auto)
                part = b.slice(i, j - i)
                got = [hits.get(k, ([], ())) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), *_columns([s for s, _ in got], [sorted(x) for _, x in got])], [*part.schema.names, "n_words", "hit_spans", "hit_items"])

    return run


def _finder(auto: Automaton):
    """_text_id, hit_spans, hit_items of the texts with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column("_text"))
            for i, j in slices(off):
                _, hits = _texts_hits(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i], auto)
                if hits:
                    at = sorted(hits)
                    ids = b.column("_text_id").take(pa.array([i + k for k in at]))
                    yield pa.RecordBatch.from_arrays([ids, *_columns([hits[k][0] for k in at], [sorted(hits[k][1]) for k in at])], ["_text_id", "hit_spans", "hit_items"])

    return run


def _joiner(text_col: str):
    """n_words, and the hits of all blocks put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(text_col))
            n = [np.diff(_words(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i])[1]) for i, j in slices(off)]
            spans = [_merged([(y["first"], y["last"]) for y in s or ()]) for s in b.column("_spans").to_pylist()]
            kept = [c for c in b.schema.names if c not in ("_spans", "_items")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(np.concatenate(n) if n else [], pa.int64()), *_columns(spans, [sorted(set(x or ())) for x in b.column("_items").to_pylist()])], [*kept, "n_words", "hit_spans", "hit_items"]
            )

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, in blocks of about ``block_bytes`` of text: (item_id as text, words)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    many = max(1, -(-size // block_bytes))
    for k in range(many):
        part = rows if many == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k)
        yield [(r.i, normalised(r.t.encode())) for r in part.toLocalIterator()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of first, last: word numbers, end exclusive, merged and sorted) and hit_items (sorted item ids).

    A null or empty text has no words and no hits; a null or empty item has no
    window; a null item_id is the empty id; rows of equal item_id are one item.
    Columns of ``docs`` that are named like the new ones are replaced, and columns
    named _text_id, _spans and _items are dropped. Repeated rows get equal results, an empty table of either kind none or no hits.

    Each block's automaton is made once, by the driver, and sent to the tasks (its
    size follows ``block_bytes``). Of several blocks each reads the texts in a pass
    of its own, so a worker holds one; only hits, once a text, are written and joined.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.drop("n_words", "hit_spans", "hit_items", "_text_id", "_spans", "_items")
    new = "hit_spans array<struct<first:bigint,last:bigint>>, hit_items array<string>"
    schema = StructType([*out.schema.fields, *StructType.fromDDL(f"n_words bigint, {new}").fields])
    text_id = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    parts, auto = [], None
    for items in blocks(benchmark, block_bytes):
        if auto is not None:
            parts.append(_block_hits(out, text_col, text_id, auto, new, len(parts)))
        auto = Automaton(items)
    if not parts:
        return out.mapInArrow(tidy(_mapper(auto, text_col)), schema)
    parts.append(_block_hits(out, text_col, text_id, auto, new, len(parts)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("_text_id").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.flatten(F.collect_list("hit_items")).alias("_items"))
    joined = out.select("*", text_id.alias("_text_id")).join(found, "_text_id", "left").drop("_text_id")
    return joined.mapInArrow(tidy(_joiner(text_col)), schema)


def _block_hits(docs: DataFrame, text_col: str, text_id: Column, auto: Automaton, new: str, k: int) -> DataFrame:
    rows = docs.select(text_id.alias("_text_id"), F.col(text_col).alias("_text"))
    return materialise(rows.mapInArrow(tidy(_finder(auto)), f"_text_id string, {new}").dropDuplicates(["_text_id"]), f"block{k}")


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])


def contaminated() -> Column:
    return (n_hit() > 0) & (n_hit() * COVERAGE >= F.col("n_words"))


def _cutter(text_col: str):
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def cut(text: str, spans: list[dict]) -> str:
        raw = text.encode()
        at = [m.span() for m in word.finditer(raw)]
        out, done = [], 0
        for s in spans:
            out.append(raw[done : at[s["first"]][0]])
            done = at[s["last"] - 1][1]
        out.append(raw[done:])
        return b"".join(out).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("hit_spans").to_pylist()
            texts = b.column(text_col)
            if any(spans):
                texts = pa.array([cut(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)], texts.type)
            yield b.set_column(b.schema.get_field_index(text_col), text_col, texts)

    return run


def cut_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``find_overlaps`` without the text of their hit spans; what stands between the spans stays as it is."""
    return found.mapInArrow(tidy(_cutter(text_col)), found.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that are contaminated; the others as they are, all their columns too."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return find_overlaps(rows, benchmark, "_text").where(~contaminated()).select("_row.*")


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, list[str]]:
    """n_words, n_hit and item ids of one text, by the rule itself."""
    words = normalised((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        w = normalised((item or "").encode())
        size = min(WINDOW, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    names.add(name)
    return len(words), len(hit), sorted(names)


_CLASS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(w[p:p + least({WINDOW}, len(w)) - 1], ' ') AS s
 FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw), ws AS (SELECT DISTINCT k, s FROM iw),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
dp AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dp.k, p, s FROM dp SEMI JOIN ws USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h JOIN iw USING (k, s)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
