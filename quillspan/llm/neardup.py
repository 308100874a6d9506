"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of ``SHINGLE``-word shingles. Equal texts are one node. Bands of
MinHash values propose which nodes may be similar; within what the bands connect,
MinHash values are compared a few at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches ``THRESHOLD`` falls below
``TOLERANCE``; what is left is verified on the shingles themselves.

Scale: a task first groups what it has itself, so a text that a third of all
documents share leaves each task once; a group of many different texts is cut into
blocks, and each pair of blocks is a task's work. Pairs are counted and joined into
components where they are found; none are written out one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import binary_array, bounded_batches, gram_hashes, materialise, mix64, run_tables, slices, table, text_buffers, tidy, word_bounds, word_hashes
from quillspan.llm.components import components

SHINGLE = 5
#: Similarity 4/5, as integers.
ABOVE, OF = 4, 5
THRESHOLD = ABOVE / OF
HASHES, ROWS = 240, 6
BANDS = HASHES // ROWS
#: MinHash values compared at a time.
STEP = 16
TOLERANCE = 1e-9
#: Texts and bytes of a block.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Rows (under 50 bytes each) that are sent to every task; more are joined.
SENT = 250_000

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_C = mix64(np.arange(1, 7, dtype=np.uint64))


def _needed() -> dict[int, int]:
    """Matches out of n below which P(J >= THRESHOLD | matches) < TOLERANCE, under a uniform prior.

    The posterior is a Beta distribution; for whole numbers its upper tail is a
    lower binomial tail.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
            m += 1
        out[n] = m
    return out


NEEDED = _needed()


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes text by text, repeats included, and offsets. A text of fewer words than a shingle is one shingle."""
    starts, ends, first = word_bounds(data, off)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(words, SHINGLE)
    at = np.flatnonzero(owner[: len(grams)] == owner[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    h, own = [grams[at]], [owner[at]]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(n == k)
        if len(few):
            h.append(mix64(gram_hashes(words, k)[first[:-1][few]] + _C[k]))
            own.append(few)
    h, own = np.concatenate(h), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return h[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(n)))))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values, a row each for texts that all have shingles."""
    out = np.empty((len(off) - 1, HASHES), np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i, j in slices(off, 1 << 15):
        part, at = x[off[i] : off[j]], off[i:j] - off[i]
        for k in range(HASHES):
            v = part * _A[k]
            v ^= v >> np.uint32(15)
            v *= _B[k]
            out[i:j, k] = np.minimum.reduceat(v, at)
    return out


def _distinct_rows(raw: bytes, off: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The different texts' digests and a row that has each."""
    seen: dict[bytes, int] = {}
    for k in range(len(off) - 1):
        seen.setdefault(hashlib.md5(raw[off[k] : off[k + 1]], usedforsecurity=False).digest(), k)
    return list(seen), list(seen.values())


def _sub(data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(off)[rows]
    new = np.concatenate(([0], np.cumsum(n)))
    return data[np.repeat(off[rows] - new[:-1], n) + np.arange(new[-1])], new


_BUCKETS = "key bigint, u binary, v binary"


def _nodes(raw: bytes) -> pa.Array:
    return binary_array(raw, np.arange(0, len(raw) + 1, 16))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of the different texts: (key, node) where a slice has the key first, (node, node) where it has it again."""
    for b in batches:
        data, off = text_buffers(b.column("text"))
        for i, j in slices(off, 2 << 20):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            nodes, rows = _distinct_rows(part.tobytes(), at)
            part, at = _sub(part, at, np.array(rows))
            h, hoff = shingles(part, at)
            some = np.flatnonzero(np.diff(hoff))
            if not len(some):
                continue
            name = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 16)[some]
            s = signatures(h, np.append(hoff[some], hoff[-1])).astype(np.uint64).reshape(len(some), BANDS, ROWS)
            key = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                key += s[:, :, r] * _C[r]
            key = mix64(mix64(key) + np.arange(BANDS, dtype=np.uint64) * _C[4]).ravel()
            uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), _nodes(name[first // BANDS].tobytes()), pa.nulls(len(uniq), pa.binary())], ["key", "u", "v"])
            again = np.flatnonzero(first[back] != np.arange(len(key)))
            if len(again):
                pair = np.unique(np.stack([first[back[again]] // BANDS, again // BANDS], axis=1), axis=0)
                pair = pair[pair[:, 0] != pair[:, 1]]
                spread = mix64(pair[:, 0].astype(np.uint64) * _C[5] + pair[:, 1].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), _nodes(name[pair[:, 0]].tobytes()), _nodes(name[pair[:, 1]].tobytes())], ["key", "u", "v"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by key: each further node of a key to the key's first."""
    for t in run_tables(batches, "key"):
        key = t.column("key").to_numpy()
        u = t.column("u").combine_chunks()
        v = t.column("v").combine_chunks()
        done = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        if len(done):
            yield pa.RecordBatch.from_arrays([u.take(pa.array(done)), v.take(pa.array(done))], ["u", "v"])
        r = np.flatnonzero(v.is_null().to_numpy(zero_copy_only=False))
        if len(r):
            k = key[r]
            head = np.append(True, k[1:] != k[:-1])
            first = r[np.flatnonzero(head)[np.cumsum(head) - 1]]
            raw = np.frombuffer(u.take(pa.array(r)).buffers()[2], np.uint8)[: 16 * len(r)].reshape(-1, 16)
            a, b = raw[np.searchsorted(r, first)[~head]], raw[~head]
            differ = (a != b).any(axis=1)
            if differ.any():
                ab = np.unique(np.concatenate([a[differ], b[differ]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([_nodes(ab[:, :16].tobytes()), _nodes(ab[:, 16:].tobytes())], ["u", "v"])


class _Group:
    """The texts of a block or of two: compares, verifies, counts and joins."""

    def __init__(self, ids: list[np.ndarray], signature: np.ndarray, weight: np.ndarray):
        self.signature, self.weight = signature, weight
        self.size = np.array([len(x) for x in ids])
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        flat = np.concatenate(ids)
        words, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(words), bool)
        self.links = np.zeros(len(ids), np.int64)
        self.parent = list(range(len(ids)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def compare(self, a: int, others: np.ndarray) -> None:
        """Link ``a`` with those of ``others`` that are similar enough."""
        n = self.size[others]
        alive = others[(OF * np.minimum(n, self.size[a]) >= ABOVE * np.maximum(n, self.size[a]))]
        same = np.zeros(len(alive), np.int64)
        for k in range(0, HASHES, STEP):
            if not len(alive):
                return
            same += (self.signature[alive, k : k + STEP] == self.signature[a, k : k + STEP]).sum(axis=1)
            likely = same >= NEEDED[k + STEP]
            alive, same = alive[likely], same[likely]
        if not len(alive):
            return
        mine = self.flat[self.off[a] : self.off[a + 1]]
        self.mark[mine] = True
        n = self.size[alive]
        at = np.cumsum(n) - n
        shared = np.add.reduceat(self.mark[self.flat[np.repeat(self.off[alive] - at, n) + np.arange(n.sum())]], at, dtype=np.int64)
        self.mark[mine] = False
        linked = alive[OF * shared >= ABOVE * (n + self.size[a] - shared)]
        self.links[a] += self.weight[linked].sum()
        self.links[linked] += self.weight[a]
        for x in linked.tolist():
            self.parent[self.find(x)] = self.find(a)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, links, head from rows sorted by their group; a group is a whole component or a block (side 2), or two blocks (0 and 1; one may be empty)."""
    for t in run_tables(batches, "key"):
        key, side, weight = (t.column(c).to_numpy() for c in ("key", "side", "weight"))
        data, off = text_buffers(t.column("text"))
        node = t.column("node").combine_chunks()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key))
        for g, h in slices(np.append(off[first], off[-1]), 4 << 20):
            i, j = int(first[g]), int(last[h - 1])
            grams, goff = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            mins = signatures(grams, goff)
            sets = [np.unique(grams[goff[k] : goff[k + 1]]) for k in range(j - i)]
            heads, links = np.empty(j - i, np.int64), np.empty(j - i, np.int64)
            for a, b in zip(first[g:h] - i, last[g:h] - i, strict=True):
                group = _Group(sets[a:b], mins[a:b], weight[i + a : i + b])
                s = side[i + a : i + b]
                left, right, own = (np.flatnonzero(s == x) for x in (0, 1, 2))
                for x in left.tolist() if len(right) else ():
                    group.compare(x, right)
                for n, x in enumerate(own.tolist()):
                    group.compare(x, own[n + 1 :])
                heads[a:b] = [group.find(x) + a for x in range(b - a)]
                links[a:b] = group.links
            yield pa.RecordBatch.from_arrays([node.slice(i, j - i), pa.array(links), node.slice(i, j - i).take(pa.array(heads))], ["node", "links", "head"])


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _sent(df: DataFrame, bound: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows; ``df`` is a written table."""
    return F.broadcast(df) if df.count() <= bound else df


def jaccard_links(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of ``docs``.

    n_links counts the other documents whose shingle sets have a similarity of at
    least ``THRESHOLD``, equal texts included; class_id is the smallest doc_id
    among those that links connect (null ids don't count where there are others).
    Texts without a word (null and empty ones too) have no links and are their own
    class. Rows that share a doc_id count each. A pair at the threshold is proposed
    with probability 1 - 5e-6 (1 - 6e-9 at 0.85), one of similarity 0.3 with 0.03, of
    0.2 with 0.003; the pruning drops a pair at the threshold with less than 1e-8.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    proposed = docs.select("text").mapInArrow(tidy(_propose), _BUCKETS).repartition("key").sortWithinPartitions("key", "u")
    edges = materialise(proposed.mapInArrow(tidy(_connect), "u binary, v binary"), "proposed")
    near = components(edges)

    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    members = materialise(docs.select("doc_id", F.when(worded, _digest()).alias("node"), F.octet_length("text").alias("bytes")), "members")
    texts = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first("bytes").alias("bytes"))
    texts = materialise(texts, "texts")
    asked = materialise(near.join(texts, "node").select("node", "root", "first_id", "weight", "bytes"), "asked")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    # only large components are cut, and their sizes are a written table: a join with it can be split at a large one
    cut = materialise(asked.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1"), "blocks")
    asked = asked.join(_sent(cut, sent), "root", "left").select("node", "root", "first_id", "weight", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    asked = materialise(asked, "asked")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = docs.where(worded).select(F.col("doc_id").alias("first_id"), _digest().alias("node"), "text")
    # a first_id that is null or stands for several rows of one text must still give one row: one for each digest is kept
    rows = rows.withColumn("first_id", F.coalesce("first_id", F.lit(-(2**63)))).join(_sent(asked.withColumn("first_id", F.coalesce("first_id", F.lit(-(2**63)))), sent), ["first_id", "node"]).dropDuplicates(["node"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("mine", mine)
    pair = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select(pair.alias("key"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "node", "weight", "text")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(_verify), "node binary, links bigint, head binary")
    found = materialise(found, "links")

    roots = components(found.select(F.col("node").alias("u"), F.col("head").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = texts.join(links, "node", "left").join(roots, "node", "left").where("weight > 1 OR root IS NOT NULL")
    info = info.select("node", "first_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    info = materialise(info, "linked")
    first = materialise(info.groupBy("root").agg(F.min("first_id").alias("class_id")), "first")
    info = materialise(info.join(_sent(first, sent), "root").select("node", "class_id", "links"), "classes")
    out = members.select("doc_id", "node").join(_sent(info, sent), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id; rows of a null id stay, rows that share the kept id all stay."""
    gone = materialise(jaccard_links(docs, sent).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    return docs.join(_sent(gone, sent), F.col("doc_id") == F.col("_gone"), "left_anti")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """class_id and n_links by comparing all pairs, for tests on small tables with unique ids."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().split()
        sets[d] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if OF * shared >= ABOVE * (len(sets[a]) + len(sets[b]) - shared):
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (find(d), links[d]) for d in sets}
