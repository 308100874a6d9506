"""Information-theoretic sanitisation of personal data.

Base spans (e-mail addresses, IP addresses, card and telephone numbers) are found
by rule. Then the corpus tells which further terms give a protected value away:
with N documents, n(e) that have the value e, n(t) that have the term t outside
of base spans and n(e, t) that have both,

    PMI(e; t) = log(n(e, t) N / (n(e) (n(t) + 1))),   IC(e) = log(N / n(e)).

The 1 is a document with t and without e that the corpus may have missed: it takes
the place of a least number of documents, so that what is seen once counts as far
as the corpus is large enough. A term that carries at least ``DISCLOSURE`` of some
value's information content is a span of its own wherever it stands, with the
value or without it, and is generalised like the base spans.

Terms are words of letters and digits, and two words next to each other that are
a name or a number (both start with a capital or a digit, one blank between) or
parts of an identifier (joined by one of ``./:_-``, a digit in one of them), in
lower case, letter by letter.

Scale: texts are scanned four times and only counts are shuffled, combined before.
The first scan counts values and marks the terms that stand in a document with one
in a table of 2**26 bits; the second counts those terms over all documents (what
else the table lets through counts for nothing). A disclosing term has
n(t) + 1 <= max n(e)^d N^(1 - d), so the third scan gives pairs of a value and a
term that is so rare alone. The tables have a fixed size; a fuller one lets more
through and changes no result. The fourth scan marks the spans: disclosing terms
are sent while they are few (a checked bound), beyond it they are joined with the
texts that may have one. Terms are known by 64 bits: with 10^7 disclosing terms,
10^9 other terms give 5e-4 false spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.llm.common import bit_place, bits_of, bounded_batches, gathered_bits, in_table, materialise, slices, table, text_buffers, tidy, word_hashes

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.9
#: Disclosing terms (8 bytes each) up to this number go to every task; more are joined.
SENT = 1_000_000
#: Text bytes that one vectorised step handles.
SLICE = 1 << 20
#: Bits of the tables of terms, as a power of two.
BITS = 26

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failed run of digits fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, str, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the characters before an @ decide where one starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str, digits: bool = True) -> list[Span]:
    """(start, kind, end) by start, then kind as listed; code points, end exclusive."""
    out = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    if digits:
        out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            n = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(n) <= 19 and _luhn(n):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9.]', '', value) if kind == 'ip' else re.sub('[^0-9]', '', value)}"


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (itself where that is no single one), and flags: 1 letter or digit, 2 capital or digit, 4 digit."""
    low, flags = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            digit = c.isdigit()
            flags[i] = 1 + 2 * (digit or c.isupper()) + 4 * digit
            lower = c.lower()
            if lower != c and len(lower) == 1:
                low[i] = ord(lower)
    return low, flags


class Part(NamedTuple):
    """Some texts of a batch: base spans by text, and term occurrences outside of them, by place in the texts put together."""

    row: int
    texts: list[str]
    spans: dict[int, list[Span]]
    begin: np.ndarray  # where each text begins
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray
    hash: np.ndarray


def _suspects(code: np.ndarray, flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Texts that may have a base span: an @, a + before a digit, three dots between digits, or 14 ASCII digits."""
    digit = (code >= 48) & (code <= 57)
    after = np.append(digit[1:], False)
    dots = (code == 46) & after & np.append(False, digit[:-1])
    count = lambda x: np.add.reduceat(x, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    return (count((code == 64) | ((code == 43) & after)) > 0) | (count(dots) >= 3) | (count(digit) >= 14)


def _parts(batch: pa.RecordBatch, wanted: str = "all") -> Iterator[Part]:
    """The batch in slices; ``wanted`` is all, or valued: terms of texts with a base span only. Null is empty."""
    low_of, flag_of = _letters()
    data, off = text_buffers(batch.column("text"))
    for i, j in slices(off, SLICE):
        raw = data[off[i] : off[j]].tobytes()
        texts = [raw[off[k] - off[i] : off[k + 1] - off[i]].decode("utf-8", "replace") for k in range(i, j)]
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        flags = flag_of[code]
        spans: dict[int, list[Span]] = {}
        for k in np.flatnonzero(_suspects(code, flags, begin)).tolist():
            if s := base_spans(texts[k]):
                spans[k] = s
        if wanted == "valued":
            inside = np.zeros(len(texts), bool)
            inside[list(spans)] = True
            flags = np.where(np.repeat(inside, size + 1), flags, 0).astype(np.uint8)
        low = low_of[code]
        words, pairs = _occurrences(code, flags)
        first, last = (np.concatenate(x) for x in zip(words, pairs, strict=True))
        hashes = np.concatenate((word_hashes(low, *words), word_hashes(low, *pairs)))
        if spans:
            taken = np.zeros(len(code) + 1, np.int32)
            for k, s in spans.items():
                for a, _, z in s:
                    taken[begin[k] + a + 1 : begin[k] + z + 1] = 1
            taken = np.cumsum(taken)
            free = taken[last] == taken[first]
            first, last, hashes = first[free], last[free], hashes[free]
        order = np.argsort(first, kind="stable")
        first = first[order]
        yield Part(i, texts, spans, begin, low, first, last[order], np.searchsorted(begin, first, "right") - 1, hashes[order])


def _occurrences(code: np.ndarray, flags: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """First and last (exclusive) of all words, and of the names and parts of identifiers, each by place."""
    word = (flags & 1).astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    first, last = edge[::2], edge[1::2]
    close = np.flatnonzero(first[1:] == last[:-1] + 1)
    between = code[last[close]]
    named = (between == 32) & ((flags[first[close]] & flags[first[close + 1]] & 2) > 0)
    digits = np.concatenate(([0], np.cumsum(flags >> 2)))
    joined = np.isin(between, np.frombuffer("./:_-".encode("utf-32-le"), np.uint32)) & (digits[last[close + 1]] > digits[first[close]])
    pair = close[named | joined]
    return (first, last), (first[pair], last[pair + 1])


def _distinct(p: Part) -> np.ndarray:
    """An occurrence of each term of each text."""
    order = np.lexsort((p.hash, p.owner))
    h, d = p.hash[order], p.owner[order]
    return order[np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))] if len(order) else order


def _entities(p: Part) -> dict[int, set[str]]:
    return {k: {_entity(kind, p.texts[k][a:z]) for a, kind, z in s} for k, s in p.spans.items()}


# --- counts -------------------------------------------------------------------


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, n (documents that have it), or word, bits of the terms that stand with one."""
    for b in batches:
        count: Counter[str] = Counter()
        for p in _parts(b, "valued"):
            for e in _entities(p).values():
                count.update(e)
            if len(p.hash):
                word, bit = bit_place(np.unique(p.hash), BITS)
                new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << bit, new)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.string()), pa.nulls(len(new), pa.int64()), pa.array(word[new]), pa.array(bits.view(np.int64))], ["entity", "n", "word", "bits"])
        if count:
            none = pa.nulls(len(count), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()), none, none], ["entity", "n", "word", "bits"])


def _term_counter(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """h, n: documents that have a term of the table."""
        for b in batches:
            for p in _parts(b):
                h = p.hash[_distinct(p)]
                h, n = np.unique(h[in_table(bits, h)], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _pair_counter(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """entity, term, h, n: documents that have both, of terms in the table."""
        for b in batches:
            for p in _parts(b, "valued"):
                at = _distinct(p)
                at = at[in_table(bits, p.hash[at])]
                bounds = np.searchsorted(p.owner[at], np.arange(len(p.texts) + 1))
                count: Counter[tuple[str, str, int]] = Counter()
                for k, entities in _entities(p).items():
                    mine = at[bounds[k] : bounds[k + 1]]
                    terms = [(p.low[a:z].tobytes().decode("utf-32-le", "surrogatepass"), h) for a, z, h in zip(p.first[mine].tolist(), p.last[mine].tolist(), p.hash[mine].view(np.int64).tolist(), strict=True)]
                    for e in entities:
                        count.update((e, *t) for t in terms)
                if count:
                    e, t, h = zip(*count, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(t, pa.string()), pa.array(h, pa.int64()), pa.array(list(count.values()), pa.int64())], ["entity", "term", "h", "n"])

    return run


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term, h, ne, nt, net, pmi, ic: the terms that give a protected value away, from counts over all documents.

    h is the term's 64 bits. No documents, or none with a value, give no rows.
    """
    bounded_batches(docs.sparkSession)
    text = docs.select("text")
    total = docs.count()
    values = materialise(text.mapInArrow(tidy(_values), "entity string, n bigint, word bigint, bits bigint").groupBy("entity", "word").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")), "values")
    own = values.where("entity IS NOT NULL").select("entity", F.col("n").alias("ne"))
    most = own.agg(F.max("ne")).first()[0] or 0
    # n(e, t) <= n(e), so a disclosing term has n(t) + 1 <= n(e)^d N^(1 - d): more frequent ones need no pair
    rare = most**disclosure * max(total, 1) ** (1 - disclosure) * (1 + 1e-9)
    near = gathered_bits(values.where("word IS NOT NULL").select("word", "bits"), BITS)
    seen = text.mapInArrow(tidy(_term_counter(near)), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("nt")).where(F.col("nt") + 1 <= rare)
    seen = materialise(seen, "terms")
    pairs = text.mapInArrow(tidy(_pair_counter(bits_of(seen, "h", BITS))), "entity string, term string, h bigint, n bigint").groupBy("entity", "term", "h").agg(F.sum("n").alias("net"))
    j = pairs.join(seen, "h").join(own, "entity")
    pmi, ic = F.log2(F.col("net") * F.lit(float(total)) / (F.col("ne") * (F.col("nt") + 1))), F.log2(F.lit(float(total)) / F.col("ne"))
    j = j.select("entity", "term", "h", "ne", "nt", "net", pmi.alias("pmi"), ic.alias("ic"))
    return materialise(j.where((F.col("ic") > 0) & (F.col("pmi") >= disclosure * F.col("ic"))), "disclosing")


# --- spans --------------------------------------------------------------------


def _term_spans(p: Part, hit: np.ndarray) -> dict[int, list[Span]]:
    """Occurrences ``hit`` by text; those that overlap are one."""
    out: dict[int, list[Span]] = {}
    for k, a, z in zip(p.owner[hit].tolist(), p.first[hit].tolist(), p.last[hit].tolist(), strict=True):
        own, at = out.setdefault(k, []), int(p.begin[k])
        if own and a - at < own[-1][2]:
            own[-1] = (own[-1][0], TERM, max(z - at, own[-1][2]))
        else:
            own.append((a - at, TERM, z - at))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _replaced(text: str, spans: list[Span]) -> str:
    """Each span as its kind in brackets; of spans that overlap the first."""
    parts, done = [], 0
    for a, kind, z in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, z)
    return "".join(parts) + text[done:]


def _finder(known: np.ndarray | None, replace: bool = False):
    """Adds pii_spans, or with ``replace`` puts the sanitised text in the text's place; ``known``: sorted terms, else column _terms has each text's."""

    def among(p: Part, given: list | None) -> np.ndarray:
        if known is not None:
            if not len(known):
                return np.zeros(0, np.int64)
            at = np.searchsorted(known, p.hash)
            return np.flatnonzero(known[np.minimum(at, len(known) - 1)] == p.hash)
        bounds = np.searchsorted(p.owner, np.arange(len(p.texts) + 1))
        hits = [np.zeros(0, np.int64)]
        for k in range(len(p.texts)):
            if terms := given[p.row + k]:
                hits.append(bounds[k] + np.flatnonzero(np.isin(p.hash[bounds[k] : bounds[k + 1]], np.array(terms, np.int64).view(np.uint64))))
        return np.concatenate(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("_terms").to_pylist() if known is None else None
            rest = b.drop_columns(["_terms"]) if known is None else b
            for p in _parts(b):
                terms = _term_spans(p, among(p, given))
                spans = [sorted(p.spans.get(k, []) + terms.get(k, []), key=lambda s: (s[0], (*KINDS, TERM).index(s[1]))) for k in range(len(p.texts))]
                part = rest.slice(p.row, len(p.texts))
                if replace:
                    new = [_replaced(t, s) if s else t for t, s in zip(p.texts, spans, strict=True)]
                    old = part.column("text")
                    col = pa.array(new, pa.string())
                    yield part.set_column(part.schema.get_field_index("text"), "text", pc.if_else(old.is_null(), None, col) if old.null_count else col)
                else:
                    col = pa.array([[{"kind": kind, "start": a, "end": z} for a, kind, z in s] for s in spans], _SPAN)
                    yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "pii_spans"])

    return run


def _text_id(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _marker(bits: np.ndarray):
    """Adds _text_id, null where the text has no term of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in _parts(b):
                some = set(p.owner[in_table(bits, p.hash)].tolist())
                part = b.slice(p.row, len(p.texts))
                ids = [_text_id(t) if k in some else None for k, t in enumerate(p.texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "_text_id"])

    return run


def _holder(bits: np.ndarray):
    """_text_id, h: the terms of the table that each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in _parts(b):
                at = _distinct(p)
                at = at[in_table(bits, p.hash[at])]
                if len(at):
                    own, back = np.unique(p.owner[at], return_inverse=True)
                    ids = pa.array([_text_id(p.texts[k]) for k in own.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(back)), pa.array(p.hash[at].view(np.int64))], ["_text_id", "h"])

    return run


def find_personal_data(docs: DataFrame, sent: int = SENT, **thresholds: float) -> DataFrame:
    """``docs`` with pii_spans: array of kind, start, end (code points, end exclusive) by start, then kind.

    A null or empty text has none. Spans of different kinds may overlap, except
    that terms stand outside the base spans. Equal texts get equal spans, so ties
    and repeated rows need no rule; an empty table gives an empty one. Columns
    besides text pass through; one named pii_spans is replaced.
    """
    docs = docs.drop("pii_spans", "_terms", "_text_id")
    new = StructType.fromDDL("pii_spans array<struct<kind:string,start:bigint,end:bigint>>").fields
    return _apply(docs, StructType([*docs.schema.fields, *new]), False, sent, **thresholds)


def _apply(docs: DataFrame, schema: StructType, replace: bool, sent: int, **thresholds: float) -> DataFrame:
    found = materialise(disclosing_terms(docs, **thresholds).select("h").distinct(), "disclosing-terms")
    if found.count() <= sent:
        return docs.mapInArrow(tidy(_finder(np.sort(found.toArrow().column("h").to_numpy().view(np.uint64)), replace)), schema)
    bits = bits_of(found, "h", BITS)
    held = docs.select("text").mapInArrow(tidy(_holder(bits)), "_text_id binary, h bigint").distinct()
    terms = held.join(found, "h", "left_semi").groupBy("_text_id").agg(F.collect_list("h").alias("_terms"))
    marked = docs.mapInArrow(tidy(_marker(bits)), StructType([*docs.schema.fields, *StructType.fromDDL("_text_id binary").fields]))
    joined = marked.where("_text_id IS NOT NULL").join(terms, "_text_id", "left").drop("_text_id")
    # without a term a text may still have base spans
    rest = marked.where("_text_id IS NULL").drop("_text_id").withColumn("_terms", F.array().cast("array<bigint>"))
    return joined.unionByName(rest).mapInArrow(tidy(_finder(None, replace)), schema)


def sanitised(docs: DataFrame, sent: int = SENT, **thresholds: float) -> DataFrame:
    """All rows of ``docs`` with each span of ``find_personal_data`` generalised to its kind in brackets.

    Of spans that overlap the first is named. A null text stays null. n_chars,
    where there is one, follows the text; columns named _terms and _text_id are dropped.
    """
    docs = docs.drop("_terms", "_text_id")
    out = _apply(docs, docs.schema, True, sent, **thresholds)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = found.select("doc_id", F.col("pii_spans").alias("s"), F.filter("pii_spans", lambda s: s["kind"] != TERM).alias("b"))
    count = lambda k: F.size(F.filter("b", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(_digest("b"), 256).alias("base_sha256"), _digest("s").alias("spans"))


def brute_force(texts: list[str | None], disclosure: float = DISCLOSURE) -> dict[tuple[str, str], tuple[int, int, int]]:
    """n(e), n(t) and n(e, t) of all disclosing pairs by plain counting over all pairs, for tests."""
    word, pair = r"[^\W_]+", re.compile(r"(?<![^\W_])(?=([^\W_]+)([\x20./:_-])([^\W_]+))")
    low = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    ne, nt, net = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        spans = base_spans(t)
        found = [m.span() for m in re.finditer(word, t)]
        for m in pair.finditer(t):
            a, b = m[1], m[3]
            if all(x[0].isupper() or x[0].isdigit() for x in (a, b)) if m[2] == " " else any(c.isdigit() for c in a + b):
                found.append((m.start(1), m.end(3)))
        terms = {low(t[a:z]) for a, z in found if not any(a < y and x < z for x, _, y in spans)}
        entities = {_entity(kind, t[a:z]) for a, kind, z in spans}
        ne.update(entities)
        nt.update(terms)
        net.update((e, x) for e in entities for x in terms)
    n = len(texts)
    out = {}
    for (e, x), k in net.items():
        ic = np.log2(n / ne[e])
        if ic > 0 and np.log2(k * n / (ne[e] * (nt[x] + 1))) >= disclosure * ic:
            out[e, x] = (ne[e], nt[x], k)
    return out
