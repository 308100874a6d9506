"""Text windows that an arbiter is asked about, and places within them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a window and windows of a document.
SIZE, MOST = 900, 6
_SENTENCE = re.compile(r"[.;!?]\s")
_CUE = re.compile(r"\b(?:recurso|processo|s[úu]mula|art(?:igo|\.)|tema|ac[óo]rd[ãa]o|julgad|precedente|relator|STF|STJ|TST|TSE|STM)", re.I)


def blocks(text: str, start: int = 0, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """Paragraphs from ``start`` on, cut to ``size``: at the last sentence's end if there is one, else where the size ends."""
    for m in re.finditer(r"[^\n](?:[^\n]|\n(?!\s*\n))*", text[start:]):
        a, end = start + m.start(), start + m.end()
        while end - a > size:
            cuts = [x.end() for x in _SENTENCE.finditer(text, a, a + size)]
            b = cuts[-1] if cuts and cuts[-1] > a else a + size
            yield a, b
            a = b
        if text[a:end].strip():
            yield a, end


def with_cues(text: str, start: int = 0) -> list[tuple[int, int, int]]:
    """(first, last, cues) of the blocks with a digit and a cue."""
    out = [(a, b, len(_CUE.findall(text, a, b))) for a, b in blocks(text, start)]
    return [x for x in out if x[2] and any(c.isdigit() for c in text[x[0] : x[1]])]


def windows(docs: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, first, last, cues: a document's ``most`` windows with the most cues, earlier ones first among equals, in order of place.

    Windows that a found span (id, first, last) lies in are no candidates. None are kept for ``most`` 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *w) for k, t in enumerate(b.column(text_col).to_pylist()) for w in with_cues(t or "")]
            if rows:
                at, first, last, cues = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(cues, pa.int32())], [id_col, "first", "last", "cues"])

    w = docs.select(id_col, text_col).mapInArrow(run, StructType.fromDDL(f"{id_col} {kind}, first int, last int, cues int"))
    if found is not None:
        f = found.select(id_col, F.col("first").alias("_a"), F.col("last").alias("_b"))
        inside = (w["first"] < f["_b"]) & (f["_a"] < w["last"]) & (w[id_col] == f[id_col])
        w = w.join(f, inside, "left_anti")
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("cues"), "first"))
    return w.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def nearest(window: str, wanted: str, near: int = 0) -> tuple[int, int] | None:
    """The place of a piece nearest to ``near``; if it isn't there literally, over any blanks; else None."""
    for pattern in (re.escape(wanted), r"\s+".join(map(re.escape, wanted.split()))):
        if pattern and (places := [m.span() for m in re.finditer(pattern, window)]):
            return min(places, key=lambda s: (abs(s[0] - near), s))
    return None


def trimmed(window: str, first: int, last: int) -> tuple[int, int]:
    """A span without a leading article and trailing punctuation and blanks."""
    if m := re.compile(r"\s*(?:(?:[oOaA]s?|[dn][oa]s?|pel[oa]s?)\s+)?").match(window, first, last):
        first = m.end()
    while last > first and (window[last - 1].isspace() or window[last - 1] in ",.;:-–"):
        last -= 1
    return first, last
