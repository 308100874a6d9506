"""Spans within a document: greedy choices, checks, alignment.

Groups are a document's own spans. What is chosen depends on what was chosen
before, so the choices run over a document's sorted array in Arrow batches; each
span looks only at accepted neighbours by place (bisection), not at all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from quillspan.functions.text import iou

#: Spans that overlap at least so much are the same finding.
SAME = 0.5
INSIDE = 0.9


def _chosen(rows: DataFrame, id_col: str, order: list[Column], keep: list[str], choose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """id and ``keep`` of what ``choose`` picks of each document's rows, which it gets in ``order``."""
    lean = rows.select(id_col, *keep).schema
    item = StructType([f for f in lean.fields if f.name in keep])
    g = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*keep).alias("_x")))).alias("_all"))
    g = g.select(id_col, F.transform("_all", lambda x: x["_x"]).alias("_all"))
    kind = pa.list_(to_arrow_type(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [choose(x) for x in b.column("_all").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(kept, kind)], [id_col, "_all"])

    out = g.mapInArrow(run, StructType([lean[id_col], StructType().add("_all", ArrayType(item)).fields[0]]))
    return out.select(id_col, F.inline("_all"))


def apart(rows: list[dict]) -> list[dict]:
    """Rows that meet no better one: accepted spans are apart, so the one before a span's end decides."""
    kept: list[tuple[int, int, int]] = []
    out = []
    for n, x in enumerate(rows):
        i = bisect_left(kept, (x["last"],))
        if i == 0 or kept[i - 1][1] <= x["first"]:
            insort(kept, (x["first"], x["last"], n))
            out.append(x)
    return out


def unlike(same: float) -> Callable[[list[dict]], list[dict]]:
    """Rows without a better one of an IoU of at least ``same``: such a one is of a similar length, and accepted spans of one length are few at a place."""

    def choose(rows: list[dict]) -> list[dict]:
        kept: dict[int, list[tuple[int, int]]] = {}
        reach = 1
        while 2**reach < 1 / same:
            reach += 1
        out = []
        for x in rows:
            a, z = x["first"], x["last"]
            size = (z - a).bit_length()
            if not any(alike(a, z, y, same) for k in range(size - reach - 1, size + reach + 2) for y in _around(kept.get(k, []), a - 2**k if k > 0 else a, z)):
                insort(kept.setdefault(size, []), (a, z))
                out.append(x)
        return out

    return choose


def _around(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    return spans[bisect_left(spans, (low,)) : bisect_left(spans, (high,))]


def alike(a: int, z: int, other: tuple[int, int], same: float) -> bool:
    both = min(z, other[1]) - max(a, other[0])
    return both > 0 and both / (z - a + other[1] - other[0] - both) >= same


def one_to_one(rows: list[dict]) -> list[dict]:
    """Pairs (g, p) of which neither was taken before."""
    g, p, out = set(), set(), []
    for x in rows:
        if x["g"] not in g and x["p"] not in p:
            g.add(x["g"])
            p.add(x["p"])
            out.append(x)
    return out


def fuse(spans: DataFrame, families: list[str], id_col: str = "doc_id") -> DataFrame:
    """Spans (first, last, family, strength) that meet no better one: by strength, then length, family order, place."""
    rank = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    order = [-F.col("strength"), F.col("first") - F.col("last"), rank, F.col("first"), F.col("last")]
    return _chosen(spans, id_col, order, ["first", "last", "family", "strength"], apart)


def suppress(spans: DataFrame, families: list[str], id_col: str = "doc_id", same: float = SAME) -> DataFrame:
    """As ``fuse``, but only spans with an IoU of at least ``same`` are in conflict; status tells the losers, which stay in the trace."""
    rank = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    order = [-F.col("strength"), F.col("first") - F.col("last"), rank, F.col("first"), F.col("last")]
    names = ["first", "last", "family", "strength"]
    kept = _chosen(spans, id_col, order, names, unlike(same)).distinct().withColumn("status", F.lit("emitida"))
    marked = spans.distinct().join(kept, [id_col, *names], "left")
    return marked.withColumn("status", F.coalesce("status", F.lit("descartada:sobreposicao")))


def overlapping(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans that begin before an earlier one has ended; none if they are apart."""
    before = Window.partitionBy(id_col).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("last").over(before)).where("reach > first")


def renumber(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """With citation_id c1, c2 ... by place within the document."""
    w = Window.partitionBy(id_col).orderBy("first", "last")
    return spans.withColumn("citation_id", F.concat(F.lit("c"), F.row_number().over(w).cast("string")))


def first_spans(spans: DataFrame, most: int = 5000, id_col: str = "doc_id") -> DataFrame:
    """The first ``most`` spans of a document by place: the cap is the feature."""
    w = Window.partitionBy(id_col).orderBy("first", "last")
    return spans.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def gaps(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """With gap: characters to the next span of the document, null at the last."""
    w = Window.partitionBy(id_col).orderBy("first", "last")
    return spans.withColumn("gap", F.lead("first").over(w) - F.col("last"))


def pairs(gold: DataFrame, pred: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Gold (g, first, last) and predicted (p, first, last) spans of a document that meet, with overlap; the id is the equi-key."""
    a = gold.select(id_col, F.col("g"), F.col("first").alias("g1"), F.col("last").alias("g2"))
    b = pred.select(id_col, F.col("p"), F.col("first").alias("p1"), F.col("last").alias("p2"))
    j = a.join(b, id_col).where("g1 < p2 AND p1 < g2")
    return j.withColumn("overlap", iou(F.col("g1"), F.col("g2"), F.col("p1"), F.col("p2")))


def align(gold: DataFrame, pred: DataFrame, id_col: str = "doc_id", least: float = SAME) -> DataFrame:
    """id, g, p, overlap: one to one, the best overlap first, ties by gold number, then predicted number."""
    near = pairs(gold, pred, id_col).where(F.col("overlap") >= least)
    return _chosen(near, id_col, [-F.col("overlap"), F.col("g"), F.col("p")], ["g", "p", "overlap"], one_to_one)


def extras(gold: DataFrame, pred: DataFrame, matched: DataFrame, id_col: str = "doc_id", inside: float = INSIDE) -> DataFrame:
    """Predictions without a partner that lie to ``inside`` within a gold span that has one: they don't count as wrong."""
    with_partner = gold.join(matched.select(id_col, "g"), [id_col, "g"], "left_semi")
    alone = pred.join(matched.select(id_col, "p"), [id_col, "p"], "left_anti")
    part = (F.least("g2", "p2") - F.greatest("g1", "p1")).cast("double") / (F.col("p2") - F.col("p1"))
    return pairs(with_partner, alone, id_col).where(part >= inside).select(id_col, "p").distinct()
