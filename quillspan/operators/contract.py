"""The output contract: citation structs, validation, submission cells, traces, comparisons of runs."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.spans import _around, _chosen, alike

VERSION = "1.2"
SOURCE = "base"
#: Overlap from which two citations of a document are one.
SAME = 0.5


def cell(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, citacoes: start,end,label,id,confidence of each citation by place, joined by |; - for documents without any."""
    one = F.concat_ws(",", F.col("first").cast("string"), F.col("last").cast("string"), "label", F.coalesce("canonical_id", F.lit("")), F.format_string("%.4f", F.coalesce("confidence", F.lit(0.5))))
    g = spans.select(id_col, F.struct("first", "last", one.alias("cell")).alias("s")).groupBy(id_col).agg(F.array_sort(F.collect_list("s")).alias("s"))
    g = g.select(id_col, F.array_join(F.transform("s", lambda x: x["cell"]), "|").alias("citacoes"))
    return docs.select(id_col).distinct().join(g, id_col, "left").withColumn("citacoes", F.coalesce("citacoes", F.lit("-")))


def parse_cells(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Citations of submission cells: id, first, last, label, canonical_id, confidence; wrong fields are null."""
    x = cells.where("citacoes <> '-' AND citacoes <> ''").select(id_col, F.explode(F.split("citacoes", r"\|")).alias("c"))
    p = F.split("c", ",")
    return x.select(id_col, F.get(p, F.lit(0)).try_cast("int").alias("first"), F.get(p, F.lit(1)).try_cast("int").alias("last"), F.get(p, F.lit(2)).alias("label"), F.nullif(F.get(p, F.lit(3)), F.lit("")).alias("canonical_id"), F.get(p, F.lit(4)).try_cast("double").alias("confidence"))


def _overlapping(rows: list[dict]) -> list[dict]:
    """Spans with an earlier one that overlaps them by ``SAME``; rows are different and come by place."""
    seen: dict[int, list[tuple[int, int]]] = {}
    out = []
    for x in rows:
        a, z = x["first"], x["last"]
        if z <= a:
            continue
        size = (z - a).bit_length()
        if any(alike(a, z, y, SAME) for k in range(size - 2, size + 3) for y in _around(seen.get(k, []), a - 2**k if k > 0 else a, z)):
            out.append(x)
        insort(seen.setdefault(size, []), (a, z))
    return out


def violations(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spans`` (first, last, piece, kind, label, canonical_id, confidence) with errors: the rules that each breaks.

    The rule on pairs asks each document's spans, by place, for an earlier one of a
    similar length nearby; of equal spans all but one break it.
    """
    t = docs.select(id_col, F.col(text_col).alias("_t"))
    s = spans.join(t, id_col, "left")
    size = F.length("_t")
    in_text = (F.col("first") >= 0) & (F.col("first") < F.col("last")) & (F.col("last") <= size)
    say = lambda bad, what: F.when(bad, F.lit(what))
    rules = [
        say(F.col("_t").isNull(), "documento desconhecido"),
        say(F.coalesce(~in_text, F.lit(False)), "span fora do texto"),
        say(F.coalesce(in_text & (F.substr("_t", F.col("first") + 1, F.col("last") - F.col("first")) != F.col("piece")), F.lit(False)), "trecho diferente"),
        say(~F.coalesce(F.col("label").isin("real", "inventada", "incompleta"), F.lit(False)), "classificacao invalida"),
        say((F.coalesce(F.col("label"), F.lit("")) == "real") != F.col("canonical_id").isNotNull(), "resolucao incoerente"),
        say(F.col("confidence").isNotNull() & (F.isnan("confidence") | ~F.col("confidence").between(0, 1)), "confianca fora de [0,1]"),
        say(F.col("_same") > 0, "sobreposicao"),
    ]
    again = Window.partitionBy(id_col, "first", "last").orderBy("first")
    places = spans.select(id_col, "first", "last").where("first IS NOT NULL AND last IS NOT NULL").distinct()
    near = _chosen(places, id_col, [F.col("first"), F.col("last")], ["first", "last"], _overlapping).withColumn("_near", F.lit(1))
    s = s.withColumn("_n", F.when(F.col("last") > F.col("first"), F.row_number().over(again))).join(near, [id_col, "first", "last"], "left")
    s = s.withColumn("_same", F.when((F.col("_n") > 1) | F.col("_near").isNotNull(), 1).otherwise(0)).drop("_n", "_near")
    return s.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull())).drop("_t", "_same")


def citation() -> Column:
    """The contract's struct from citation_id, first, last, piece, kind, label, canonical_id, confidence; resolucao only for real ones."""
    resolved = F.when(F.col("label") == "real", F.struct(F.lit(SOURCE).alias("fonte"), F.col("canonical_id").cast("string").alias("id_canonico")))
    return F.struct(
        F.col("citation_id").alias("id"), F.col("first").alias("inicio"), F.col("last").alias("fim"), F.col("piece").alias("trecho"), F.col("kind").alias("tipo"),
        F.col("label").alias("classificacao"), resolved.alias("resolucao"), F.round("confidence", 4).alias("confianca"),
    )


def outputs(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, json: one contract document for each document, an empty list where it has no citation, so that none is lost."""
    g = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("first", "last", citation().alias("c")))).alias("s"))
    d = docs.select(id_col).distinct().join(g.select(id_col, F.transform("s", lambda x: x["c"]).alias("citacoes")), id_col, "left")
    kind = dict(d.dtypes)["citacoes"]
    whole = F.struct(F.lit(VERSION).alias("schema_version"), F.col(id_col).cast("string").alias("documento_id"), F.coalesce("citacoes", F.array().cast(kind)).alias("citacoes"))
    return d.select(id_col, F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (only_a, only_b, changed) of two runs; equal keys don't come."""
    j = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), key, "full")
    status = F.when(F.col("_ib").isNull(), "only_a").when(F.col("_ia").isNull(), "only_b").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, status.alias("status")).where("status IS NOT NULL")


def submission_errors(cells: DataFrame, expected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, error: duplicate and empty ids, missing ones (fatal) and surplus ones (a warning)."""
    c = F.col(id_col)
    doubled = cells.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("duplicado").alias("error"))
    empty = cells.where(c.isNull() | (F.trim(c.cast("string")) == "")).select(id_col, F.lit("vazio").alias("error"))
    missing = expected.select(id_col).distinct().join(cells, id_col, "left_anti").select(id_col, F.lit("ausente").alias("error"))
    surplus = cells.select(id_col).distinct().join(expected, id_col, "left_anti").select(id_col, F.lit("excedente").alias("error"))
    return doubled.unionAll(empty).unionAll(missing).unionAll(surplus)


# The trace's columns.
TRACE = "documento_id string, inicio int, fim int, familia string, tipo string, origem string, forca double, classificacao string, id_canonico string, caminho string, candidatos array<string>, confianca double, status string, erro string"


def emitted(trace: DataFrame) -> DataFrame:
    """Rows of a trace that calibration may learn from: emitted, with a path, not from the mock extractor."""
    return trace.where("status = 'emitida' AND caminho IS NOT NULL AND NOT startswith(coalesce(origem, ''), 'llm:extrator:mock')")
