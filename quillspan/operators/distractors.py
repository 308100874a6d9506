"""Findings that are no citations: outside the text, in the header, or numbers of something else.

Rules on what stands around a span read at most ``NEAR`` characters on each side of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import header_end, match_spans

NEAR = 40
#: Reasons to put a wide finding aside, by what stands right before it, right after it, or in it; on lower-case text.
BEFORE = {
    "folha": r"\b(?:fls?|folhas?|p[áa]gs?|p[áa]ginas?)\.?\s*$", "valor": r"(?:r\$|us\$|€)\s*$", "registro_oab": r"\boab\s*(?:[/-]?\s*[a-z]{2})?\s*(?:n[.º°o]*\s*)?$",
    "protocolo": r"\bprotocolos?\s*(?:n[.º°o]*\s*)?$", "referencia": r"\b(?:ref|refer[êe]ncia|id|evento|doc|documento)\.?\s*(?:n[.º°o]*\s*)?$", "banco": r"\b(?:ag[êe]ncia|conta(?: corrente)?|c/c|banco)\s*(?:n[.º°o]*\s*)?$",
}
AFTER = {"percentual": r"^\s?(?:%|por cento)", "data": r"^\s?(?:/\d{1,2})?/(?:19|20)\d\d\b|^\s+de\s+(?:janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"}
#: Acts that a court issues under a number; after them a short acronym and a number name the act.
ACTS = r"\b(?:portaria|resolu[çc][ãa]o|of[íi]cio|edital|provimento|instru[çc][ãa]o normativa|ato|mandado|termo|contrato|nota)s?\s*(?:n[.º°o]*\s*)?$"
#: What a proposal of a family must not say, from an arbiter.
DENIED = {"sumula": r"(?:artigo|art\.|\bfls?\.|r\$)", "tema": r"(?:artigo|art\.|s[úu]mula|\baula\b)", "processo": r"(?:\bfls?\.|r\$|\boab\b|protocolo)", "dispositivo": r"(?:s[úu]mula|\bfls?\.|r\$)", "vaga": r"(?:\boab\b|r\$)"}


def _context(spans: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    before = F.substr("_t", F.greatest(F.lit(1), F.col("first") - NEAR + 1), F.least(F.lit(NEAR), F.col("first")))
    return spans.join(t, id_col).withColumns({"_before": F.lower(before), "_after": F.lower(F.substr("_t", F.col("last") + 1, F.lit(NEAR))), "_in": F.substr("_t", F.col("first") + 1, F.col("last") - F.col("first"))}).drop("_t")


def valid(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that lie in their text, not empty, with the piece that stands there; those of unknown documents go."""
    t = docs.select(id_col, F.col(text_col).alias("_t"))
    inside = (F.col("first") >= 0) & (F.col("last") > F.col("first")) & (F.col("last") <= F.length("_t"))
    return spans.join(t, id_col).where(inside).withColumn("piece", F.substr("_t", F.col("first") + 1, F.col("last") - F.col("first"))).drop("_t")


def header_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digits: the different numbers of four digits or more, without their separators, in a document's header."""
    head = header_end(docs, id_col, text_col).select(id_col, "header_end")
    t = docs.select(id_col, F.col(text_col).alias("_t")).join(head, id_col)
    found = t.select(id_col, F.explode(match_spans(F.substr("_t", F.lit(1), F.col("header_end").cast("int")), r"[0-9][0-9.\-/]*[0-9]")).alias("s"))
    return found.select(id_col, F.regexp_replace("s.piece", "[^0-9]", "").alias("digits")).where("length(digits) >= 4").distinct()


def reasons(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spans`` (first, last, origin ...) with reason: why one is no citation, null where it is.

    All in the header go; of wide ones also those whose number the header has and
    those whose neighbourhood says that the number is something else.
    """
    head = header_end(docs, id_col, text_col).select(id_col, "header_end")
    x = _context(spans, docs, id_col, text_col).join(head, id_col).withColumn("digits", F.regexp_replace("_in", "[^0-9]", ""))
    x = x.join(header_numbers(docs, id_col, text_col).withColumn("_own", F.lit(True)), [id_col, "digits"], "left")
    rule = F.when(F.col("first") < F.col("header_end"), "cabecalho")
    wide = F.endswith("origin", F.lit(":amplo"))
    rule = rule.when(wide & F.col("_own"), "numero_do_cabecalho")
    for name, pattern in BEFORE.items():
        rule = rule.when(wide & F.col("_before").rlike(pattern), name)
    for name, pattern in AFTER.items():
        rule = rule.when(wide & F.col("_after").rlike(pattern), name)
    return x.withColumn("reason", rule).select(*spans.columns, "reason")


def strict_reasons(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Process findings (cls, key, uf ...) with reason: a bare acronym of two or three letters that the text around shows to be no class."""
    x = _context(spans, docs, id_col, text_col)
    short = (F.length("cls") <= 3) & F.col("_in").rlike(r"^[A-Z]{2,3}\s") & (F.coalesce("uf", F.lit("")) == "")
    digits = F.length(F.regexp_replace("_in", "[^0-9]", ""))
    rule = (
        F.when(short & F.col("_before").rlike(ACTS), "ato_administrativo")
        .when(short & F.col("_after").rlike(r"^\s?/\s?(?:19|20)\d\d\b"), "numero_com_ano")
        .when(short & (digits <= 3) & F.col("_after").rlike(r"^,?\s+de\s+(?:19|20)\d\d\b"), "numero_de_ano")
        .when(short & F.col("_before").rlike(BEFORE["banco"]), "contexto_bancario")
    )
    return x.withColumn("reason", rule).select(*spans.columns, "reason")


def denied(piece: Column, family: Column) -> Column:
    """Whether an arbiter's proposal names what its family never is."""
    out = F.lit(False)
    for name, pattern in DENIED.items():
        out = F.when(family == name, F.lower(piece).rlike(pattern)).otherwise(out)
    return out
