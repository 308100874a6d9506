"""The whole verification: texts in, contract documents and a trace out. Components can be exchanged."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import calibration, contract, detect, distractors, resolve, spans

Step = Callable[..., DataFrame]


class Result(NamedTuple):
    outputs: DataFrame  # doc_id, json
    trace: DataFrame  # contract.TRACE
    citations: DataFrame


def verify(docs: DataFrame, identifiers: DataFrame, sumulas: DataFrame, statutes: DataFrame, table: DataFrame, initial: DataFrame | None = None, detector: Step = detect.detect, resolver: Step = resolve.resolve, calibrator: Step = calibration.confidence) -> Result:
    """Verify the citations of ``docs`` (doc_id, text).

    Findings in a document's header are put aside; so are overlapping ones, those
    that what stands around them shows to be something else (an act's number, a
    sum, a date ...) and wide ones that the base doesn't confirm. They stay in the trace with their
    status. Every document has an output, with an empty list if it must.
    """
    found = detector(docs.select("doc_id", "text"))
    found = distractors.reasons(found, docs).withColumnRenamed("reason", "_reason")
    own = found.withColumns({"cls": F.when(F.col("family") == "processo", F.col("fields")["cls"]), "uf": F.col("fields")["uf"]})
    found = distractors.strict_reasons(own, docs).withColumn("_reason", F.coalesce("_reason", "reason")).drop("cls", "uf", "reason")
    decided = resolver(found, identifiers, sumulas, statutes)
    aside = F.when(F.col("_reason") == "cabecalho", "descartada:cabecalho").otherwise(F.concat(F.lit("descartada:distrator:"), "_reason"))
    decided = decided.withColumn("status", F.when(F.col("_reason").isNotNull(), aside).otherwise(F.col("status"))).drop("_reason")
    scored = calibrator(decided, table, initial)
    best = spans.suppress(scored.where("status = 'emitida'").select("doc_id", "first", "last", "family", "strength"), list(detect.FAMILIES)).withColumnRenamed("status", "_status")
    scored = scored.join(best, ["doc_id", "first", "last", "family", "strength"], "left").withColumn("status", F.coalesce(F.when(F.col("status") == "emitida", F.col("_status")), "status")).drop("_status")
    emitted = spans.renumber(spans.first_spans(scored.where("status = 'emitida'")))
    trace = scored.select(
        F.col("doc_id").cast("string").alias("documento_id"), F.col("first").alias("inicio"), F.col("last").alias("fim"), F.col("family").alias("familia"), F.col("kind").alias("tipo"), F.col("origin").alias("origem"),
        F.col("strength").alias("forca"), F.col("label").alias("classificacao"), F.col("canonical_id").cast("string").alias("id_canonico"), F.col("path").alias("caminho"),
        F.array_compact(F.array(F.col("canonical_id").cast("string"))).alias("candidatos"), F.col("confidence").alias("confianca"), "status", F.lit(None).cast("string").alias("erro"),
    )
    return Result(contract.outputs(emitted, docs), trace, emitted)
