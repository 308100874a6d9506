"""Scores of labelled pairs: confusion, F1, the penalty for false owners, groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.shared import materialise

LABELS = ("real", "inventada", "incompleta")


def confusion(pairs: DataFrame, group: str = "level", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """group, gold and a count for each predicted label (n_<label>, n_none) from rows (group, gold, pred); null pred is a miss, null gold an addition."""
    cells = [F.count_if(F.coalesce("pred", F.lit("none")) == p).alias(f"n_{p}") for p in (*labels, "none")]
    return pairs.groupBy(group, F.coalesce("gold", F.lit("none")).alias("gold")).agg(*cells)


def f1(pairs: DataFrame, group: str = "level", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """group, label, tp, fp, fn, f1. A pair counts as right only if ``right`` holds (label and id)."""
    both = pairs.select(group, F.explode(F.array(*map(F.lit, labels))).alias("label"), "gold", "pred", "right")
    g, p = F.coalesce(F.col("gold") == F.col("label"), F.lit(False)), F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    a = both.groupBy(group, "label").agg(F.count_if(g & p & F.col("right")).alias("tp"), F.count_if(p & ~(g & F.col("right"))).alias("fp"), F.count_if(g & ~(p & F.col("right"))).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return a.withColumn("f1", F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)))


def score(pairs: DataFrame, group: str = "level") -> DataFrame:
    """group, macro_f1, tau, brier, score from rows (group, gold, pred, right, confidence).

    macro_f1 is the mean over labels that the gold has; tau the share of made-up
    citations that were called real; the score is macro_f1 (1 - tau / 2) (1 + bonus),
    the bonus a tenth of one less the Brier score, within 0 and 0.1.
    """
    by = f1(pairs, group).groupBy(group).agg(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))).alias("macro_f1"))
    made_up = F.count_if(F.col("gold") == "inventada")
    t = pairs.groupBy(group).agg(
        F.when(made_up > 0, F.count_if((F.col("gold") == "inventada") & (F.col("pred") == "real")) / made_up).otherwise(F.lit(0.0)).alias("tau"),
        F.avg(F.when(F.col("gold").isNotNull() & F.col("pred").isNotNull(), F.pow(F.col("confidence") - F.col("right").cast("int"), 2))).alias("brier"),
    )
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(0.1), 0.1 * (1 - F.coalesce("brier", F.lit(1.0)))))
    s = F.coalesce("macro_f1", F.lit(0.0)) * (1 - 0.5 * F.col("tau")) * (1 + bonus)
    return by.join(t, group).withColumn("score", s)


def weighted(scores: DataFrame) -> DataFrame:
    """One row, final: levels count by their number."""
    return scores.agg((F.sum(F.col("level") * F.col("score")) / F.sum("level")).alias("final"))


def accuracy(rows: DataFrame, groupings: list[str]) -> DataFrame:
    """grouping, value, n, ok, accuracy: each column of ``groupings`` by itself, in one pass (grouping sets)."""
    names = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groupings])
    x = rows.select(F.inline(names), "ok")
    return x.groupBy("grouping", "value").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("ok")).withColumn("accuracy", F.col("ok") / F.col("n"))


def trace_with_gold(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows of a trace that stand exactly on a gold span: documento_id, inicio, fim, caminho, confianca, ok (label, and id where it is real)."""
    on = ["documento_id", "inicio", "fim"]
    g = gold.select(*on, F.col("classificacao").alias("_label"), F.col("ids").alias("_ids"))
    right = (F.col("classificacao") == F.col("_label")) & ((F.col("_label") != "real") | F.array_contains("_ids", F.col("id_canonico")))
    return trace.join(g, on).select(*on, "caminho", "confianca", F.coalesce(right, F.lit(False)).alias("ok"))


def by_path(rows: DataFrame) -> DataFrame:
    """caminho, n, ok, accuracy, brier, confidence (mean) from rows (caminho, confianca, ok)."""
    hit = F.col("ok").cast("int")
    a = rows.groupBy("caminho").agg(F.count("*").alias("n"), F.sum(hit).alias("ok"), F.avg(F.pow(F.col("confianca") - hit, 2)).alias("brier"), F.avg("confianca").alias("confidence"))
    return a.withColumn("accuracy", F.col("ok") / F.col("n"))


def pair_census(pairs: DataFrame, group: str = "level") -> DataFrame:
    """group and counts of pairs by what went wrong: right, wrong_id, wrong_label, missed, surplus, ignored; mean confidence of right and wrong ones.

    ``ignored``, where there is such a column, marks additions that don't count.
    """
    gold, pred, right = F.col("gold"), F.col("pred"), F.col("right")
    both = gold.isNotNull() & pred.isNotNull()
    skip = F.coalesce(F.col("ignored"), F.lit(False)) if "ignored" in pairs.columns else F.lit(False)
    return pairs.groupBy(group).agg(
        F.count_if(both & right).alias("right"), F.count_if(both & ~right & (gold == pred)).alias("wrong_id"), F.count_if(both & (gold != pred)).alias("wrong_label"),
        F.count_if(pred.isNull()).alias("missed"), F.count_if(gold.isNull() & ~skip).alias("surplus"), F.count_if(gold.isNull() & skip).alias("ignored"),
        F.avg(F.when(both & right, F.col("confidence"))).alias("confidence_right"), F.avg(F.when(both & ~right, F.col("confidence"))).alias("confidence_wrong"),
    )


def arbiter_metrics(cases: DataFrame) -> DataFrame:
    """operation, n, answered, abstained, accuracy, precision, seconds (mean) from rows (operation, expected, answer, seconds); a null answer abstains, a null expected one should."""
    right = F.col("expected").eqNullSafe(F.col("answer"))
    said = F.col("answer").isNotNull()
    a = cases.groupBy("operation").agg(F.count("*").alias("n"), F.count_if(said).alias("answered"), F.count_if(~said).alias("abstained"), F.count_if(right).alias("_ok"), F.count_if(said & right).alias("_hit"), F.avg("seconds").alias("seconds"))
    return a.select("operation", "n", "answered", "abstained", (F.col("_ok") / F.col("n")).alias("accuracy"), F.when(F.col("answered") > 0, F.col("_hit") / F.col("answered")).alias("precision"), "seconds")


#: Least precision of an extractor's findings.
LEAST_PRECISION = 0.9


def run_verdict(core: DataFrame, other: DataFrame, score_core: float, score_other: float) -> DataFrame:
    """One row: what an arbiter changes against the core alone, and LIGAR or MANTER DESLIGADO.

    Runs are rows (doc_id, first, last, gold, pred, extracted). Vetoes: the score falls;
    a made-up citation becomes real; extracted findings are right too rarely; a finding of
    the core is lost.
    """
    on = ["doc_id", "first", "last"]
    j = core.select(*on, F.col("gold").alias("_g"), F.col("pred").alias("_a")).join(other.select(*on, F.col("gold").alias("_h"), F.col("pred").alias("_b"), "extracted"), on, "full")
    gold = F.coalesce("_g", "_h")
    a = j.agg(
        F.count_if((gold == "inventada") & ~F.col("_a").eqNullSafe(F.lit("real")) & (F.col("_b") == "real")).alias("made_up_to_real"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("lost"), F.count_if(F.coalesce("extracted", F.lit(False))).alias("extracted"),
        F.count_if(F.coalesce("extracted", F.lit(False)) & (gold == F.col("_b"))).alias("extracted_right"),
    )
    share = F.when(F.col("extracted") > 0, F.col("extracted_right") / F.col("extracted"))
    veto = (F.lit(score_other) < F.lit(score_core)) | (F.col("made_up_to_real") > 0) | (F.coalesce(share, F.lit(1.0)) < LEAST_PRECISION) | (F.col("lost") > 0)
    return a.withColumns({"delta": F.round(F.lit(score_other - score_core), 6), "precision": share, "verdict": F.when(veto, "MANTER DESLIGADO").otherwise("LIGAR")})


def disjoint(parts: DataFrame, id_col: str) -> DataFrame:
    """Documents that stand in more than one part; none if a split holds."""
    return parts.groupBy(id_col).agg(F.count_distinct("part").alias("n")).where("n > 1")


def errors_by_tag(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """tag, n, errors for tags with an error at least."""
    x = rows.select(F.explode(tags).alias("tag"), "ok")
    return x.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors")).where("errors > 0")


def holdout(rows: DataFrame, id_col: str) -> DataFrame:
    """With part: documents of even rank by id train, those of odd rank validate.

    The rank comes from a range-partitioned sort and counts per partition, not
    from one window over all documents.
    """
    ranked = _ranks(rows.select(id_col).distinct(), id_col)
    return rows.join(ranked, id_col).withColumn("part", F.when(F.col("rank") % 2 == 0, "train").otherwise("validate")).drop("rank")


def _ranks(ids: DataFrame, id_col: str) -> DataFrame:
    """id, rank from 0: sorted by ranges, numbered within them, moved on by the sizes of the ranges before."""
    x = ids.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).select(id_col, F.monotonically_increasing_id().alias("_m"))
    # written, because a second reading of a range partitioning may cut elsewhere
    x = materialise(x, "ranks")
    x = x.select(id_col, F.shiftright("_m", 33).alias("_part"), (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("_at"))
    sizes = x.groupBy("_part").agg(F.count("*").alias("n"))
    moved = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    return x.join(F.broadcast(moved), "_part").select(id_col, (F.col("_from") + F.col("_at")).alias("rank"))


def stats(c: str, name: str | None = None) -> list[Column]:
    """min, median, p90 and max of a column, named <name>_min and so on."""
    n = name or c
    return [F.min(c).alias(f"{n}_min"), F.percentile(c, 0.5).alias(f"{n}_median"), F.percentile(c, 0.9).alias(f"{n}_p90"), F.max(c).alias(f"{n}_max")]
