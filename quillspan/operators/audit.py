"""Looks at the base, the corpus and the cache: statistics, false owners, leaks, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import lines, text_key
from quillspan.operators.evaluation import stats


def index_statistics(identifiers: DataFrame, formats: tuple[str, ...] = ("cnj", "registro", "sequencial", "outro")) -> DataFrame:
    """court, records, without_key, with_state and a count for each format."""
    per = [F.count_if(F.col("format") == f).alias(f"n_{f}") for f in formats]
    return identifiers.groupBy("court").agg(F.count("*").alias("records"), F.count_if(F.col("key") == "").alias("without_key"), F.count("state").alias("with_state"), *per)


def anatomy(records: DataFrame, by: str, value: str) -> DataFrame:
    """by, n and the value's min, median, p90 and max."""
    return records.groupBy(by).agg(F.count("*").alias("n"), *stats(value))


def mentions_without_owner(numbers: DataFrame, owners: DataFrame) -> DataFrame:
    """key, n: keys that documents mention (doc_id, key) but no record owns, with the number of documents."""
    return numbers.distinct().join(owners.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def leaks(docs: DataFrame, forbidden: DataFrame, id_col: str = "doc_id", rows: int = 3, text_col: str = "text") -> DataFrame:
    """id, line_no, literal: forbidden literals (one column, literal) inside ``rows`` lines that follow one another.

    The literals are a stated list; a longer text is met by its first word, which
    must stand in the lines, before the whole is looked for.
    """
    x = lines(docs, id_col, text_col)
    w = Window.partitionBy(id_col).orderBy("line_no")
    joined = F.concat_ws(" ", "line", *[F.lead("line", i).over(w) for i in range(1, rows)])
    x = x.select(id_col, "line_no", F.regexp_replace(joined, r"\s+", " ").alias("_t"))
    words = x.select(id_col, "line_no", "_t", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w"))
    lit = forbidden.select("literal", F.regexp_replace(F.trim("literal"), r"\s+", " ").alias("_l")).where("_l <> ''").withColumn("_w", F.substring_index("_l", " ", 1))
    return words.join(lit, "_w").where(F.contains("_t", F.col("_l"))).select(id_col, "line_no", "literal").distinct()


def word_set(texts: DataFrame, text_col: str = "text", least: int = 4) -> DataFrame:
    """word: the different words of ``least`` letters or more, as text keys."""
    return texts.select(F.explode(F.split(text_key(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+")).alias("word")).where(F.length("word") >= least).distinct()


def forbidden_words(closed: DataFrame, scanned: DataFrame, clean: DataFrame, text_col: str = "text") -> DataFrame:
    """word, kind: words of closed texts that clean ones don't have (fechada), and words that only scanned texts have (so_ocr)."""
    known = word_set(clean, text_col)
    own = word_set(closed, text_col)
    secret = own.join(known, "word", "left_anti").withColumn("kind", F.lit("fechada"))
    return secret.unionByName(word_set(scanned, text_col).join(own.union(known).distinct(), "word", "left_anti").withColumn("kind", F.lit("so_ocr")))


def vote(numbers: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, key, n, first: for each document the number (doc_id, key, first) that it has most often, ``least`` times or more; of equal ones the smallest key."""
    c = numbers.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least)
    return c.groupBy("doc_id").agg(F.min_by(F.struct("key", "n", "first"), F.struct(-F.col("n"), F.col("key"))).alias("b")).select("doc_id", "b.*")


def cache_statistics(cache: DataFrame, by: str = "operation") -> DataFrame:
    return cache.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("abstained"))


def label_counts(decided: DataFrame, id_col: str = "doc_id", labels: tuple[str, ...] = ("real", "inventada", "incompleta")) -> DataFrame:
    """id and a count for each label."""
    return decided.groupBy(id_col).agg(*[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in labels])


def last_before(rows: DataFrame, by: list[str], order: list[str], wanted: Column, value: str, within: Column | None = None) -> DataFrame:
    """``rows`` with before: the value of the nearest earlier row for which ``wanted`` holds, as of each row; null beyond ``within``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))
    return out if within is None else out.withColumn("before", F.when(within, F.col("before")))


def detection_metrics(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: gold, predicted, matched, exact spans, recall, precision, mean overlap."""
    n, p = gold.agg(F.count("*").alias("gold")), pred.agg(F.count("*").alias("predicted"))
    m = matched.agg(F.count("*").alias("matched"), F.count_if(F.col("overlap") == 1).alias("exact"), F.avg("overlap").alias("mean_iou"))
    j = n.join(p).join(m)  # three rows of one
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return j.withColumns({"recall": share("matched", "gold"), "precision": share("matched", "predicted")})
