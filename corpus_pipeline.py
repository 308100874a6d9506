"""From raw documents to token ids: five stages, each written before the next one reads it.

In all stages a null text counts as an empty one, rows of equal doc_id are rows of
their own, columns besides doc_id and text pass through unread (but in the last
stage), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import contamination, neardup, pieces, privacy, quality
from quillspan.llm.common import drop_path, shared_dir, table
from quillspan.sources.shared import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: null, empty and short texts are among them. Long texts are judged whole."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id; rows that share it all stay, and so do rows without an id or without a word."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items cover beyond the limit go; null and empty items cover nothing, an empty benchmark neither."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and what discloses it is generalised. A null text stays null; columns _terms and _text_id are dropped."""
    return privacy.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document; none of a null or empty text. The ids decode to the text (``pieces.decode``)."""
    out = pieces.encode(docs.select("doc_id", "text"), pieces.read_vocabulary())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

#: Near copies, disclosing terms and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage's table is deleted once the next one is written; the last one's stays."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out, path = stage(spark, docs, sf_dir), shared_dir(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
