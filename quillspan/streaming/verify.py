"""Verification of arriving documents: stateless per row, joined with a static base; counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspan.operators import detect, lookup
from quillspan.sources.shared import ship


def read_documents(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of doc_id, text, ts from Parquet files as they come."""
    ship(spark)
    return spark.readStream.schema("doc_id string, text string, ts timestamp").option("maxFilesPerTrigger", most_files).parquet(folder)


def verify(docs: DataFrame, owners_by_key: DataFrame) -> DataFrame:
    """Found citations with label and path; ``owners_by_key`` (key, owners) is static, so no state is kept."""
    found = detect.detect(docs, "text", families=("processo",))
    f = F.col("fields")
    c = found.select("doc_id", "ts", "first", "last", "piece", f["key"].alias("key"), F.nullif(f["cls"], F.lit("")).alias("cited_class"), F.nullif(f["uf"], F.lit("")).alias("state"), F.lit(None).cast("string").alias("court"))
    return lookup.classify(c.join(owners_by_key, "key", "left"))


def owners_by_key(identifiers: DataFrame) -> DataFrame:
    item = F.struct("record_id", "canonical_id", F.upper("own_class").alias("own_class"), F.col("state").alias("own_state"), F.col("court").alias("own_court"))
    return identifiers.where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("owners"))


def label_counts(verified: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, label, n by tumbling windows of event time; rows later than ``late`` are left out, by the watermark."""
    w = verified.withWatermark("ts", late).groupBy(F.window("ts", width), "label").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "label", "n")


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet; offsets and state stand in ``checkpoint``, a folder that all executors share."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
