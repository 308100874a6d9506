"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import drop_path, shared_dir


def _mins(pairs: DataFrame) -> DataFrame:
    """u, v, m for pairs (u, v), m the least of u and its partners.

    All pairs of a star's centre meet in one join key. Grouping by a column more than
    the join's leaves the join with plain shuffles on both sides, and only such a
    join is split by adaptive execution where a centre has very many partners.
    """
    least = pairs.groupBy("u", F.octet_length("u").alias("n")).agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    d = _mins(down)
    return d.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(d.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v); root is the component's least node.

    Each round shuffles the edges and is written to the shared folder, so the
    lineage stays short and a lost executor costs one round. Rounds grow with the
    logarithm of the longest chain. Self-loops, repeated edges and null ends count
    for nothing; no edges give no nodes.
    """
    spark = edges.sparkSession
    now = edges.select("u", "v").where("u <> v").distinct()
    path = None
    while True:
        new = shared_dir(spark, "stars")
        _small_star(_large_star(now) if path else now).write.parquet(new)
        now = spark.read.schema(now.schema).parquet(new)
        if path:
            drop_path(spark, path)
        path = new
        # a forest of stars: a child has one parent, which is nobody's child
        parents = now.select(F.col("v").alias("u")).distinct()
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(parents, "u", "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
