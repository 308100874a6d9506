"""The reference base: records, their identifiers, and citing text rendered from the star schema.

The base stands on ``orders`` (a record for each order); citations on
``lineitem`` (a citation for each line). Every third number is moved out of the
base and every seventh state is exchanged, by rules on the keys alone, so that an
independent SQL can tell the right answer. A record whose number would be another's
moved one has a number of its own beyond them all (``own_number``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.keys import STATES, digit_key, key_format
from quillspan.operators import detect

FIRST_NUMBER, MOVED = 1_000_000, 5_000_000
CLASSES = {"F": "REsp", "O": "Rcl", "P": "HC"}
COURTS = ("STF", "STJ", "TSE", "TST", "STM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state_at(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATES)), F.pmod(n, F.lit(len(STATES))).cast("int"))


def own_number(key: Column, orders: DataFrame) -> Column:
    """A record's number: its key and FIRST_NUMBER, so that no citation that is moved out of the base names it.

    From the smallest key + MOVED on, that sum is what a smaller key is moved to. There it is led
    by ones and a two to one digit more than the largest moved number: still different for each key,
    and with no further 0 or 8, which are what look-alike letters are written for.
    """
    low, high = (orders.agg(f("o_orderkey")).scalar() for f in (F.min, F.max))
    number, digits = (key + FIRST_NUMBER).cast("string"), F.length((high + FIRST_NUMBER + MOVED).cast("string"))
    lead = F.lpad(F.lit("2"), digits + 1 - F.length(number), F.lit("1"))
    return F.when(key - low >= MOVED, F.concat(lead, number)).otherwise(number)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, canonical_id, number, own_class, state, court, year, rapporteur."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    cls = F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("o_orderstatus"))
    court = F.get(F.array(*map(F.lit, COURTS)), F.pmod("o_custkey", F.lit(len(COURTS))).cast("int"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(
        F.concat(F.lit("o"), "o_orderkey").alias("record_id"), F.col("o_orderkey").alias("canonical_id"),
        own_number(F.col("o_orderkey"), o).alias("number"), cls.alias("own_class"), state_at(F.col("c_nationkey")).alias("state"),
        court.alias("court"), F.year("o_orderdate").alias("year"), F.col("c_name").alias("rapporteur"),
    )


def identifiers(records: DataFrame) -> DataFrame:
    """key, format and the record's columns: the index that citations are looked up in."""
    return records.withColumns({"key": digit_key(F.col("number")), "format": key_format(F.col("number"))})


def own_number_index(identifiers: DataFrame) -> DataFrame:
    """key, owners (sorted distinct record ids), n_owners, ambiguous."""
    g = identifiers.groupBy("key").agg(F.array_sort(F.collect_set("record_id")).alias("owners"))
    return g.select("key", "owners", F.size("owners").cast("bigint").alias("n_owners"), (F.size("owners") > 1).alias("ambiguous"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, order, line and the fields that the rendered text has: cited_class, number, state."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    r = records(spark, sf_dir).select("canonical_id", F.col("own_class").alias("cited_class"), F.col("state").alias("own_state"))
    s = F.col("l_orderkey") + F.col("l_linenumber")
    j = l.select("l_suppkey", "l_orderkey", "l_linenumber", s.alias("s")).join(r, F.col("l_orderkey") == F.col("canonical_id"))
    moved = (F.col("l_orderkey") + FIRST_NUMBER + MOVED).cast("string")
    number = F.when(F.col("s") % 3 == 0, moved).otherwise(own_number(F.col("l_orderkey"), table(spark, sf_dir, "orders")))
    states = F.array(*map(F.lit, STATES))
    nxt = state_at(F.array_position(states, F.col("own_state")).cast("bigint"))
    return j.select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "cited_class", number.alias("number"), F.when(F.col("s") % 7 == 0, nxt).otherwise(F.col("own_state")).alias("state"))


def render(citations: DataFrame) -> DataFrame:
    """With text: a sentence that cites class, number with dots, and state."""
    n = F.reverse(F.regexp_replace(F.reverse(F.col("number")), "([0-9]{3})(?=[0-9])", "$1."))
    return citations.withColumn("text", F.concat(F.lit("Conforme decidido no "), "cited_class", F.lit(" "), n, F.lit("/"), "state", F.lit(", nega-se provimento.")))


HEADER = 600


def own_numbers(records: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """id, key, chain, first: the numbers in records' headers that are their own; of equal key and chain the earliest."""
    head = records.select(id_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, HEADER).alias("text"))
    f = detect.detect(head, "text", families=("processo",)).select(id_col, F.col("fields")["key"].alias("key"), F.col("fields")["chain"].alias("chain"), "first")
    return f.where("key <> ''").groupBy(id_col, "key", "chain").agg(F.min("first").alias("first"))


def normatives(records: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the first lines of records (canonical_id, court, text) that are no rulings: súmulas (court, binding, number, canonical_id), statutes (statute, article, canonical_id), and the canonical ids that are neither."""
    line = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")[0]
    f = detect.detect(records.select("canonical_id", F.col("court").alias("_court"), line.alias("text")), "text", families=("sumula", "dispositivo"))
    v = F.col("fields")
    s = f.where("family = 'sumula'").select(F.coalesce(F.nullif(v["court"], F.lit("")), F.when(v["binding"] == "1", "STF"), "_court").alias("court"), (v["binding"] == "1").alias("binding"), v["number"].cast("int").alias("number"), "canonical_id")
    d = f.where("family = 'dispositivo' AND fields['statute'] <> ''").select(v["statute"].alias("statute"), v["article"].alias("article"), "canonical_id")
    rest = records.select("canonical_id").join(s.select("canonical_id").unionAll(d.select("canonical_id")).distinct(), "canonical_id", "left_anti")
    return s, d, rest
