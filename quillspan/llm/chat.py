"""Chat formatting: conversations rebuilt from an event log, then rendered.

Events are partitioned by conversation, sorted by sequence and folded with
window and array functions; no user function runs.

An event has conv_id, seq, kind, turn, role and text:

* ``message`` starts a message at ``turn``; further ones at the same turn stand after it.
* ``delta`` appends its text to the last message of its turn.
* ``edit`` replaces the text of that message.
* ``regenerate`` empties that message and drops whatever stands at later turns so far.

A delta, edit or regenerate at a turn without a message starts one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import table

#: The template: <turn role>text</turn> and a line end, for each turn.
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
#: Reversible: no text holds "<", ">" or "#" once escaped, so none can hold a control string.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))
TRAINED = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, part, role, text.

    Null text and null role are empty; a null kind is a message; null conv_id,
    seq and turn are values of their own that sort first. Events of equal seq are
    taken in the order of kind (message first), role and text, so ties and
    repeated rows give one defined result: each repeated message is a message.
    One shuffle, by conv_id; the windows spill.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    e = events.select(
        "conv_id", "seq", "turn", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(kind == "message", 0).otherwise(1).alias("late"),
    )
    order = ["seq", "late", "kind", "role", "text"]
    by_turn = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    all_turn = Window.partitionBy("conv_id", "turn", "part").orderBy(*order)
    place = F.struct(F.col("seq").alias("seq"), F.col("late").alias("late"))
    # turns as dense numbers make "strictly before" a range of a bigint
    e = e.withColumn("t", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint"))
    # the last regeneration at any earlier turn: what came before it at this turn is gone
    before = Window.partitionBy("conv_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_cut", F.max(F.when(F.col("kind") == "regenerate", place)).over(before))
    e = e.where(F.col("_cut").isNull() | (place > F.col("_cut")))
    e = e.withColumn("part", F.sum((F.col("kind") == "message").cast("bigint")).over(by_turn))
    e = e.withColumn("n", F.row_number().over(all_turn))
    items = F.array_sort(F.collect_list(F.struct("n", "kind", "role", "text")))
    m = e.groupBy("conv_id", "turn", "part").agg(items.alias("i"))
    reset = F.aggregate("i", F.lit(0), lambda a, x: F.when(x["kind"] != "delta", x["n"]).otherwise(a))
    m = m.withColumn("reset", reset)
    live = F.filter("i", lambda x: x["n"] >= F.col("reset"))
    text = F.array_join(F.transform(F.filter(live, lambda x: x["kind"] != "regenerate"), lambda x: x["text"]), "")
    role = F.coalesce(F.get(F.filter(F.transform("i", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit(""))
    return m.select("conv_id", "turn", "part", role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: the rendered conversation and its loss mask.

    ``loss`` has the spans (``start`` 0-based and ``length``, code points) of the
    assistants' texts within ``formatted``. A conversation is one string, so its
    turns meet in one row: that is the result asked for.
    """
    spans = F.array_sort(F.collect_list(F.struct("turn", "part", "role", "text")))
    c = messages.groupBy("conv_id").agg(spans.alias("m"))
    c = c.withColumn("p", F.transform("m", lambda x: F.struct(x["role"].alias("role"), escape(x["role"]).alias("r"), escape(x["text"]).alias("t"))))
    c = c.withColumn("pieces", F.transform("p", lambda x: F.concat(F.lit(OPEN), x["r"], F.lit(CLOSE), x["t"], F.lit(END))))
    fixed = len(OPEN) + len(CLOSE)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        head = a["at"] + fixed + F.length(x["r"])
        span = F.struct(head.alias("start"), F.length(x["t"]).cast("bigint").alias("length"))
        return F.struct(
            (head + F.length(x["t"]) + len(END)).alias("at"),
            F.when(x["role"] == TRAINED, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
        )

    loss = F.aggregate("p", start, step, lambda a: a["spans"])
    return c.select("conv_id", F.array_join("pieces", "").alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text), loss_text: parsed from the rendered string and its mask alone."""
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    parse = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
        unescape(F.substring_index(x, CLOSE, -1)).alias("text"),
    )
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return rendered.select("conv_id", "formatted", F.transform(pieces, parse).alias("turns"), masked.alias("loss_text"))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows as message events, with conversation -7."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionAll(extra)
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_back(render(fold_events(conversation_events(spark, sf_dir))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return b.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESC_SQL = "replace(replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g'), '#', '\\h')"
OP8_SQL = f"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g AS (
 SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '') AS loss,
  sum(length({_ESC_SQL.format("role")}) + length({_ESC_SQL.format("text")}) + {len(OPEN) + len(CLOSE) + len(END)}) AS size
 FROM c GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM g
"""
