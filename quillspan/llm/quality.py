"""Quality rules: a threshold table compiled into one projection of ratios.

Everything is a column expression; no user function runs. Nothing is shuffled:
each text is judged by itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import table

#: What separates words, as a regular expression.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its not of on or she that the their they this to was were which will with you "
    "als auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nicht sich sie sind und von war wie zu zum "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui se ses son sur un une "
    "al como con del el ella ha las lo los más no para pero por se sin su sus un una y"
).split()


class Rule(NamedTuple):
    """Rejects a text of at least ``of_words`` words if ``count * scale`` is beyond ``limit * base``."""

    name: str
    count: str
    scale: int
    beyond: str  # "<" or ">"
    limit: int
    base: str
    of_words: int = 0
    least: tuple[str, int] | None = None  # only where this column is at least so large


#: The two base rules, then the method's own.
BASE_RULES = (Rule("few_words", "n_words", 1, "<", 20, "one"), Rule("repeated_windows", "n_repeat_words", 100, ">", 30, "n_words"))
RULES = (
    Rule("short_words", "word_chars", 1, "<", 2, "n_words"),
    Rule("long_words", "word_chars", 1, ">", 12, "n_words"),
    Rule("symbols", "n_symbols", 10, ">", 3, "n_words"),
    Rule("few_stop_words", "n_stop_words", 50, "<", 1, "n_words", 50),
    Rule("repeated_lines", "n_dup_lines", 2, ">", 1, "n_lines", 0, ("n_lines", 4)),
)


def compiled(rules: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """True where any rule rejects; integers only, so that every engine agrees."""
    out = F.lit(False)
    for r in rules:
        left, right = columns[r.count] * F.lit(r.scale), columns[r.base] * F.lit(r.limit)
        bad = left < right if r.beyond == "<" else left > right
        if r.of_words:
            bad = bad & (columns["n_words"] >= r.of_words)
        if r.least:
            bad = bad & (columns[r.least[0]] >= r.least[1])
        out = out | bad
    return out


def _repeat_words(p8: Column) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes in order."""
    pairs = F.array_sort(F.transform(p8, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(s: Column) -> Column:
        flag = lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])
        return F.array_sort(F.filter(F.transform(s, flag), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    # transform over an array of one binds its value, so that it is computed once
    marked = F.get(F.transform(F.array(pairs), positions), F.lit(0))
    return F.get(F.transform(F.array(marked), covered), F.lit(0))


def quality_features(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and, per row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (all bigint).

    Null and empty texts have no words and no lines: all counts are 0. Windows
    are compared by a 64-bit hash within one text. Rows are independent: repeated
    rows get equal results; an empty table gives an empty one. Only ``keep`` and
    the text are read, so other columns, whatever their names, don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    blank = " \t\n\x0b\x0c\r"
    d = df.select(*ids, text.alias("_t"))
    d = d.select(
        *names, "_t",
        F.filter(F.split("_t", BLANKS), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, blank, "") != "").alias("_l"),
    )
    d = d.select(
        *names, "_l",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", blank, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    for a, b in ((1, 2), (2, 4), (4, 8)):  # hashes of windows of 2, 4 and 8 words
        step = (lambda a: lambda h, i: F.xxhash64(h, F.get(F.col(f"_h{a}"), i + a)))(a)
        d = d.withColumn(f"_h{b}", F.transform(F.col(f"_h{a}"), step)).drop(f"_h{a}")
    d = d.withColumn("_p", F.when(F.col("n_words") >= WINDOW, F.slice("_h8", F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("_p")) < F.size("_p")
    return d.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        "n_words", "word_chars", "n_symbols",
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, _repeat_words(F.col("_p"))).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        "n_stop_words",
    )


def judge(features: DataFrame) -> DataFrame:
    """Adds base_failed and kept (both boolean, never null)."""
    columns = {c: F.col(c) for c in features.columns} | {"one": F.lit(1)}
    bad = compiled(BASE_RULES, columns)
    return features.withColumns({"base_failed": bad, "kept": ~(bad | compiled(RULES, columns))})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    # a column that isn't deterministic keeps the filter above the projection: pushed
    # through, it would repeat every expression that a later one uses more than once
    j = judge(quality_features(rows, "_text", ("_row",))).select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return j.where("kept AND _n >= 0").select("_row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(quality_features(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    parts = [f"{r.count} * {r.scale} {r.beyond} {r.limit} * {1 if r.base == 'one' else r.base}"]
    parts += [f"n_words >= {r.of_words}"] * bool(r.of_words) + ([f"{r.least[0]} >= {r.least[1]}"] if r.least else [])
    return "(" + " AND ".join(parts) + ")"


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: Counts of each text of ``{docs}`` in DuckDB SQL.
FEATURES_SQL = f"""
 q_text AS (SELECT doc_id AS q_id, row_number() OVER () AS q_row, coalesce(text, '') AS t FROM {{docs}}),
 q_split AS (SELECT q_id, q_row, t, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM q_text),
 q_words AS (SELECT q_row, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM q_split),
 q_windows AS (SELECT q_row, n, p, list(word) OVER (PARTITION BY q_row ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM q_words),
 q_found AS (SELECT q_row, p FROM (SELECT q_row, p, count(*) OVER (PARTITION BY q_row, win) AS c FROM q_windows WHERE p <= n - {WINDOW - 1}) WHERE c > 1),
 q_steps AS (SELECT q_row, least({WINDOW}, coalesce(lead(p) OVER (PARTITION BY q_row ORDER BY p) - p, {WINDOW})) AS step FROM q_found),
 q_repeat AS (SELECT q_row, sum(step)::BIGINT AS n_repeat_words FROM q_steps GROUP BY q_row),
 q_features AS (SELECT q_id, q_row, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
   (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
   len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
   FROM q_split LEFT JOIN q_repeat USING (q_row)),
 q_judged AS (SELECT *, {' OR '.join(map(_rule_sql, BASE_RULES))} AS base_failed, NOT ({' OR '.join(map(_rule_sql, BASE_RULES + RULES))}) AS kept FROM q_features)
"""
OP10_SQL = f"WITH {FEATURES_SQL.format(docs='documents')} SELECT q_id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged"
