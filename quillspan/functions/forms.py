"""Canonical forms of what citations name: states, years, articles, statutes, dates; tolerant JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.functions.keys import LOOKALIKES, STATES
from quillspan.functions.text import text_key

# The states' names, in the order of their acronyms.
STATE_NAMES = (
    "acre", "alagoas", "amapa", "amazonas", "bahia", "ceara", "distrito federal", "espirito santo", "goias", "maranhao", "mato grosso", "mato grosso do sul", "minas gerais", "para",
    "paraiba", "parana", "pernambuco", "piaui", "rio de janeiro", "rio grande do norte", "rio grande do sul", "rondonia", "roraima", "santa catarina", "sao paulo", "sergipe", "tocantins",
)
# Months.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def state_of(names: DataFrame, col: str = "name") -> DataFrame:
    """``names`` with state: of an acronym, a name, or the only nearest name within a fifth of its letters (one at least); else null.

    The 27 names are a closed list, so every different name meets each of them.
    """
    listed = names.sparkSession.createDataFrame(list(zip(STATES, STATE_NAMES, strict=True)), "_uf string, _name string")
    d = names.select(col).distinct().withColumn("_k", text_key(F.col(col)))
    j = d.join(F.broadcast(listed)).withColumn("_d", F.when((F.col("_k") == F.col("_name")) | (F.upper("_k") == F.col("_uf")), 0).otherwise(F.levenshtein("_k", "_name")))
    j = j.where(F.col("_d") <= F.greatest(F.lit(1), F.floor(F.length("_k") / 5)))
    other = (F.substring("_k", 1, 3) != F.substring("_name", 1, 3)).cast("int")
    best = j.groupBy(col).agg(F.min_by("_uf", F.struct("_d", other, "_uf")).alias("state"))
    return names.join(best, col, "left")


def year_of(c: Column) -> Column:
    """Four digits with look-alikes undone, two of them real; else null."""
    y = F.translate(c, *LOOKALIKES)
    return F.when((F.length(F.regexp_replace(c, "[^0-9]", "")) >= 2) & y.rlike("^[0-9]{4}$"), y)


def article_of(c: Column) -> Column:
    """The article's number, whole, without dots and leading zeros; an ordinal o is no digit."""
    n = F.regexp_extract(c, r"(?i)art(?:igos?|s?\.?)\s*([0-9]{1,4}(?:\.[0-9]{3})?)[ºo°]?(?![0-9.])", 1)
    return F.nullif(F.regexp_replace(F.replace(n, F.lit("."), F.lit("")), "^0+", ""), F.lit(""))


def law_of(c: Column) -> Column:
    """LEI-n, LC-n or DL-n of a law cited by number."""
    kind = F.lower(F.regexp_extract(c, r"(?i)\b(lei\s+complementar|lc|decreto-lei|dl|lei)\s+(?:n[.º°o]*\s*)?([0-9.]+)", 1))
    n = F.replace(F.regexp_extract(c, r"(?i)\b(lei\s+complementar|lc|decreto-lei|dl|lei)\s+(?:n[.º°o]*\s*)?([0-9.]+)", 2), F.lit("."), F.lit(""))
    code = F.when(kind.rlike("^(lei\\s|lc)"), "LC-").when(kind.isin("decreto-lei", "dl"), "DL-").otherwise("LEI-")
    return F.when(n != "", F.concat(code, n))


def long_date(c: Column) -> Column:
    """A date in full: 3 de maio de 2021."""
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(c) - 1)
    return F.concat_ws(" de ", F.dayofmonth(c).cast("string"), month, F.year(c).cast("string"))


def court_number(c: Column) -> Column:
    """Twenty digits as NNNNNNN-DD.AAAA.J.TR.OOOO."""
    return F.regexp_replace(F.lpad(c, 20, "0"), r"^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$", r"$1-$2.$3.$4.$5.$6")


def parse_json(text: str | None) -> dict | None:
    """The first JSON object of a model's answer: fences, trailing commas, Python's literals and a cut-off list are forgiven."""
    if not text:
        return None
    text = re.sub(r"```(?:json)?", "", text)
    start = text.find("{")
    if start < 0:
        return None
    body, depth, quoted, skip, end = text[start:], [], False, False, None
    for i, ch in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not depth or depth.pop() != ch:
                return None
            if not depth:
                end = i + 1
                break
    if end is None:  # cut off: close what is open after the last whole element
        cut = max(body.rfind("}"), body.rfind("]"), body.rfind(","))
        if cut < 0:
            return None
        body = body[: cut + (body[cut] != ",")]
        stack = []
        for ch in re.sub(r'"(?:[^"\\]|\\.)*"', "", body):
            if ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]" and stack:
                stack.pop()
        body += "".join(reversed(stack))
    else:
        body = body[:end]
    for candidate in (body, re.sub(r",\s*([}\]])", r"\1", re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", body))))):
        try:
            out = json.loads(candidate)
            return out if isinstance(out, dict) else None
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def tolerant_json(c: pd.Series) -> pd.Series:
    """The object that ``parse_json`` reads, as plain JSON; null without one."""
    return c.map(lambda t: None if (o := parse_json(t)) is None else json.dumps(o, ensure_ascii=False, sort_keys=True))


def wrapped(text: str, width: int, protected: list[tuple[int, int]] = []) -> str:  # noqa: B006
    """The text with some blanks made line ends, none within protected spans; its length stays."""
    out, line = list(text), 0
    last = None
    for i, ch in enumerate(text):
        if ch == "\n":
            line, last = i + 1, None
        elif ch == " " and not any(a <= i < b for a, b in protected):
            last = i
        if i - line >= width and last is not None:
            out[last] = "\n"
            line, last = last + 1, None
    return "".join(out)
