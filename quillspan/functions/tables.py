"""A table function for SQL: ``LATERAL match_spans(text, pattern)``."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="first int, last int, piece string")
class MatchSpans:
    """Matches of a Python pattern with code-point offsets; null text has none."""

    def eval(self, text: str, pattern: str):
        for m in re.finditer(pattern, text or ""):
            if m.end() > m.start():
                yield m.start(), m.end(), m[0]


def register(spark: SparkSession) -> None:
    spark.udtf.register("match_spans", MatchSpans)
