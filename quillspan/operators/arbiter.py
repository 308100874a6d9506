"""The optional arbiter: asked in batches, answers cached, proofs required.

Only a deterministic mock stands in for a model. An answer counts only if it can
be read off the text: an arbiter points at candidates, it never labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.functions.keys import cache_key
from quillspan.operators import detect, numbers, spans
from quillspan.operators.distractors import denied
from quillspan.operators.lookup import cached, upsert
from quillspan.operators.windows import MOST, nearest, trimmed, windows

MODEL, REVISION, PROMPT = "mock", "1", "1"
OPERATION = "escolher"


def request_key(operation: Column, entry: Column) -> Column:
    return cache_key(F.lit(MODEL), F.lit(REVISION), F.lit(PROMPT), operation, entry)


def mock_choice(requests: DataFrame) -> DataFrame:
    """cache_key, answer: the candidate (id, own_class, year, rapporteur) that alone has the cited class, else the best by year (2) and rapporteur (2) if it is alone; null abstains."""
    exact = F.filter("candidates", lambda x: x["own_class"] == F.col("cited_class"))
    points = lambda x: F.when(x["year"] == F.col("year"), 2).otherwise(0) + F.when(F.lower(x["rapporteur"]) == F.lower(F.col("rapporteur")), 2).otherwise(0)
    scored = F.transform("candidates", lambda x: F.struct(points(x).alias("p"), x["id"].alias("id")))
    best = F.array_max(F.transform(scored, lambda x: x["p"]))
    top = F.filter(scored, lambda x: (x["p"] == best) & (x["p"] > 0))
    answer = F.when(F.size(exact) == 1, F.get(exact, F.lit(0))["id"]).when(F.size(top) == 1, F.get(top, F.lit(0))["id"])
    return requests.select("cache_key", answer.alias("answer"))


def ask(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to all requests, and the cache with the new ones: hits are joined, misses asked once for each key."""
    hit, miss = cached(requests.select("cache_key"), cache)
    new = mock_choice(requests.join(miss.distinct(), "cache_key", "left_semi").dropDuplicates(["cache_key"]))
    return hit.select("cache_key", "answer").distinct().unionByName(new), upsert(cache, new)


def provable(text: Column, answer: Column) -> Column:
    """An extracted piece counts only where it stands literally in the text."""
    return answer.isNotNull() & (answer != "") & F.contains(text, answer)


def digits_fit(piece: Column, digits: Column) -> Column:
    """Whether the digits follow from the piece by reading look-alikes as digits and nothing else."""
    return F.regexp_replace(F.translate(piece, "OolI|SsgqGBZz", "0011155996822"), "[^0-9]", "") == digits


def extract(docs: DataFrame, found: DataFrame, answer, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Findings that an arbiter points at, in the shape of ``detect``: windows, answers, canonical form, detection, place.

    ``answer`` takes a window's text and gives records (family, quoted piece and the
    family's fields). An answer counts only if its piece stands in the window, its
    family never says otherwise, and its canonical form is itself found as one citation
    of that family; what meets a finding of ``found`` is left out.
    """
    w = windows(docs, found, id_col, text_col, most).join(docs.select(id_col, text_col), id_col)
    w = w.select(id_col, "first", F.substr(text_col, F.col("first") + 1, F.col("last") - F.col("first")).alias("_window"))
    id_type = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (first, window) in enumerate(zip(b.column("first").to_pylist(), b.column("_window").to_pylist(), strict=True)):
                for got in answer(window):
                    place = nearest(window, got.get("piece", ""))
                    form = numbers.canonical(got)
                    again = [f for f in detect.candidates(form) if f.family == got.get("family")] if form else []
                    if place and len(again) == 1:
                        a, z = trimmed(window, *place)
                        at.append(i)
                        out.append(again[0]._replace(first=first + a, last=first + z, origin=f"llm:extrator:{MODEL}:{got['family']}", strength=1.0))
            rows = [{**f._asdict(), "piece": b.column("_window")[i].as_py()[f.first - b.column("first")[i].as_py() : f.last - b.column("first")[i].as_py()], "fields": list(f.fields.items())} for i, f in zip(at, out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), pa.array(rows, detect.FOUND)], [id_col, "_f"])

    got = w.mapInArrow(run, StructType([id_type, StructType.fromDDL(f"_f struct<{detect.FIELDS}>").fields[0]])).select(id_col, "_f.*")
    got = got.where(~denied(F.col("piece"), F.col("family")))
    known = found.select(F.col(id_col).alias("_id"), F.col("first").alias("_a"), F.col("last").alias("_z"))
    return got.join(known, (F.col(id_col) == F.col("_id")) & (F.col("first") < F.col("_z")) & (F.col("_a") < F.col("last")), "left_anti")


def with_extracted(found: DataFrame, extracted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Detected and extracted findings together, without those that a better one overlaps: the union, sanitised again."""
    both = found.unionByName(extracted.select(*found.columns))
    kept = spans.suppress(both.select(id_col, "first", "last", "family", "strength"), list(detect.FAMILIES), id_col).where("status = 'emitida'").drop("status")
    return both.join(kept, [id_col, "first", "last", "family", "strength"], "left_semi")


def cases(docs: DataFrame, near: int = 120) -> DataFrame:
    """case_id, operation, window, expected: an arbiter's test cases from documents with gold spans.

    For each citation a case with it, a trap without it (the answer is none), and one
    with a neighbour whose number differs in a digit (the answer is the right one).
    """
    g = docs.select("doc_id", "text", F.posexplode("gold").alias("n", "g"))
    low = F.greatest(F.lit(0), F.col("g.first") - near)
    window = F.substr("text", low + 1, F.col("g.last") + near - low)
    without = F.concat(F.substr("text", low + 1, F.col("g.first") - low), F.substr("text", F.col("g.last") + 1, F.lit(near)))
    digit = F.right("g.key", F.lit(1)).cast("int")
    neighbour = F.concat(F.substr("g.key", F.lit(1), F.length("g.key") - 1), ((digit + 1) % 10).cast("string"))
    case = lambda kind, w, answer: F.struct(F.lit(kind).alias("operation"), w.alias("window"), answer.alias("expected"))
    rows = F.array(case("extrair", window, F.col("g.piece")), case("extrair:armadilha", without, F.lit(None).cast("string")), case("escolher:vizinho", F.concat_ws("|", "g.key", neighbour), F.col("g.key")))
    return g.select(F.concat_ws(":", "doc_id", F.col("n").cast("string")).alias("case_id"), F.inline(rows))
