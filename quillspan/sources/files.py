"""Sources and sinks: text folders, gold sets, calibration and index files, traces, contract documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import contract

INDEX_VERSION = 1
_STEM = r"([^/]+)\.[^./]+$"


def decoded(raw: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 as it is; else cp1252 if no valid multibyte sequence shows that it was meant as UTF-8; else UTF-8 with U+FFFD."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        loose = raw.decode("utf-8", "replace")
        if any(ord(c) > 127 and c != "�" for c in loose):
            return loose, "utf-8-replace"
        try:
            return raw.decode("cp1252"), "cp1252"
        except UnicodeDecodeError:
            return loose, "utf-8-replace"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name without suffix), text, encoding of the .txt files of a folder, any case; not of sub-folders.

    Files whose names start with a dot are left out, by rule. Spark passes over
    names that start with an underscore, so the driver reads those, which are few.
    Spark reads no rows from empty files, so those come from its listing, with an
    empty text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    named = files.select(F.regexp_extract("path", _STEM, 1).alias("doc_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [decoded(x) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in both], pa.string()), pa.array([e for _, e in both], pa.string())], ["doc_id", "text", "encoding"])

    read = named.mapInArrow(run, "doc_id string, text string, encoding string")
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(F.regexp_extract("path", _STEM, 1).alias("doc_id"))
    empty = listed.join(named.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("").alias("text"), F.lit("utf-8").alias("encoding"))
    hidden = [(name.rsplit(".", 1)[0], *decoded(raw)) for name, raw in _underscored(spark, folder)]
    return read.unionByName(empty).unionByName(spark.createDataFrame(hidden, read.schema))


def _underscored(spark: SparkSession, folder: str) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of the .txt files whose names start with an underscore, through Hadoop's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(path):
        name = status.getPath().getName()
        if status.isFile() and name.startswith("_") and name.lower().endswith(".txt"):
            stream = store.open(status.getPath())
            try:
                yield name, bytes(stream.readAllBytes())
            finally:
                stream.close()


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files at a path; compare it with a stored one to see whether an index is stale."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_fingerprints(found: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """key, status: OK, DIVERGE or AUSENTE for each expected file."""
    j = expected.select(key, F.col("sha256").alias("_e")).join(found.select(key, "sha256"), key, "left")
    return j.select(key, F.when(F.col("sha256").isNull(), "AUSENTE").when(F.col("sha256") == F.col("_e"), "OK").otherwise("DIVERGE").alias("status"))


def write_index(identifiers: DataFrame, folder: str) -> None:
    """The index as Parquet with its version."""
    identifiers.write.mode("overwrite").parquet(f"{folder}/identificadores")
    identifiers.sparkSession.createDataFrame([(INDEX_VERSION,)], "versao int").write.mode("overwrite").parquet(f"{folder}/meta")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index of the current version; another version is an error."""
    version = spark.read.parquet(f"{folder}/meta").first().versao
    if version != INDEX_VERSION:
        raise ValueError(f"{folder}: index version {version}, not {INDEX_VERSION}")
    return spark.read.parquet(f"{folder}/identificadores")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """path, confidence from a flat JSON object or one under ``tabela``; values that aren't numbers are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.tabela"), "value").alias("j"))
    pairs = whole.select(F.explode(F.from_json("j", "map<string,string>")).alias("path", "v"))
    return pairs.select("path", F.col("v").try_cast("double").alias("confidence")).where("confidence IS NOT NULL")


def write_calibration(table: DataFrame, path: str, meta: dict | None = None, most: int = 100_000) -> None:
    """One JSON object, keys sorted, four decimals. The table has a row for each decision path: ``most`` bounds it."""
    rows = table.orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} paths are no calibration table")
    text = json.dumps({"meta": meta or {}, "tabela": {r.path: round(r.confidence, 4) for r in rows}}, ensure_ascii=False, sort_keys=True, indent=2)
    table.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold set: nivel, documento_id, citacao_id, inicio, fim, trecho, tipo, classificacao, id_canonico; byte-order mark and CRLF allowed, \\n in trecho is a line end."""
    g = spark.read.csv(path, header=True, multiLine=True, escape='"')
    ids = F.split(F.coalesce("id_canonico", F.lit("")), ":")
    return g.select(
        F.col("nivel").cast("int").alias("nivel"), "documento_id", "citacao_id", F.col("inicio").cast("int").alias("inicio"), F.col("fim").cast("int").alias("fim"),
        F.replace("trecho", F.lit("\\n"), F.lit("\n")).alias("trecho"), "tipo", F.lower("classificacao").alias("classificacao"), F.filter(ids, lambda x: x != "").alias("ids"),
    )


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """documento_id: the documents that a sample submission expects, trimmed; empty ones are left out."""
    return spark.read.csv(path, header=True).select(F.trim("documento_id").alias("documento_id")).where("documento_id <> ''").distinct()


def write_submission(cells: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The submission as CSV with a header: documento_id, citacoes; sorted by id."""
    out = cells.select(F.col(id_col).cast("string").alias("documento_id"), "citacoes").orderBy("documento_id")
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def probe_output(spark: SparkSession, folder: str) -> None:
    """Make the folder and write and delete a file in it; an error says that it can't be written, before any work is done."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, probe = hadoop.Path(folder), hadoop.Path(f"{folder.rstrip('/')}/.probe")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if not store.mkdirs(path):
            raise OSError(f"{folder} can't be made")
        store.create(probe, True).close()
        store.delete(probe, False)
    except Exception as e:
        raise OSError(f"{folder} can't be written: {e}") from e


def write_set(docs: DataFrame, folder: str, cases: DataFrame | None = None) -> None:
    """A synthetic set (doc_id, text, gold): txt, goldenset.csv, casos_llm.jsonl, estatisticas.json and manifesto.json, each a Spark folder."""
    g = docs.select("doc_id", F.posexplode("gold").alias("n", "g"))
    base = ["documento_id", "citacao_id", "inicio", "fim", "trecho", "tipo", "classificacao", "id_canonico"]
    gold = g.select(
        F.coalesce(F.nullif(F.regexp_extract("doc_id", r"_n([1-9])_", 1), F.lit("")), F.lit("1")).alias("nivel"), F.col("doc_id").alias("documento_id"), F.concat(F.lit("c"), (F.col("n") + 1).cast("string")).alias("citacao_id"),
        F.col("g.first").alias("inicio"), F.col("g.last").alias("fim"), F.replace("g.piece", F.lit("\n"), F.lit("\\n")).alias("trecho"), F.when(F.col("g.family") == "dispositivo", "lei").otherwise("jurisprudencia").alias("tipo"),
        F.col("g.label").alias("classificacao"), F.when(F.col("g.label") == "real", F.col("g.key")).otherwise("").alias("id_canonico"), F.col("g.family").alias("familia"), F.array_join("g.noise", ";").alias("ruidos"),
    )
    docs.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(f"{folder}/txt")
    gold.select("nivel", *base).write.mode("overwrite").option("header", True).csv(f"{folder}/goldenset.csv")
    gold.write.mode("overwrite").option("header", True).csv(f"{folder}/goldenset_estendido.csv")
    if cases is not None:
        cases.write.mode("overwrite").json(f"{folder}/casos_llm.jsonl")
    gold.groupBy("familia", "classificacao").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{folder}/estatisticas.json")
    docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.size("gold").alias("citacoes")).write.mode("overwrite").json(f"{folder}/manifesto.json")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(contract.TRACE).json(path)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("overwrite").json(path)


def write_outputs(outputs: DataFrame, folder: str) -> None:
    """One JSON document a line, with its id: Spark names files, not rows.."""
    outputs.write.mode("overwrite").json(folder)


def bundle(rows: Iterator[tuple[str, str]]) -> bytes:
    """A zip of named texts that is the same for the same texts: sorted names, fixed times and modes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sorted(rows):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


def export_cache(cache: DataFrame, path: str) -> None:
    """All answers as JSON lines in the order of their keys."""
    cache.orderBy("cache_key").write.mode("overwrite").json(path)


def import_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cache_key string, answer string").json(path)


def degraded(texts: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row: documents, those not read as UTF-8, those that failed."""
    return texts.agg(F.count("*").alias("documents"), F.count_if(F.col("encoding") != "utf-8").alias("not_utf8"), F.count_if(failed if failed is not None else F.lit(False)).alias("failed"))
