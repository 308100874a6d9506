"""Content-addressed web archive.

Payload bytes are stored once, under a verified SHA-256; exact record headers
stand in a table of their own; original records come back through a join.

An archive is a folder of the shared store with two Parquet tables:

* ``payloads``: payload_sha256, first_id, payload - one row for each distinct payload;
* ``headers``: record_id, record_type, header (the record's exact header block, with its
  empty line), payload_sha256, refers_to.

A ``response`` record is header + payload + two line ends; a ``revisit`` record has no
payload of its own and names the response that it refers to.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import materialise, shared_dir, table, tidy

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A capture time, the same for all: tables of pages have none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
LEAST_BYTES = 0
#: Bits of the table of repeated digests, as a power of two.
BITS = 24


def base32(hex40: Column) -> Column:
    """Base32 of a 160-bit digest given in hexadecimal: 40 bits are 8 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _repeated(counts: DataFrame) -> DataFrame:
    """word, bits: a table of 2**BITS bits that has every digest of ``counts`` (payload_sha256), and lets a few others through."""
    h = F.xxhash64("payload_sha256")
    bit = F.shiftrightunsigned(h, 64 - BITS).bitwiseAND(63).cast("int")
    rows = counts.select(F.shiftrightunsigned(h, 64 - BITS + 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write the archive of ``pages`` into the folder ``path``.

    A null body is empty, a null url is an empty target. Of the rows with equal
    payloads of at least ``least_bytes`` bytes the one with the smallest id is the
    response (a null id comes before all), the others revisit it; a row that is
    repeated with that id is a response each time. An empty table gives empty
    tables. Other columns aren't read. Equal SHA-256 with another SHA-1 or length
    stops the job.

    A first scan writes what is said of each payload. Payloads that are there once
    go from the second scan to the store as they are; the others are combined in
    each task before they are shuffled. A table of 2**BITS bits tells them apart: it
    is sent to the tasks, its size doesn't depend on the rows, and what it takes for
    repeated is only shuffled in vain.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload")).withColumn("payload_sha256", F.sha2("payload", 256))
    said = materialise(rows.select("record_id", "url", "payload_sha256", F.sha1("payload").alias("sha1"), F.length("payload").alias("n")), "said")
    other = lambda c: F.min(c) != F.max(c)
    fail = F.raise_error(F.concat(F.lit("two payloads have the SHA-256 "), "payload_sha256")).cast("bigint")
    first = F.min(F.struct(F.col("record_id").isNotNull().alias("known"), "record_id"))
    firsts = said.groupBy("payload_sha256").agg(first.alias("first"), F.count("*").alias("copies"), (other("sha1") | other("n")).alias("clash"))
    firsts = materialise(firsts.select("payload_sha256", F.when(F.col("clash"), fail).otherwise(F.col("first.record_id")).alias("first_id"), "copies"), "firsts")

    again = F.broadcast(_repeated(firsts.where("copies > 1")))
    h = F.xxhash64("payload_sha256")
    body = rows.select("record_id", "payload_sha256", "payload", F.shiftrightunsigned(h, 64 - BITS + 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 64 - BITS).bitwiseAND(63).cast("int")).alias("own"))
    body = body.join(again, "word", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("own")), F.lit(0)) != 0)
    once = body.where(~F.col("maybe")).select("payload_sha256", F.col("record_id").alias("first_id"), "payload")
    more = body.where("maybe").groupBy("payload_sha256").agg(first.alias("first"), F.first("payload").alias("payload"))
    more = more.select("payload_sha256", F.col("first.record_id").alias("first_id"), "payload")
    once.unionByName(more).write.option("compression", "zstd").parquet(f"{path}/payloads")

    h = said.join(firsts, "payload_sha256")
    revisit = (F.col("n") >= least_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    h = h.select("*", kind.alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    uri = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    one_line = F.regexp_replace("url", "[\r\n]", "")
    header = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uri(F.col("record_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", one_line), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", uri(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit(CRLF),
    )
    h.select("record_id", "record_type", header.cast("binary").alias("header"), "payload_sha256", "refers_to").write.parquet(f"{path}/headers")


def payload_store(spark: SparkSession, path: str) -> DataFrame:
    """payload_sha256, payload: each payload is hashed anew and must have the digest that it is stored under."""
    p = spark.read.schema("payload_sha256 string, first_id bigint, payload binary").parquet(f"{path}/payloads")
    fail = F.raise_error(F.concat(F.lit("the payload isn't the one stored as "), "payload_sha256")).cast("binary")
    return p.select("payload_sha256", F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload")).otherwise(fail).alias("payload"))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_id bigint, record_type string, header binary, payload_sha256 string, refers_to bigint").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record (binary): every original record, byte for byte. Only responses meet the payloads."""
    h, end = _headers(spark, path), F.lit((CRLF * 2).encode())
    own = h.where("record_type = 'response'").join(payload_store(spark, path), "payload_sha256").select("record_id", F.concat("header", "payload", end).alias("record"))
    return own.unionByName(h.where("record_type <> 'response'").select("record_id", F.concat("header", end).alias("record")))


def field(block: Column, name: str) -> Column:
    """A header field's value; null where the block doesn't have it."""
    return F.nullif(F.regexp_extract(block, rf"(?m)^{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the original records.

    A response's size and digest are those of its content, which must be as long as
    its header says and have the digest that it says; a revisit has those of the
    response with its digest.
    """
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    r = read_records(spark, path).select("record", F.concat(head, F.lit(CRLF)).alias("block"), (F.octet_length(head) + 4).alias("at"))
    r = r.select("block", F.octet_length("record").alias("size"), "at", field(F.col("block"), "Content-Length").cast("int").alias("n"), "record")
    r = r.select("block", "n", (F.col("size") == F.col("at") + F.col("n") + 4).alias("whole"), F.substr("record", F.col("at") + 1, F.col("n")).alias("content"))
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:record:(-?[0-9]*)>", 1), F.lit("")).cast("bigint")
    block, kind = F.col("block"), field(F.col("block"), "WARC-Type")
    said = F.substring(field(block, "WARC-Payload-Digest"), 6, 32)
    wrong = F.raise_error(F.concat(F.lit("the record and its payload disagree: "), block)).cast("string")
    digest = F.when(F.col("whole") & ((kind != "response") | (said == base32(F.sha1("content")))), said).otherwise(wrong)
    parsed = r.select(number(field(block, "WARC-Record-ID")).alias("page_id"), F.when(kind == "response", F.col("n").cast("bigint")).alias("own_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), number(field(block, "WARC-Refers-To")).alias("refers_to"))
    parsed = materialise(parsed, "records")
    sizes = parsed.where("own_bytes IS NOT NULL").groupBy("payload_digest").agg(F.max("own_bytes").alias("payload_bytes"))
    return parsed.join(sizes, "payload_digest", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def parse_records(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Offset, header block and content of the records of a WARC file, plain or gzipped member by member; a cut-off last record is left out."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(raw) + member.flush())
            except zlib.error:
                break
            raw = member.unused_data
        raw = b"".join(parts)
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            return
        size = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", raw[at:end])
        content = end + 4
        if not size or content + int(size[1]) > len(raw):
            return
        yield at, raw[at:content], raw[content : content + int(size[1])]
        at = content + int(size[1])


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, header, content of every record of the WARC files at ``path``; a file is one task's, so its size bounds memory (Spark reads files up to 2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for at, header, content in parse_records(raw.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([header], pa.binary()), pa.array([content], pa.binary())], ["path", "offset", "header", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), "path string, offset bigint, header binary, content binary")


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member; members one after the other are a .warc.gz file."""
    return gzip.compress(record, mtime=0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d, 1 + 10 * (i // 8)::INT, 10) AS BIGINT) >> (35 - 5 * (i % 8))::INT) & 31 AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
