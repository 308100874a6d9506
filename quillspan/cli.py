"""python -m quillspan.cli --input FOLDER --output FOLDER --base FOLDER: verify a folder of texts.

The base folder has Parquet tables identificadores, sumulas and dispositivos.
Exit status 2: an input that can't be used, or no text in it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from quillspan.plans.verify import verify
from quillspan.sources import files
from quillspan.sources.shared import ship


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspan")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--base", required=True)
    p.add_argument("--calibration")
    p.add_argument("--limit", type=int, help="only the first texts by name")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        files.probe_output(spark, a.output)
        docs = files.read_texts(spark, a.input)
        if a.limit:
            docs = docs.orderBy("doc_id").limit(a.limit)
        if docs.isEmpty():
            print(f"{a.input}: no texts", file=sys.stderr)
            return 2
        base = files.read_index(spark, a.base)
        other = [spark.read.parquet(f"{a.base}/{t}") for t in ("sumulas", "dispositivos")]
        table = files.read_calibration(spark, a.calibration) if a.calibration else spark.createDataFrame([], "path string, confidence double")
        r = verify(docs, base, *other, table)
        files.write_outputs(r.outputs, f"{a.output}/documentos")
        files.write_trace(r.trace, f"{a.output}/rastro")
    except (PySparkException, OSError, ValueError) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
