"""What driver and executors share: a folder for tables, and the package itself."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; under the temporary directory only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a Spark context."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(), "quillspan")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
