import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    """Rows of a pandas frame as comparable tuples, by column name."""
    import math

    cols = sorted(frame.columns)

    def plain(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan", "None"):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        return int(x) if isinstance(x, float) and math.isfinite(x) and x == int(x) else x

    return cols, sorted(tuple(str(plain(x)) for x in r) for r in frame[cols].astype(object).itertuples(index=False))
