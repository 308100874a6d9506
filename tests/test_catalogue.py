"""Every registered query of the engine's own operators against its SQL."""

import pytest

from quillspan.plans import catalogue
from tests.conftest import rows


def against_sql(spark, folder, name):
    """A query's rows and its SQL's, over the tables in a folder."""
    import duckdb

    c = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    return rows(catalogue.QUERIES[name](spark, str(folder)).toPandas()), rows(c.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_parts_and_words(spark, tmp_path):
    rows_ = [(1, "green green"), (70, "green greed"), (71, "olive fern"), (72, "plive fern")]
    spark.createDataFrame(rows_, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    near = {(r.p_partkey, r.cited) for r in catalogue.QUERIES["token_array_match_all"](spark, str(tmp_path)).collect() if r.near}
    assert near == {(k, c) for k in (1, 70) for c in ("green green", "green greed")}
    edits = {(r.a, r.b): r.edits for r in catalogue.QUERIES["edit_distance_all"](spark, str(tmp_path)).collect()}
    assert edits["olive", "plive"] == 1 and edits["greed", "green"] == 1


def test_generated_documents_follow_the_input(spark, tmp_path):
    spark.range(300).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(50).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.QUERIES["synth_docs"](spark, str(tmp_path)).count() == 300
    n = {(r.family, r.label): r.n for r in catalogue.QUERIES["detect_all_families"](spark, str(tmp_path)).collect()}
    gold = catalogue.QUERIES["synth_docs"](spark, str(tmp_path)).agg({"n_gold": "sum"}).first()[0]
    assert sum(n.values()) == gold


@pytest.fixture(scope="module")
def wide_keys(spark, tmp_path_factory):
    """Orders whose keys reach beyond what moved numbers are moved by: 5000003 has the number that 3's moved citations name."""
    d, line = tmp_path_factory.mktemp("wide"), "k bigint, l_linenumber int"
    keys = [first + i for first in (0, 800, 5_000_000, 5_088_880, 10_000_000, 15_000_000) for i in range(30)]
    k, i = "k", "CAST(k % 5 AS bigint)"
    o = spark.createDataFrame([(x,) for x in keys], "k bigint").selectExpr(f"{k} AS o_orderkey", f"{i} AS o_custkey", "substring('FOP', CAST(k % 3 AS int) + 1, 1) AS o_orderstatus", "TIMESTAMP '1995-01-01 00:00:00' AS o_orderdate")
    o.write.parquet(f"{d}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "concat('Customer', id) AS c_name", "CAST(id * 6 AS int) AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    lines = spark.createDataFrame([(x, n) for x in keys for n in range(1, 7)], line)
    lines.selectExpr("k AS l_orderkey", "k % 4 AS l_suppkey", "l_linenumber").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["alt_key_repair", "lookup_cardinality", "mentions_without_owner", "cite_verify"])
def test_moved_numbers_have_no_owner_among_many_orders(spark, wide_keys, name):
    got, want = against_sql(spark, wide_keys, name)
    assert got == want


def test_own_numbers_are_distinct_and_never_moved_ones(spark, wide_keys):
    from quillspan.operators import base

    own = {r.canonical_id: r.number for r in base.records(spark, str(wide_keys)).collect()}
    assert len(set(own.values())) == len(own) == 180 and own[29] == "1000029"
    cited = base.citations(spark, str(wide_keys)).collect()
    moved = {r.number for r in cited if (r.order_id + r.line_no) % 3 == 0}
    assert moved == {str(k + base.FIRST_NUMBER + base.MOVED) for k in own} and not moved & set(own.values())
    assert all(r.number == own[r.order_id] for r in cited if (r.order_id + r.line_no) % 3)


def test_document_union_joins_all_rows_of_an_id(spark, tmp_path):
    """Ids keep four digits, so 12340 to 12349 share theirs by level; a row without a key has no id."""
    keys = [None, 5, 8, 123, *range(12_340, 12_350), *range(123_400, 123_407)]
    spark.createDataFrame([(k,) for k in keys], "doc_id bigint").write.parquet(f"{tmp_path}/labels.parquet")
    got, want = against_sql(spark, tmp_path, "document_union")
    assert got == want and len(got[1]) > len(set(got[1]))
