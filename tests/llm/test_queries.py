"""The registered queries against their SQL, and the pipeline against its stages' rules."""

import importlib

import pytest

from quillspan.llm import common, contamination, neardup, pieces, privacy, registry
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, sf_dir, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_jaccard_table(spark, size):
    sf_dir = f"/root/testdata/sf{size}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in registry.QUERIES["op1_jaccard"](spark, sf_dir).collect()}
    expected = neardup.brute_force(docs)
    print("links found", sum(n for _, n in got.values()), "of", sum(n for _, n in expected.values()))
    assert got == expected


def test_pipeline(spark, duck, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in pipeline.STAGES:
        seen.append(common.materialise(stage(spark, seen[-1], sf_dir), "test"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({registry.ORACLE_SQL['op10_quality']}) WHERE kept").fetchall()}
    assert ids(seen[1]) == good and seen[1].columns == docs.columns
    classes = neardup.brute_force([(r.doc_id, r.text) for r in seen[1].collect()])
    assert ids(seen[2]) == {c for c, _ in classes.values()}
    # all windows of all items, whole texts
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = contamination.normalised((r.text or "").encode())
        k = min(contamination.WINDOW, len(w))
        windows |= {(k, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k}
    sizes = {k for k, _ in windows}
    clean = set()
    for r in seen[2].collect():
        w = contamination.normalised(r.text.encode())
        hit = {p for k in sizes for i in range(len(w) - k + 1) if (k, tuple(w[i : i + k])) in windows for p in range(i, i + k)}
        if not (hit and contamination.COVERAGE * len(hit) >= len(w)):
            clean.add(r.doc_id)
    assert ids(seen[3]) == clean and seen[3].columns == docs.columns
    assert ids(seen[4]) == ids(seen[3]) and seen[4].columns == docs.columns
    for r in seen[4].collect():
        assert not [s for s in privacy.base_spans(r.text) if s[1] != "phone"] and r.n_chars == len(r.text)
    v = pieces.read_vocabulary()
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert pieces.decode_ids(r.ids, v) == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_pipeline_drops_what_must_go(spark, tmp_path):
    """A near copy, a contaminated and a poor document go; personal data is replaced; nulls, repeated rows and other columns pass."""
    pipeline = importlib.import_module("corpus_pipeline")
    words = [f"word{i}" for i in range(3000)]
    prose = lambda a, n=80: " ".join("the of and to".split()[i % 4] if i % 3 == 0 else words[a + i] for i in range(n)) + "."
    item = " ".join(f"exam{i}" for i in range(30))
    rows = [
        (1, prose(0)), (2, prose(0) + " more"), (3, prose(200)), (3, prose(200)), (4, prose(400, 60) + " " + item), (5, "short"), (6, None), (7, ""), (None, prose(600)),
        (8, prose(800) + " write to ann@b.cd now and then"), (9, prose(1000, 600) + " " + " ".join(item.split()[:13])),
    ]
    docs = spark.createDataFrame([(i, t, "x", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, _row string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    v = pieces.read_vocabulary()
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 3, 3, 8, 9]
    text = {r.doc_id: pieces.decode_ids(r.ids, v) for r in out}
    assert text[1] == prose(0) and "ann@b.cd" not in text[8] and "[EMAIL]" in text[8]


def test_stages_on_empty_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
