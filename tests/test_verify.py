"""The whole verification, the command line, windows, forms and audits on hand-made rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillspan import cli
from quillspan.functions import forms
from quillspan.operators import audit, base, detect, windows
from quillspan.plans.verify import verify
from quillspan.sources import files

BODY = "Trata-se de recurso interposto contra a sentença que julgou o pedido do autor procedente em parte.\n"


def tables(spark):
    i = base.identifiers(spark.createDataFrame([("a", 1, "12345", "RESP", "SP", "STJ", 2019, "Fulano")], "record_id string, canonical_id bigint, number string, own_class string, state string, court string, year int, rapporteur string"))
    su = spark.createDataFrame([("STJ", False, 7, 100)], "court string, binding boolean, number int, canonical_id bigint")
    st = spark.createDataFrame([("CF", "5", 200)], "statute string, article string, canonical_id bigint")
    return i, su, st


def test_verify(spark):
    docs = [("d1", "REsp 99.999/SP\n" + BODY + "Veja o REsp 12.345/SP e a Súmula 7 do STJ; Autos 77777."), ("d2", "nada"), ("d3", None)]
    table = spark.createDataFrame([("processo", 0.9), ("sumula", 0.7)], "path string, confidence double")
    r = verify(spark.createDataFrame(docs, "doc_id string, text string"), *tables(spark), table)
    out = {x.doc_id: json.loads(x.json)["citacoes"] for x in r.outputs.collect()}
    assert [(c["id"], c["trecho"], c["classificacao"], c["confianca"]) for c in out["d1"]] == [("c1", "REsp 12.345/SP", "real", 0.9), ("c2", "Súmula 7 do STJ", "real", 0.7)]
    assert out["d2"] == [] and out["d3"] == []
    assert {(t.inicio == 0, t.status) for t in r.trace.collect() if t.status != "emitida"} == {(True, "descartada:cabecalho"), (False, "descartada:amplo_sem_confirmacao")}
    for c in out["d1"]:
        assert docs[0][1][c["inicio"] : c["fim"]] == c["trecho"]


def test_verify_takes_other_components(spark):
    only = lambda d: detect.detect(d, families=("sumula",))
    r = verify(spark.createDataFrame([("d", BODY + "REsp 12.345/SP e Súmula 7 do STJ")], "doc_id string, text string"), *tables(spark), spark.createDataFrame([], "path string, confidence double"), detector=only)
    assert [c["confianca"] for c in json.loads(r.outputs.first().json)["citacoes"]] == [0.5]


def test_cli(spark, tmp_path):
    i, su, st = tables(spark)
    files.write_index(i, f"{tmp_path}/base")
    su.write.parquet(f"{tmp_path}/base/sumulas")
    st.write.parquet(f"{tmp_path}/base/dispositivos")
    (tmp_path / "in").mkdir()
    args = ["--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--base", f"{tmp_path}/base"]
    assert cli.main(args, spark) == 2
    (tmp_path / "in" / "x.txt").write_text(BODY + "REsp 12.345/SP")
    assert cli.main(args, spark) == 0
    assert [t.status for t in files.read_trace(spark, f"{tmp_path}/out/rastro").collect()] == ["emitida"]
    assert cli.main(["--input", f"{tmp_path}/none", "--output", "x", "--base", "y"], spark) == 2


# --- windows -----------------------------------------------------------------------


def test_blocks():
    t = "a" * 500 + ". " + "b" * 600 + "\n\n" + "c" * 2000
    got = list(windows.blocks(t))
    assert got == [(0, 502), (502, 1102), (1104, 2004), (2004, 2904), (2904, 3104)]
    assert list(windows.blocks(t, 1104))[0] == (1104, 2004)


def test_windows(spark):
    t = "\n\n".join(f"recurso {'STF ' * (i % 4)}número {i}" for i in range(10)) + "\n\nsem nada"
    d = spark.createDataFrame([(1, t), (2, None)], "doc_id bigint, text string")
    got = windows.windows(d, most=3).orderBy("first").collect()
    assert [r.cues for r in got] == [3, 4, 4] and all(t[r.first : r.last].startswith("recurso") for r in got)
    assert windows.windows(d, most=0).count() == 0
    taken = spark.createDataFrame([(1, 0, len(t))], "doc_id bigint, first int, last int")
    assert windows.windows(d, taken).count() == 0


def test_places():
    assert windows.nearest("ab x ab", "ab", 6) == (5, 7) and windows.nearest("a\n b", "a b") == (0, 4) and windows.nearest("x", "y") is None
    t = "da Súmula 7, "
    assert t[slice(*windows.trimmed(t, 0, len(t)))] == "Súmula 7"


# --- forms ---------------------------------------------------------------------------


@pytest.mark.parametrize("value,expected", [("São Paulo", "SP"), ("sp", "SP"), ("Sao Pauio", "SP"), ("Xanadu", None), ("Parana", "PR"), ("Paraíba", "PB")])
def test_states(spark, value, expected):
    assert forms.state_of(spark.createDataFrame([(value,)], "name string")).first().state == expected


@pytest.mark.parametrize("f,value,expected", [
    (forms.year_of, "2O19", "2019"), (forms.year_of, "l99O", "1990"), (forms.year_of, "lO9O", None), (forms.year_of, "19", None), (forms.article_of, "art. 1.022 do CPC", "1022"), (forms.article_of, "artigo 5º", "5"), (forms.article_of, "art.", None),
    (forms.law_of, "Lei nº 8.078/90", "LEI-8078"), (forms.law_of, "Lei Complementar 64", "LC-64"), (forms.law_of, "Decreto-Lei 200", "DL-200"), (forms.law_of, "lei", None), (forms.court_number, "12342011605009", "0000001-23.4201.1.60.5009"),
])
def test_forms(spark, f, value, expected):
    assert spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y == expected


def test_long_date(spark):
    assert spark.createDataFrame([(datetime.date(2021, 5, 3),)], "x date").select(forms.long_date(F.col("x"))).first()[0] == "3 de maio de 2021"


@pytest.mark.parametrize("value,expected", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ("x {'a': 1}", None), ('{"a": None, "b": True}', {"a": None, "b": True}), ('{"a": [{"b": 1}, {"b": 2', {"a": [{"b": 1}]}), ('{"a": "}"} tail', {"a": "}"}), ("", None), (None, None), ("[1]", None),
])
def test_tolerant_json(spark, value, expected):
    assert forms.parse_json(value) == expected
    got = spark.createDataFrame([(value,)], "x string").select(forms.tolerant_json("x").alias("y")).first().y
    assert (None if got is None else json.loads(got)) == expected


def test_wrapped():
    t = "um dois três quatro cinco"
    w = forms.wrapped(t, 9, [(8, 19)])
    assert len(w) == len(t) and w.replace("\n", " ") == t and "três quatro" in w and "\n" in w


# --- audits ----------------------------------------------------------------------------


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "um\nfulano de\ntal aqui\nfim"), (2, "nada"), (3, None)], "doc_id bigint, text string")
    lit = spark.createDataFrame([("fulano de tal",), ("",), (None,), ("fim",)], "literal string")
    assert sorted((r.line_no, r.literal) for r in audit.leaks(docs, lit).collect()) == [(0, "fulano de tal"), (1, "fim"), (1, "fulano de tal"), (2, "fim"), (3, "fim")]
