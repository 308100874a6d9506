"""Operators on hand-made rows: keys, spans, lookups, calibration, detectors, files, streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspan.functions import keys, tables, text
from quillspan.operators import arbiter, base, calibration, contract, detect, evaluation, lookup, numbers, resolve, spans, synth
from quillspan.sources import files
from quillspan.streaming import verify as stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


# --- text and keys -------------------------------------------------------------


@pytest.mark.parametrize("value,expected", [("  CONSTITUIÇÃO\n Federal ", "constituicao federal"), ("nº  1ª", "nº 1ª"), ("é", "e"), ("a b", "a b")])
def test_text_key(spark, value, expected):
    assert one(spark, value, text.text_key) == expected


def test_tolerant_key(spark):
    assert one(spark, "Turrna-2", text.tolerant_key) == "turma 2"


@pytest.mark.parametrize("value,expected", [("doc_n2_001", 2), ("doc", 1), ("n3", 3), ("xn4", 1)])
def test_level(spark, value, expected):
    assert one(spark, value, text.level_of) == expected


def test_match_spans(spark):
    got = one(spark, "é1 \U0001f60022 c333", lambda c: text.match_spans(c, "[0-9]+"))
    assert [(s.first, s.last, s.piece) for s in got] == [(1, 2, "1"), (4, 6, "22"), (8, 11, "333")]
    assert one(spark, None, lambda c: text.match_spans(c, "[0-9]+")) == []
    tables.register(spark)
    assert [(r.first, r.piece) for r in spark.sql("SELECT * FROM match_spans('é1 \U0001f60022', '[0-9]+')").collect()] == [(1, "1"), (4, "22")]


def test_crop_and_mask(spark):
    d = spark.createDataFrame([("a" * 50 + "PIECE" + "b" * 50, "PIECE")], "c string, p string")
    got = d.select(text.crop(F.col("c"), F.col("p"), 21).alias("y")).first().y
    assert len(got) == 21 and "PIECE" in got
    assert d.select(text.mask(F.lit("ab12c3"), text.match_spans(F.lit("ab12c3"), "[0-9]+")).alias("y")).first().y == "ab⟦12⟧c⟦3⟧"


@pytest.mark.parametrize("value,key,kind", [("0036", "36", "sequencial"), ("", "", "outro"), ("201901234567", "201901234567", "registro"), ("12342011605009" + "9" * 3, "00012342011605009999", "cnj"), ("1" * 21, "1" * 21, "outro"), ("000", "0", "sequencial")])
def test_digit_keys(spark, value, key, kind):
    assert one(spark, value, keys.digit_key) == key and one(spark, value, keys.key_format) == kind


@pytest.mark.parametrize("value,expected", [("34567l9", "3456719"), ("No", None), ("SS5", None), ("1O99", "1099")])
def test_fix_group(spark, value, expected):
    assert one(spark, value, keys.fix_group) == expected


@pytest.mark.parametrize("value,rest,state", [("REsp 1.234.567/SP", "REsp 1.234.567", "SP"), ("HC 12 - 5P", "HC 12", "SP"), ("AgRg no MS", "AgRg no MS", None), ("RE 1 (R0)", "RE 1", "RO"), ("REsp 9", "REsp 9", None)])
def test_split_state(spark, value, rest, state):
    assert one(spark, value, lambda c: F.struct(*keys.split_state(c))) == (rest, state)


def test_class_tiers(spark):
    d = spark.createDataFrame([("RESP", "RESP"), ("RESP", "RESPE"), ("HC", "MS"), (None, "HC")], "a string, b string")
    assert [r.t for r in d.select(keys.class_tier(F.col("a"), F.col("b")).alias("t")).collect()] == [1, 2, 3, 2]
    assert one(spark, ["AGRG", "RESP", "2O"], keys.main_class, "array<string>") == "RESP"


# --- spans -----------------------------------------------------------------------


def test_fuse_and_suppress(spark):
    rows = [(1, 0, 10, "a", 0.5), (1, 5, 8, "b", 1.0), (1, 8, 12, "a", 0.5), (1, 20, 30, "a", 1.0), (1, 20, 30, "b", 1.0), (2, 0, 1, "a", 1.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, first bigint, last bigint, family string, strength double")
    assert sorted((r.doc_id, r.first, r.last, r.family) for r in spans.fuse(d, ["a", "b"]).collect()) == [(1, 5, 8, "b"), (1, 8, 12, "a"), (1, 20, 30, "a"), (2, 0, 1, "a")]
    s = spans.suppress(d, ["a", "b"]).where("status <> 'emitida'").collect()
    assert [(r.first, r.family) for r in s] == [(20, "b")]
    assert spans.overlapping(spans.fuse(d, ["a", "b"])).count() == 0
    assert spans.overlapping(d).count() == 3


def test_fold_in_python_equals_columns(spark):
    rnd = random.Random(1)
    rows = []
    for doc in range(20):
        for _ in range(rnd.randrange(30)):
            a = rnd.randrange(60)
            rows.append((doc, a, a + rnd.randrange(1, 12), rnd.choice(detect.FAMILIES), rnd.choice([0.4, 0.5, 1.0])))
    d = spark.createDataFrame(sorted(set(rows)), "doc_id bigint, first bigint, last bigint, family string, strength double")
    got = sorted(tuple(r) for r in spans.fuse(d, list(detect.FAMILIES)).collect())
    expected = [(doc, f.first, f.last, f.family, f.strength) for doc in range(20) for f in detect.chosen([detect.Found(a, b, fam, "", "", s, {}) for i, a, b, fam, s in set(rows) if i == doc])]
    assert got == sorted(expected)


def test_align(spark):
    gold = spark.createDataFrame([(1, "g1", 0, 10), (1, "g2", 20, 30), (1, "g3", 40, 50)], "doc_id bigint, g string, first bigint, last bigint")
    pred = spark.createDataFrame([(1, "p1", 0, 10), (1, "p2", 1, 10), (1, "p3", 22, 30), (1, "p4", 48, 60)], "doc_id bigint, p string, first bigint, last bigint")
    m = spans.align(gold, pred)
    assert sorted((r.g, r.p) for r in m.collect()) == [("g1", "p1"), ("g2", "p3")]
    assert [r.p for r in spans.extras(gold, pred, m).collect()] == ["p2"]


def test_holdout_and_accuracy(spark):
    d = spark.createDataFrame([(f"d{i:03}",) for i in range(101)] * 2, "doc_id string").repartition(7)
    got = {(r.doc_id, r.part) for r in evaluation.holdout(d, "doc_id").collect()}
    assert got == {(f"d{i:03}", "validate" if i % 2 else "train") for i in range(101)}


# --- lookups -----------------------------------------------------------------------


def found(spark, citations, records):
    i = spark.createDataFrame(records, "record_id string, canonical_id bigint, key string, own_class string, state string, court string")
    c = spark.createDataFrame(citations, "cid int, key string, cited_class string, state string, court string")
    return {r.cid: (r.label, r.path, r.canonical_id) for r in lookup.classify(lookup.owners(c, i)).collect()}


def test_cascade(spark):
    records = [
        ("a", 1, "10001", "RESP", "SP", "STJ"), ("b", 2, "10002", "HC", None, "STJ"), ("c", 3, "10002", "MS", "RJ", "STF"), ("d", 4, "10003", "HC", "SP", None), ("e", 5, "10003", "HC", None, None),
        ("f", 6, "42", "HC", None, None), ("g", 7, "10004", "HC", "SP", "STF"), ("h", 8, "10004", "HC", "SP", "STF"),
    ]
    got = found(spark, [
        (0, "999", "HC", None, None), (1, "10001", "RESP", "SP", None), (2, "10001", "RESP", "RJ", None), (3, "10001", "RESP", None, "STF"), (4, "10001", "HC", None, None), (5, "10001", "HC", "SP", None),
        (6, "10002", "MS", None, None), (7, "10002", "RESP", None, "TST"), (8, "10003", "HC", "SP", None), (9, "42", "MS", None, None), (10, "10004", "HC", None, None), (11, "", "HC", None, None), (12, "10001", "RESPE", None, None),
    ], records)
    assert got == {
        0: ("inventada", "processo:0cand", None), 1: ("real", "processo:1cand:cadeia_exata", 1), 2: ("inventada", "processo:1cand:uf_incompativel", None), 3: ("inventada", "processo:1cand:tribunal_incompativel", None),
        4: ("inventada", "processo:1cand:classe_divergente:sem_uf", None), 5: ("real", "processo:1cand:classe_divergente", 1), 6: ("real", "processo:multi:classe", 3), 7: ("inventada", "processo:multi:tribunal_incompativel", None),
        8: ("real", "processo:multi:uf_confirmada", 4), 9: ("inventada", "processo:1cand:curto_classe_divergente", None), 10: ("real", "processo:ambiguo_chute", 7), 11: ("inventada", "processo:0cand", None), 12: ("real", "processo:1cand:classe_compativel", 1),
    }


@pytest.mark.parametrize("cls,key,court", [("RESP", "123", "STJ"), ("HC", "123", None), ("RESP", "00012345620196260100", "TSE"), ("HC", "00012345620198260100", None), (None, "1", None)])
def test_inferred_court(spark, cls, key, court):
    assert spark.createDataFrame([(cls, key)], "c string, k string").select(keys.inferred_court(F.col("c"), F.col("k")).alias("y")).first().y == court


def test_inferred_court_eliminates(spark):
    i = spark.createDataFrame([("a", 1, "10001", "HC", None, "STF"), ("b", 2, "10002", "RESPE", None, "TSE")], "record_id string, canonical_id bigint, key string, own_class string, state string, court string")
    c = spark.createDataFrame([(0, "10001", "RESP", "STJ"), (1, "10002", "RESP", "STJ")], "cid int, key string, cited_class string, inferred string").withColumns({"state": F.lit(None).cast("string"), "court": F.lit(None).cast("string")})
    got = {r.cid: r.path for r in lookup.classify(lookup.owners(c, i)).collect()}
    assert got == {0: "processo:1cand:tribunal_incompativel", 1: "processo:1cand:classe_compativel"}


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1)], "cache_key string, answer int")
    q = spark.createDataFrame([("a",), ("b",), ("b",)], "cache_key string")
    hit, miss = lookup.cached(q, cache)
    assert hit.count() == 1 and miss.count() == 2
    assert sorted(map(tuple, lookup.upsert(cache, spark.createDataFrame([("a", 2), ("c", 3)], "cache_key string, answer int")).collect())) == [("a", 2), ("c", 3)]
    import hashlib

    assert one(spark, "x", lambda c: keys.cache_key(c, F.lit(None), F.lit("y"))) == hashlib.sha256(b"x\x1f\x1fy").hexdigest()


def test_arbiter(spark):
    cands = [(1, "HC", 2000, "A"), (2, "HC", 2001, "B"), (3, "MS", 2001, "C")]
    q = spark.createDataFrame([("k1", cands, "MS", 1990, "Z"), ("k2", cands, "HC", 2001, "b"), ("k3", cands, "HC", 1990, "z"), ("k4", cands, "RE", 2001, "z")], "cache_key string, candidates array<struct<id:int,own_class:string,year:int,rapporteur:string>>, cited_class string, year int, rapporteur string")
    answers, cache = arbiter.ask(q, spark.createDataFrame([("k4", 9)], "cache_key string, answer int"))
    assert {r.cache_key: r.answer for r in answers.collect()} == {"k1": 3, "k2": 2, "k3": None, "k4": 9} and cache.count() == 4
    assert spark.range(1).select(arbiter.digits_fit(F.lit("1.O9l"), F.lit("1091"))).first()[0] and not spark.range(1).select(arbiter.provable(F.lit("abc"), F.lit("x"))).first()[0]


# --- calibration -----------------------------------------------------------------------


def test_lookup_keys(spark):
    assert one(spark, "a:ocr_reparado:b:c", calibration.lookup_keys) == ["a:ocr_reparado:b:c", "a:b:c", "a:ocr_reparado:b", "a:b", "a:ocr_reparado", "a"]
    assert one(spark, "", calibration.lookup_keys) == []


@pytest.mark.parametrize("literal", [500, 0])
def test_confidence(spark, monkeypatch, literal):
    monkeypatch.setattr(calibration.value_of, "__defaults__", (literal,))
    table = spark.createDataFrame([("a", 0.8), ("a:b:amplo", 0.4), ("n", float("nan")), ("z", 5.0)], "path string, confidence double")
    d = spark.createDataFrame([("a:x", 1.0), ("a:x", 0.5), ("a:b:amplo", 0.5), ("q", 1.0), ("n", 1.0), ("z", 1.0), ("i:j", 1.0)], "path string, strength double")
    initial = spark.createDataFrame([("i", 0.6)], "path string, confidence double")
    got = {(r.path, r.strength): round(r.confidence, 6) for r in calibration.confidence(d, table, initial).collect()}
    assert got == {("a:x", 1.0): 0.8, ("a:x", 0.5): 0.4, ("a:b:amplo", 0.5): 0.4, ("q", 1.0): 0.5, ("n", 1.0): 0.5, ("z", 1.0): 0.998, ("i:j", 1.0): 0.6}


def test_fit(spark):
    initial = spark.createDataFrame([("a", 0.9), ("processo:duplicata", 0.5), ("llm", 0.9)], "path string, confidence double")
    rows = [("a:b", 1)] * 120 + [("processo:duplicata", 0)] * 50 + [("llm:x", 1)] * 200 + [("c", 0)]
    scored = spark.createDataFrame([(p, h, 1.0) for p, h in rows], "path string, hit int, weight double")
    got = {r.path: r.confidence for r in calibration.fit(initial, scored).collect()}
    assert got["a:b"] == pytest.approx((120 + 3.6) / 124) and got["a"] == got["a:b"] and got["llm:x"] == 0.98 and got["processo:duplicata"] == 0.5 and got["c"] == pytest.approx(2 / 5)
    assert "processo" not in got


def test_brier_of_nothing(spark):
    t = spark.createDataFrame([("a", 0.8)], "path string, confidence double")
    assert calibration.brier(spark.createDataFrame([], "path string, hit int, strength double, weight double"), t).first().brier is None


# --- detectors ---------------------------------------------------------------------------

CASES = [
    ("no REsp 1.234.567/SP.", "REsp 1.234.567/SP", {"key": "1234567", "cls": "RESP", "uf": "SP"}),
    ("o AgRg no REsp n. 987.654 - MG e", "AgRg no REsp n. 987.654 - MG", {"chain": "AGRG RESP", "uf": "MG"}),
    ("RESP 1.46g.781/5P", "RESP 1.46g.781/5P", {"key": "1469781", "uf": "SP", "letters": "1"}),
    ("Recurso Especial nº 12.345 (RJ)", "Recurso Especial nº 12.345 (RJ)", {"cls": "RESP", "key": "12345"}),
    ("REsp 2019/0123456-7 aqui", "REsp 2019/0123456-7", {"key": "201901234567"}),
    ("a Súmula 7 do STJ,", "Súmula 7 do STJ", {"number": "7", "court": "STJ", "binding": "0"}),
    ("a SV 10.", "SV 10", {"binding": "1", "number": "10"}),
    ("o Tema 69 da repercussão geral", "Tema 69 da repercussão geral", {"number": "69", "court": "STF"}),
    ("o art. 5º, LV, da Constituição Federal e", "art. 5º, LV, da Constituição Federal", {"article": "5", "statute": "CF"}),
    ("art. 3º da Lei 8.078/90", "art. 3º da Lei 8.078/90", {"statute": "CDC"}),
    ("Precedente do STF, de 2019, Rel. Min. Fulano de Tal", "Precedente do STF, de 2019, Rel. Min. Fulano de Tal", {"court": "STF", "year": "2019", "rapporteur": "Fulano de Tal"}),
]


@pytest.mark.parametrize("value,piece,fields", CASES)
def test_detectors(value, piece, fields):
    got = detect.chosen(detect.candidates(value))
    assert [value[f.first : f.last] for f in got] == [piece]
    assert fields.items() <= got[0].fields.items()


def test_enumeration_and_strengths():
    t = "REsps 1.111.111/SP e 2.222.222/RJ; Tema 5 do sumário; Tema 6 julgado; XYz 12345"
    got = {t[f.first : f.last]: f.strength for f in detect.candidates(t)}
    assert got == {"REsps 1.111.111/SP": 1.0, "2.222.222/RJ": 1.0, "Tema 5": 0.4, "Tema 6": 0.7, "XYz 12345": 0.5}


@pytest.mark.parametrize("value", ["", "STJ 12345", "R$ 1.234,00", "Súmula do STJ", "art. da lei", "fls. 12/13", "1.234.567"])
def test_no_citation(value):
    assert detect.candidates(value) == []


@pytest.mark.parametrize("value", ["1" * 20000, "REsp " * 4000, "1." * 10000, "art. " + "§ 1º, " * 3000, "\xa0" * 9000 + "x", "Súmula " * 3000, "a-" * 9000, "REsp 1" + "/SP e 1" * 3000, "l" * 20000])
def test_detectors_take_linear_time(value):
    began = time.time()
    detect.candidates(value)
    assert time.time() - began < 5


def test_matches_and_choices_scale(spark):
    """20 000 matches of one text, and 30 000 candidates of one document."""
    text_ = "12 " * 20_000
    df = spark.createDataFrame([(1, text_)], "doc_id bigint, text string")
    q = df.select(F.inline(text.match_spans(F.col("text"), "[0-9]+")))
    began = time.time()
    got = q.collect()
    assert time.time() - began < 10 and len(got) == 20_000 and (got[-1].first, got[-1].last, got[-1].piece) == (59_997, 59_999, "12")
    rows = [{"first": i % 30_000, "last": i % 30_000 + 1 + i % 40} for i in range(0, 60_000, 2)]
    began = time.time()
    apart, unlike = spans.apart(rows), spans.unlike(0.5)(rows)
    assert time.time() - began < 4
    assert all(a["last"] <= b["first"] for a, b in zip(sorted(apart, key=lambda x: x["first"]), sorted(apart, key=lambda x: x["first"])[1:]))
    few = rows[:400]
    slow = []
    for x in few:
        if not any(spans.alike(x["first"], x["last"], (y["first"], y["last"]), 0.5) for y in slow):
            slow.append(x)
    assert spans.unlike(0.5)(few) == slow and len(unlike) > 1000


def test_numbers_and_chains():
    assert [n.key for n in numbers.numbers("1.234.567, 0001234-56.2020.8.26.0100; 1.23.4567-8 e l2.345")] == ["1234567", "00012345620208260100", "", "12345"]
    assert numbers.principal("art. 5 do REsp 1.234.567").raw == "1.234.567" and numbers.principal("12 e 345").raw == "345" and numbers.principal("nada") is None
    assert numbers.chain_of_citation("2ºs EDcl nos EDcl no AgRg no REsp 1.234.567/SP") == ("EDCL", "EDCL", "AGRG", "RESP")
    assert numbers.chain_of_citation(["REsp", "AgRg"]) == ("RESP", "AGRG") and numbers.chain_of_citation("Rec. Esp.") == ("RESP",)
    assert numbers.spells("AgRg no REsp 12.345", ("AGRG", "RESP")) and not numbers.spells("REsp 12.345", ("RE",)) and not numbers.spells("12.345", ())
    assert numbers.canonical({"family": "dispositivo", "article": "5", "statute": "LEI-9099"}) == "art. 5 da Lei 9.099" and numbers.canonical({"family": "processo"}) == ""


def test_sets_and_samples(spark, tmp_path):
    from quillspan.sources import files

    d = synth.generate(spark, 20, 100, level=2, families=synth.FAMILIES)
    files.probe_output(spark, f"{tmp_path}/set")
    files.write_set(d, f"{tmp_path}/set", arbiter.cases(d))
    gold = files.read_gold(spark, f"{tmp_path}/set/goldenset.csv")
    assert gold.count() == d.selectExpr("sum(size(gold)) AS n").first().n and gold.where("classificacao = 'real'").count() > 0
    files.write_submission(contract.cell(spark.createDataFrame([], "doc_id string, first int, last int, label string, canonical_id string, confidence double"), d.select("doc_id")), f"{tmp_path}/submission")
    assert files.read_sample(spark, f"{tmp_path}/submission").count() == 20
    (tmp_path / "file").write_text("x")
    with pytest.raises(OSError):
        files.probe_output(spark, f"{tmp_path}/file/below")


def test_traps_and_catalogue():
    assert not [f for i in range(300) for f in detect.candidates(synth.trap(3, i)) if f.strength >= 1]
    for i in range(300):
        for g in synth.document(5, i, 2, 1000, families=synth.FAMILIES)[2]:
            read = synth.catalogue(g["piece"])
            assert read["family"] == g["family"] and ("ocr" in g["noise"] or read["key"] == g["key"]), g
            assert not ("conector" in g["noise"]) or "conector" in read["noise"]


def test_tails():
    t = "REsp 12.345/SP, julgado do STJ de 2019. Precedente do STF de 2020"
    kept = detect.without_tails(t, detect.chosen(detect.candidates(t)))
    assert [t[f.first : f.last] for f in kept] == ["REsp 12.345/SP", "Precedente do STF de 2020"]


def test_glued_and_scanned():
    assert numbers.acronym("agrgresp") == ("AGRG", "RESP") and numbers.acronym("resp") == ("RESP",) and numbers.acronym("xyzw") == ()
    assert numbers.acronym("re5p") == ("RESP",) and numbers.acronym("x5") == ()


def test_base_tables(spark):
    r = spark.createDataFrame([(1, "STJ", "Súmula 7\nA pretensão"), (2, None, "Art. 5º da Constituição Federal\nTodos"), (3, "STF", "Súmula Vinculante 10"), (4, None, "outro"), (5, None, None)], "canonical_id bigint, court string, text string")
    s, d, rest = base.normatives(r)
    assert sorted(map(tuple, s.collect())) == [("STF", True, 10, 3), ("STJ", False, 7, 1)] and [tuple(x) for x in d.collect()] == [("CF", "5", 2)]
    assert sorted(x.canonical_id for x in rest.collect()) == [4, 5]
    heads = spark.createDataFrame([("a", "REsp 1.234/SP\nREsp 1.234/SP " + "x" * 700 + " HC 99.999"), ("b", None)], "record_id string, text string")
    assert [tuple(x) for x in base.own_numbers(heads).collect()] == [("a", "1234", "RESP", 0)]


def test_generated_documents(spark):
    d = synth.generate(spark, 60, 1000, level=2)
    again = synth.generate(spark, 60, 1000, level=2).repartition(3)
    assert sorted(d.select("doc_id", "text").collect()) == sorted(again.select("doc_id", "text").collect())
    gold = d.select("doc_id", "text", F.inline("gold")).where(F.substr("text", F.col("first") + 1, F.col("last") - F.col("first")) != F.col("piece"))
    assert gold.count() == 0
    f = detect.detect(d.select("doc_id", "text")).select("doc_id", "first", "last", F.col("fields")["key"].alias("found"))
    j = d.select("doc_id", F.inline("gold")).join(f, ["doc_id", "first", "last"], "left")
    assert j.where("found IS NULL OR found <> key").count() == 0


def test_resolver_families(spark, sf_dir):
    t = "Súmula 7 do STJ; Súmula Vinculante 10; Súmula 99; Súmula Vinculante 10 do STJ; art. 5º da Constituição Federal; art. 6º do CPC; art. 1º da Lei 9.099; Tema 9 da repercussão geral; Precedente do STF, de 1998, Rel. Min. Customer; Autos 77777"
    f = detect.detect(spark.createDataFrame([(1, t)], "doc_id bigint, text string"))
    i = base.identifiers(base.records(spark, sf_dir))
    su = spark.createDataFrame([("STJ", False, 7, 100), ("STF", True, 10, 101)], "court string, binding boolean, number int, canonical_id bigint")
    st = spark.createDataFrame([("CF", "5", 200)], "statute string, article string, canonical_id bigint")
    got = {r.piece: (r.label, r.path, r.canonical_id, r.status) for r in resolve.resolve(f, i, su, st).collect()}
    assert got["Súmula 7 do STJ"] == ("real", "sumula:na_tabela", 100, "emitida")
    assert got["Súmula Vinculante 10"] == ("real", "sumula:na_tabela:tribunal_implicito", 101, "emitida")
    assert got["Súmula 99"][:2] == ("inventada", "sumula:fora_da_tabela:sem_tribunal")
    assert got["Súmula Vinculante 10 do STJ"][:2] == ("inventada", "sumula:fora_da_tabela:vinculante_tribunal_divergente")
    assert got["art. 5º da Constituição Federal"] == ("real", "dispositivo:na_tabela", 200, "emitida")
    assert got["art. 6º do CPC"][:2] == ("inventada", "dispositivo:fora_da_tabela") and got["art. 1º da Lei 9.099"][:2] == ("inventada", "dispositivo:diploma_fora_da_base")
    assert got["Tema 9 da repercussão geral"][:2] == ("inventada", "tema:inventada:repercussao")
    assert got["Precedente do STF, de 1998, Rel. Min. Customer"][0] == "incompleta"
    assert got["Autos 77777"] == ("inventada", "processo:0cand:amplo", None, "descartada:amplo_sem_confirmacao")


# --- contract and files ------------------------------------------------------------------


def test_contract(spark):
    docs = spark.createDataFrame([("a", "xx REsp 1 yy"), ("b", "nada")], "doc_id string, text string")
    rows = [("a", 3, 9, "REsp 1", "jurisprudencia", "real", "7", 0.9), ("a", 4, 9, "Esp 1", "jurisprudencia", "inventada", None, 2.0), ("z", 0, 1, "x", "lei", "outra", None, None)]
    s = spark.createDataFrame(rows, "doc_id string, first int, last int, piece string, kind string, label string, canonical_id string, confidence double")
    got = {(r.doc_id, r.first): r.errors for r in contract.violations(s, docs).collect()}
    assert got == {("a", 3): [], ("a", 4): ["confianca fora de [0,1]", "sobreposicao"], ("z", 0): ["documento desconhecido", "classificacao invalida"]}
    good = spans.renumber(s.where("doc_id = 'a' AND first = 3"))
    out = {r.doc_id: json.loads(r.json) for r in contract.outputs(good, docs).collect()}
    assert out["b"] == {"schema_version": "1.2", "documento_id": "b", "citacoes": []}
    assert out["a"]["citacoes"] == [{"id": "c1", "inicio": 3, "fim": 9, "trecho": "REsp 1", "tipo": "jurisprudencia", "classificacao": "real", "resolucao": {"fonte": "base", "id_canonico": "7"}, "confianca": 0.9}]
    cells = contract.cell(good, docs)
    assert {r.doc_id: r.citacoes for r in cells.collect()} == {"a": "3,9,real,7,0.9000", "b": "-"}
    assert [(r.first, r.canonical_id) for r in contract.parse_cells(cells).collect()] == [(3, "7")]
    expected = spark.createDataFrame([("a",), ("c",)], "doc_id string")
    assert sorted((r.doc_id, r.error) for r in contract.submission_errors(cells, expected).collect()) == [("b", "excedente"), ("c", "ausente")]


def test_text_folder(spark, tmp_path):
    (tmp_path / "um.txt").write_bytes("é\r\nx".encode())
    (tmp_path / "dois.TXT").write_bytes("ação".encode("cp1252"))
    (tmp_path / "tres.txt").write_bytes("é".encode() + b"\xff")
    (tmp_path / "não é%20.txt").write_bytes(b"z")
    (tmp_path / "vazio.txt").write_bytes(b"")
    (tmp_path / "outro.md").write_bytes(b"x")
    (tmp_path / ".oculto.txt").write_bytes(b"x")
    got = {r.doc_id: (r.text, r.encoding) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"um": ("é\r\nx", "utf-8"), "dois": ("ação", "cp1252"), "tres": ("é�", "utf-8-replace"), "não é%20": ("z", "utf-8"), "vazio": ("", "utf-8")}
    assert files.degraded(files.read_texts(spark, str(tmp_path))).first()[:2] == (5, 2)


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("b", 0.123456), ("a", 0.5)], "path string, confidence double")
    files.write_calibration(t, f"{tmp_path}/cal", {"n": 1})
    assert {r.path: r.confidence for r in files.read_calibration(spark, f"{tmp_path}/cal").collect()} == {"a": 0.5, "b": 0.1235}
    (tmp_path / "flat.json").write_text('{"a": 0.5, "b": "x", "c": null}')
    assert [r.path for r in files.read_calibration(spark, f"{tmp_path}/flat.json").collect()] == ["a"]
    (tmp_path / "gold.csv").write_bytes("﻿nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\r\n1,d,c1,0,4,\"a\\nb\",lei,Real,3:4\r\n".encode())
    g = files.read_gold(spark, f"{tmp_path}/gold.csv").first()
    assert (g.nivel, g.trecho, g.classificacao, g.ids) == (1, "a\nb", "real", ["3", "4"])
    r = spark.createDataFrame([("1", "x")], "key string, record_id string")
    files.write_index(r, f"{tmp_path}/index")
    assert files.read_index(spark, f"{tmp_path}/index").count() == 1
    spark.createDataFrame([(9,)], "versao int").write.mode("overwrite").parquet(f"{tmp_path}/index/meta")
    with pytest.raises(ValueError):
        files.read_index(spark, f"{tmp_path}/index")
    f = files.fingerprint(spark, f"{tmp_path}/gold.csv")
    assert [x.status for x in files.compare_fingerprints(f, f).collect()] == ["OK"]
    assert files.bundle(iter([("b", "2"), ("a", "1")])) == files.bundle(iter([("a", "1"), ("b", "2")]))
    cache = spark.createDataFrame([("k", "v")], "cache_key string, answer string")
    files.export_cache(cache, f"{tmp_path}/cache")
    assert files.import_cache(spark, f"{tmp_path}/cache").collect() == cache.collect()


# --- streams -----------------------------------------------------------------------------


def test_stream(spark, sf_dir, tmp_path):
    import datetime

    r = base.records(spark, sf_dir).limit(1).first()
    n = synth.dotted(int(r.number))
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", f"o {r.own_class} {n}/{r.state}.", at), ("b", "o HC 9.999.999/SP.", at + datetime.timedelta(minutes=15)), ("c", None, at)]
    spark.createDataFrame(rows, "doc_id string, text string, ts timestamp").write.parquet(f"{tmp_path}/in")
    owners = stream.owners_by_key(base.identifiers(base.records(spark, sf_dir)))
    v = stream.verify(stream.read_documents(spark, f"{tmp_path}/in"), owners)
    assert v.isStreaming
    stream.start(v.select("doc_id", "label", "path", "ts"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {x.doc_id: x.label for x in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": "real", "b": "inventada"}
    counts = stream.label_counts(stream.verify(spark.read.parquet(f"{tmp_path}/in"), owners))
    assert sorted((x.start.minute, x.label, x.n) for x in counts.collect()) == [(0, "real", 1), (10, "inventada", 1)]
