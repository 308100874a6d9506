"""Queries that hold the citation operators against SQL: texts are rendered from rows, found again, and compared with what SQL knows was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import arbiter, audit, base, detect, distractors, evaluation, lookup, numbers, synth
from quillspan.operators.base import table
from quillspan.plans.catalogue import judged, query

_START = "Conforme o "
#: Writings of a process citation: before the number, how the number stands, after it; the chain, court and state that they mean.
PROCESS_FORMS = (
    ("REsp ", "dotted", "/SP", "RESP", "", "SP"), ("Rec. Esp. n. ", "dotted", " (SC)", "RESP", "", "SC"), ("AgRg no REsp nº ", "plain", "-RJ", "AGRG RESP", "", "RJ"), ("AgRgREsp ", "dotted", "/SP", "AGRG RESP", "", "SP"),
    ("Agravo de Instrumento nº ", "court", "", "AI", "", ""), ("TST-RR-", "court", "", "RR", "TST", ""), ("Recurso em Habeas Corpus nº ", "spaced", "/MG", "RHC", "", "MG"), ("H.C. Nº ", "plain", " (BA)", "HC", "", "BA"),
    ("RE5P ", "dotted", "", "RESP", "", ""), ("EDcl nos EDcl no AgRg no AREsp ", "comma", "/PE", "EDCL EDCL AGRG ARESP", "", "PE"), ("Suspensão de Liminar e de Sentença nº ", "dotted", "/CE", "SLS", "", "CE"), ("A.REsp\n ", "spaced", " (SP)", "ARESP", "", "SP"),
)


def _grouped(n: Column, mark: str) -> Column:
    return F.reverse(F.regexp_replace(F.reverse(n), "([0-9]{3})(?=[0-9])", f"$1{mark}"))


def _written(n: Column, how: str) -> Column:
    if how == "court":
        return F.concat(F.lpad(n, 7, "0"), F.lit("-12.2011.5.15.0099"))
    if how == "comma":  # the last separator is read as a comma
        return F.regexp_replace(_grouped(n, "."), r"\.([0-9]{3})$", ",$1")
    return {"dotted": _grouped(n, "."), "spaced": _grouped(n, " "), "plain": n}[how]


def _case(forms: tuple, pick) -> Column:
    out = F.lit(None)
    for i, f in enumerate(forms):
        out = F.when(F.col("k") == i, pick(f)).otherwise(out)
    return out


def _sql_case(forms: tuple, pick) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {pick(f)}" for i, f in enumerate(forms)) + " END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_grouped(mark: str) -> str:
    return f"reverse(regexp_replace(reverse(n), '([0-9]{{3}})([0-9]{{1,3}})([0-9]{{0,3}})$', '\\1{mark}\\2' || CASE WHEN length(n) > 6 THEN '{mark}' ELSE '' END || '\\3'))"


_HOW = {
    "court": "lpad(n, 7, '0') || '-12.2011.5.15.0099'", "plain": "n", "dotted": _sql_grouped("."), "spaced": _sql_grouped(" "),
    "comma": f"regexp_replace({_sql_grouped('.')}, '\\.([0-9]{{3}})$', ',\\1')",
}
_ORDER_FORMS = f"(SELECT o_orderkey, o_orderkey % {len(PROCESS_FORMS)} AS k, CAST(o_orderkey + {base.FIRST_NUMBER} AS VARCHAR) AS n FROM orders)"


def _orders(spark: SparkSession, sf_dir: str, many: int) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % many).alias("k"), (F.col("o_orderkey") + base.FIRST_NUMBER).cast("string").alias("n"))


def _found(rows: DataFrame, family: str, fields: list[str]) -> DataFrame:
    f = detect.detect(rows.select("o_orderkey", "text")).where(F.col("family") == family)
    return f.select("o_orderkey", "first", "last", "origin", *[F.coalesce(F.col("fields")[x], F.lit("")).alias(x) for x in fields])


@query(f"""SELECT o_orderkey, {len(_START)}::INT AS first, ({len(_START)} + length(piece))::INT AS last, 'regex:processo' AS origin, CASE WHEN how = 'court' THEN lpad(n, 7, '0') || '1220115150099' ELSE n END AS key, chain, court, uf
 FROM (SELECT o_orderkey, k, n, {_sql_case(PROCESS_FORMS, lambda f: f"{_quoted(f[0])} || {_HOW[f[1]]} || '{f[2]}'")} AS piece, {_sql_case(PROCESS_FORMS, lambda f: _quoted(f[1]))} AS how,
 {_sql_case(PROCESS_FORMS, lambda f: _quoted(f[3]))} AS chain, {_sql_case(PROCESS_FORMS, lambda f: _quoted(f[4]))} AS court, {_sql_case(PROCESS_FORMS, lambda f: _quoted(f[5]))} AS uf FROM {_ORDER_FORMS})""")
def process_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and chains in twelve writings: dotted, spaced, glued, scanned, court form."""
    o = _orders(spark, sf_dir, len(PROCESS_FORMS))
    text = F.concat(F.lit(_START), _case(PROCESS_FORMS, lambda f: F.concat(F.lit(f[0]), _written(F.col("n"), f[1]), F.lit(f[2]))), F.lit(", nega-se provimento."))
    return _found(o.withColumn("text", text), "processo", ["key", "chain", "court", "uf"])


#: Writings of other families: a text with {n} for a number, what of it is the citation, and its fields.
SUMULA_FORMS = (
    ("Aplicam-se as Súmulas {n} e 456 do STJ ao caso.", "Súmulas {n} e 456 do STJ", "STJ", "456", "0"), ("Incidem as Súmulas {n}/TST e 123/STJ, que afastam.", "Súmulas {n}/TST e 123/STJ", "TST", "123", "0"),
    ("Ver as Súmulas {n}, 34 e 56 do STF, nada.", "Súmulas {n}, 34 e 56 do STF", "STF", "34,56", "0"), ("Ver o verbete {n} da súmula do TSE.", "verbete {n} da súmula do TSE", "TSE", "", "0"),
    ("Ver a Súmula STJ nº {n} no ponto.", "Súmula STJ nº {n}", "STJ", "", "0"), ("Ver a súmula vinculante {n} aqui.", "súmula vinculante {n}", "", "", "1"), ("Conforme Súrnula {n} do STM.", "Súrnula {n} do STM", "STM", "", "0"),
)
STATUTE_FORMS = (
    ("Aplicam-se os arts. {n} e 12, ambos da Constituição Federal ao caso.", "arts. {n} e 12, ambos da Constituição Federal", "CF"), ("Aplica-se o art. {n} c/c o art. 1.022, ambos do CPC ao caso.", "art. {n} c/c o art. 1.022, ambos do CPC", "CPC"),
    ("Veja-se o disposto nos artigos {n}, 12 e 13 do Código Civil.", "artigos {n}, 12 e 13 do Código Civil", "CC"), ("Aplica-se o art. {n} da Lei Federal nº 8.078/1990 ao caso.", "art. {n} da Lei Federal nº 8.078/1990", "CDC"),
    ("Nesse sentido é o art. {n}, caput, CPC, que dispõe.", "art. {n}, caput, CPC", "CPC"), ("Aplica-se o art. {n} do C.D.C. ao caso.", "art. {n} do C.D.C.", "CDC"), ("Veja o art {n} CF que dispõe.", "art {n} CF", "CF"),
    ("Invoca-se o artlgo {n} do Código Penal, como se vê.", "artlgo {n} do Código Penal", "CP"),
)
VAGUE_FORMS = (
    ("Veja-se o precedente do STJ de {n}, Rel. Min. Ana Costa.", "precedente do STJ de {n}, Rel. Min. Ana Costa", "STJ", "Ana Costa"), ("Como no STF, Rel. Min. Rui Silva, j. em {n}.", "STF, Rel. Min. Rui Silva, j. em {n}", "STF", "Rui Silva"),
    ("Há acórdão relatado pelo Ministro José Alves, do TST, em {n}.", "acórdão relatado pelo Ministro José Alves, do TST, em {n}", "TST", "José Alves"), ("Veja-se o julgado do TSE (Rel. Min. Eva Lima, DJ {n}).", "julgado do TSE (Rel. Min. Eva Lima, DJ {n})", "TSE", "Eva Lima"),
    ("Veja-se a decisão de {n}, Rel. Min. Ivo Reis, do STM.", "decisão de {n}, Rel. Min. Ivo Reis, do STM", "STM", "Ivo Reis"),
)


def _numbered(text: str) -> Column:
    a, b = text.split("{n}")
    return F.concat(F.lit(a), "n", F.lit(b))


def _sql_numbered(text: str) -> str:
    a, b = text.split("{n}")
    return f"{_quoted(a)} || n || {_quoted(b)}"


def _form_sql(forms: tuple, number: str, columns: dict[int, str], more: str = "") -> str:
    fields = ", ".join(f"{_sql_case(forms, lambda f, i=i: _quoted(f[i]))} AS {name}" for i, name in columns.items())
    inner = f"SELECT o_orderkey, o_orderkey % {len(forms)} AS k, CAST({number} AS VARCHAR) AS n FROM orders"
    return f"""SELECT o_orderkey, n AS number, (instr(t, p) - 1)::INT AS first, (instr(t, p) - 1 + length(p))::INT AS last, {', '.join(columns.values())}{more}
 FROM (SELECT *, {_sql_case(forms, lambda f: _sql_numbered(f[0]))} AS t, {_sql_case(forms, lambda f: _sql_numbered(f[1]))} AS p, {fields} FROM ({inner}))"""


def _form_rows(spark: SparkSession, sf_dir: str, forms: tuple, number: Column) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(forms)).alias("k"), number.cast("string").alias("n"))
    return o.withColumn("text", _case(forms, lambda f: _numbered(f[0])))


@query(_form_sql(SUMULA_FORMS, "o_orderkey % 800 + 1", {2: "court", 3: "enumeracao", 4: "binding"}))
def sumula_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _form_rows(spark, sf_dir, SUMULA_FORMS, F.col("o_orderkey") % 800 + 1)
    return _found(rows, "sumula", ["number", "court", "enumeracao", "binding"]).drop("origin")


@query(_form_sql(STATUTE_FORMS, "o_orderkey % 900 + 1", {2: "statute"}))
def statute_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _form_rows(spark, sf_dir, STATUTE_FORMS, F.col("o_orderkey") % 900 + 1)
    return _found(rows, "dispositivo", ["article", "statute"]).drop("origin").withColumnRenamed("article", "number")


@query(_form_sql(VAGUE_FORMS, "1990 + o_orderkey % 30", {2: "court", 3: "rapporteur"}))
def vague_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _form_rows(spark, sf_dir, VAGUE_FORMS, F.lit(1990) + F.col("o_orderkey") % 30)
    return _found(rows, "vaga", ["year", "court", "rapporteur"]).drop("origin").withColumnRenamed("year", "number")


@query(f"SELECT o_orderkey, 'REsp ' || {_HOW['dotted']} || '/' || ['AC', 'AL', 'AP'][(o_orderkey % 3)::INT + 1] AS form, n AS key, true AS spelled FROM {_ORDER_FORMS}")
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical writings from fields, read again: the key comes back, and the class is proven to stand in the span."""
    o = _orders(spark, sf_dir, 1).withColumn("uf", F.get(F.array(*map(F.lit, ("AC", "AL", "AP"))), (F.col("o_orderkey") % 3).cast("int")))

    @F.pandas_udf("form string, key string, spelled boolean")
    def written(n, uf):
        import pandas as pd

        forms = [numbers.canonical({"family": "processo", "cls": "RESP", "chain": "REsp", "key": a, "uf": b}) for a, b in zip(n, uf, strict=True)]
        return pd.DataFrame({"form": forms, "key": [numbers.identifier(x) for x in forms], "spelled": [numbers.spells(x, ("RESP",)) for x in forms]})

    return o.select("o_orderkey", written("n", "uf").alias("w")).select("o_orderkey", "w.*")


@query(f"SELECT o_orderkey, n || ',' || lpad(n, 7, '0') || '1220115150099' AS keys FROM {_ORDER_FORMS}")
def numbers_in_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different numbers of a text in order of first occurrence; one that can't be read whole has no key."""
    o = _orders(spark, sf_dir, 1)
    text = F.concat(F.lit("Vide "), _grouped(F.col("n"), "."), F.lit(" e "), F.lpad("n", 7, "0"), F.lit("-12.2011.5.15.0099, de novo "), F.col("n"), F.lit(", item 12 e 1.23.4567-8."))

    @F.pandas_udf("string")
    def read(t):
        return t.map(lambda x: ",".join(numbers.keys_in_order(x)))

    return o.select("o_orderkey", read(text).alias("keys"))


#: What stands before and after a wide finding, and why it is none.
CONTEXTS = (("às fls. ", ".", "folha"), ("no valor de R$ ", ".", "valor"), ("com ", "% ao mês.", "percentual"), ("na OAB/SP nº ", ".", "registro_oab"), ("em ", "/2019.", "data"), ("no protocolo ", ".", "protocolo"), ("conforme ", " acima.", None))


@query(f"""SELECT o_orderkey, {_sql_case(CONTEXTS, lambda f: "NULL" if f[2] is None else _quoted(f[2]))} AS reason FROM (SELECT o_orderkey, o_orderkey % {len(CONTEXTS)} AS k FROM orders)
 UNION ALL SELECT o_orderkey + 1000000000, 'numero_do_cabecalho' FROM orders""")
def distractor_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context rules around wide findings, and numbers that the header has."""
    o = _orders(spark, sf_dir, len(CONTEXTS))
    body = "o autor apresentou recurso tempestivo contra a decisão e pediu a reforma do julgado, "
    text = F.concat(F.lit(body), _case(CONTEXTS, lambda f: F.lit(f[0])), F.col("n"), _case(CONTEXTS, lambda f: F.lit(f[1])))
    first = (F.lit(len(body)) + F.length(_case(CONTEXTS, lambda f: F.lit(f[0])))).cast("int")
    a = o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), first.alias("first"), "n")
    own = F.concat(F.lit("Autos "), "n", F.lit("\n" + body + "vide "), "n", F.lit(" acima."))
    b = o.select((F.col("o_orderkey") + 1_000_000_000).alias("doc_id"), own.alias("text"), (F.lit(12 + len(body)) + F.length("n")).cast("int").alias("first"), "n")
    both = a.unionByName(b)
    spans_ = both.select("doc_id", "first", (F.col("first") + F.length("n")).cast("int").alias("last"), F.lit("regex:processo:amplo").alias("origin"))
    return distractors.reasons(spans_, both.select("doc_id", "text")).select(F.col("doc_id").alias("o_orderkey"), "reason")


_SPANS_OF_TEXT = "SELECT doc_id, (doc_id % 50 - 5)::INT AS first, (doc_id % 50 - 5 + doc_id % 9)::INT AS last FROM documents"


@query(f"SELECT s.doc_id, first, last, substr(d.text, first + 1, last - first) AS piece FROM ({_SPANS_OF_TEXT}) s JOIN documents d ON s.doc_id = d.doc_id WHERE first >= 0 AND last > first AND last <= length(d.text)")
def valid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = (F.col("doc_id") % 50 - 5).cast("int")
    return distractors.valid(d.select("doc_id", first.alias("first"), (first + (F.col("doc_id") % 9).cast("int")).alias("last")), d.select("doc_id", "text")).select("doc_id", "first", "last", "piece")


_CLASSES = "['real', 'inventada', 'incompleta']"
_TRACED = f"""SELECT l_orderkey AS d, l_linenumber AS f, {_CLASSES}[(l_partkey % 3)::INT + 1] AS c, 'processo:' || l_returnflag AS p, round((l_suppkey % 100) / 100.0, 2)::DOUBLE AS conf, l_partkey % 7 AS i FROM lineitem"""
_GOLDEN = f"SELECT l_orderkey AS d, l_linenumber AS f, {_CLASSES}[(l_suppkey % 3)::INT + 1] AS g, l_suppkey % 7 AS j FROM lineitem WHERE l_linenumber % 3 > 0"


def _trace_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    label = lambda c: F.get(F.array(*map(F.lit, evaluation.LABELS)), (F.col(c) % 3).cast("int"))
    at = [F.col("l_orderkey").cast("string").alias("documento_id"), F.col("l_linenumber").cast("int").alias("inicio"), (F.col("l_linenumber") + 5).cast("int").alias("fim")]
    trace = l.select(*at, label("l_partkey").alias("classificacao"), (F.col("l_partkey") % 7).cast("string").alias("id_canonico"), F.concat(F.lit("processo:"), "l_returnflag").alias("caminho"), F.round((F.col("l_suppkey") % 100) / 100, 2).alias("confianca"))
    gold = l.where("l_linenumber % 3 > 0").select(*at, label("l_suppkey").alias("classificacao"), F.array((F.col("l_suppkey") % 7).cast("string")).alias("ids"))
    return evaluation.trace_with_gold(trace, gold)


@query(f"SELECT CAST(d AS VARCHAR) AS documento_id, f::INT AS inicio, p AS caminho, conf AS confianca, c = g AND (g <> 'real' OR i = j) AS ok FROM ({_TRACED}) JOIN ({_GOLDEN}) USING (d, f)")
def trace_gold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace_and_gold(spark, sf_dir).drop("fim")


@query(f"""SELECT p AS caminho, count(*) AS n, count(*) FILTER (ok) AS ok, round(avg(pow(conf - ok::INT, 2)), 6) AS brier, round(avg(conf), 6) AS confidence, round(count(*) FILTER (ok) / count(*), 6) AS accuracy
 FROM (SELECT p, conf, c = g AND (g <> 'real' OR i = j) AS ok FROM ({_TRACED}) JOIN ({_GOLDEN}) USING (d, f)) GROUP BY p""")
def path_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = evaluation.by_path(_trace_and_gold(spark, sf_dir))
    return a.withColumns({c: F.round(c, 6) for c in ("brier", "confidence", "accuracy")})


@query()
def pair_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pair_census(judged(spark, sf_dir).withColumn("confidence", F.lit(0.5)))


@query("""SELECT event_type AS operation, count(*) AS n, count(a) AS answered, count(*) - count(a) AS abstained, round(count(*) FILTER (e IS NOT DISTINCT FROM a) / count(*), 6) AS accuracy,
 round(count(*) FILTER (a IS NOT NULL AND e IS NOT DISTINCT FROM a) / nullif(count(a), 0), 6) AS precision, round(avg(s), 6) AS seconds
 FROM (SELECT event_type, CASE WHEN user_id % 5 > 0 THEN user_id % 4 END AS e, CASE WHEN event_id % 3 > 0 THEN user_id % 4 END AS a, (event_id % 10) / 10.0 AS s FROM events) GROUP BY 1""")
def arbiter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user = table(spark, sf_dir, "events"), F.col("user_id") % 4
    c = e.select(F.col("event_type").alias("operation"), F.when(F.col("user_id") % 5 > 0, user).alias("expected"), F.when(F.col("event_id") % 3 > 0, user).alias("answer"), (F.col("event_id") % 10 / 10).alias("seconds"))
    return evaluation.arbiter_metrics(c).withColumns({x: F.round(x, 6) for x in ("accuracy", "precision", "seconds")})


_RUNS = f"""SELECT coalesce(a.g, b.g) AS g, a.p AS pa, b.p AS pb, coalesce(b.x, false) AS x FROM (SELECT l_orderkey AS d, l_linenumber AS f, {_CLASSES}[(l_suppkey % 3)::INT + 1] AS g, {_CLASSES}[(l_suppkey % 3)::INT + 1] AS p FROM lineitem WHERE l_linenumber < 5) a
 FULL JOIN (SELECT l_orderkey AS d, l_linenumber AS f, {_CLASSES}[(l_suppkey % 3)::INT + 1] AS g, {_CLASSES}[(CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_suppkey END % 3)::INT + 1] AS p, l_linenumber >= 5 AS x FROM lineitem) b USING (d, f)"""


@query(f"""SELECT count(*) FILTER (g = 'inventada' AND pa IS DISTINCT FROM 'real' AND pb = 'real') AS made_up_to_real, count(*) FILTER (pa IS NOT NULL AND pb IS NULL) AS lost, count(*) FILTER (x) AS extracted, count(*) FILTER (x AND g = pb) AS extracted_right,
 0.05::DOUBLE AS delta, round(count(*) FILTER (x AND g = pb) / count(*) FILTER (x), 6) AS precision, 'MANTER DESLIGADO' AS verdict FROM ({_RUNS})""")
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    label = lambda c: F.get(F.array(*map(F.lit, evaluation.LABELS)), (c % 3).cast("int"))
    at = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + 1).alias("last"), label(F.col("l_suppkey")).alias("gold")]
    core = l.where("l_linenumber < 5").select(*at, label(F.col("l_suppkey")).alias("pred"))
    other = l.select(*at, label(F.when(F.col("l_partkey") % 11 == 0, F.lit(0)).otherwise(F.col("l_suppkey"))).alias("pred"), (F.col("l_linenumber") >= 5).alias("extracted"))
    return evaluation.run_verdict(core, other, 0.8, 0.85).withColumn("precision", F.round("precision", 6))


@query("""WITH c AS (SELECT l_orderkey AS cid, l_suppkey AS r, CASE WHEN l_orderkey % 2 = 0 THEN min(l_suppkey) OVER (PARTITION BY l_orderkey) % 4 END AS g FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)), o AS (SELECT s_suppkey AS r, s_nationkey % 4 AS g FROM supplier),
 x AS (SELECT c.cid, c.r, c.g, o.r IS NOT NULL AS own FROM c LEFT JOIN o ON c.r = o.r AND c.g = o.g) SELECT cid, r AS record_id FROM (SELECT *, bool_or(own) OVER (PARTITION BY cid) AS sm FROM x) WHERE g IS NULL OR NOT sm OR own""")
def registry_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cid"), F.col("l_suppkey").alias("record_id")).distinct()  # noqa: E741
    said = F.when(F.col("cid") % 2 == 0, F.min("record_id").over(Window.partitionBy("cid")) % 4)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), (F.col("s_nationkey") % 4).cast("bigint").alias("key"))
    return lookup.owning_both(l.withColumn("registry", said.cast("bigint")), own).select("cid", "record_id")


_KEYED = "SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+')) AS word FROM documents WHERE lang = '{}'"


@query(f"""WITH a AS (SELECT word FROM ({_KEYED.format("de")}) WHERE length(word) >= 4), b AS (SELECT word FROM ({_KEYED.format("fr")}) WHERE length(word) >= 4), c AS (SELECT word FROM ({_KEYED.format("en")}) WHERE length(word) >= 4)
 SELECT word, 'fechada' AS kind FROM a WHERE word NOT IN (SELECT word FROM c) UNION ALL SELECT word, 'so_ocr' FROM b WHERE word NOT IN (SELECT word FROM a UNION SELECT word FROM c)""")
def forbidden_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return audit.forbidden_words(*(d.where(F.col("lang") == x) for x in ("de", "fr", "en")))


@query("SELECT doc_id, count(DISTINCT part) AS n FROM (SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 2 = 0 THEN 'train' ELSE 'validate' END AS part FROM (SELECT DISTINCT doc_id FROM labels)) GROUP BY doc_id HAVING count(DISTINCT part) > 1")
def holdout_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.disjoint(evaluation.holdout(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "doc_id")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, n_docs = table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "documents").count()
    return synth.generate(spark, n_docs, known, level=2, families=synth.FAMILIES)


@query()
def arbiter_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by operation from the gold of generated documents."""
    return arbiter.cases(_generated(spark, sf_dir)).groupBy("operation").agg(F.count("*").alias("n"), F.count("expected").alias("with_answer"))


@query()
def extracted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stage: what an answering function points at in the windows that detection left, found again and joined with the first stage."""
    d = _generated(spark, sf_dir).select("doc_id", "text")
    first = detect.detect(d, families=("sumula", "tema"))
    more = arbiter.extract(d, first, synth.mock_answers)
    both = arbiter.with_extracted(first, more)
    return both.groupBy("family", F.split("origin", ":")[0].alias("by")).agg(F.count("*").alias("n"))
