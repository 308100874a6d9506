"""The label of every found citation: one cascade of columns for each family, over joins with the base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import inferred_court
from quillspan.operators import lookup

#: Wide findings weaker than this that the base doesn't confirm are put aside.
LEAST = 0.7


def _field(name: str) -> Column:
    return F.nullif(F.col("fields")[name], F.lit(""))


def _finish(df: DataFrame, found: list[str], label: Column, path: Column, canonical: Column) -> DataFrame:
    return df.select(*found, label.alias("label"), path.alias("path"), F.when(label == "real", canonical).alias("canonical_id"))


def processes(found: DataFrame, identifiers: DataFrame) -> DataFrame:
    """By the owners of the key; an unreadable key with look-alikes is ambiguous, without an owner."""
    c = found.withColumns({"key": F.coalesce(F.col("fields")["key"], F.lit("")), "cited_class": _field("cls"), "state": _field("uf"), "court": _field("court")})
    c = c.withColumn("inferred", inferred_court(F.col("cited_class"), F.col("key")))
    d = lookup.classify(lookup.owners(c, identifiers))
    lost = (F.col("key") == "") & (F.col("fields")["letters"] != "0")
    path = F.when(lost, "processo:0cand:ocr_ambiguo").when((F.col("path") == "processo:0cand") & (F.col("fields")["letters"].cast("int") >= 2), "processo:0cand:ocr_sem_dono").otherwise(F.col("path"))
    return _finish(d, found.columns, F.col("label"), path, F.col("canonical_id"))


def sumulas(found: DataFrame, table: DataFrame) -> DataFrame:
    """Against (court, binding, number, canonical_id); a binding one is the STF's; without a court the number must be unique."""
    said, binding = _field("court"), F.col("fields")["binding"] == "1"
    c = found.withColumns({"_said": said, "_binding": binding, "_number": _field("number"), "_court": F.when(binding, F.lit("STF")).otherwise(said)})
    t = table.select(F.col("court").alias("_court"), F.col("binding").alias("_binding"), F.col("number").cast("string").alias("_number"), "canonical_id")
    j = lookup.composite(c, t, "_court", ["_binding", "_number"], "canonical_id")
    other = t.select("_binding", "_number").distinct().withColumn("_known", F.lit(True))
    j = j.join(other, ["_binding", "_number"], "left")
    hit, clash = F.col("canonical_id").isNotNull(), F.col("_binding") & F.col("_said").isNotNull() & (F.col("_said") != "STF")
    path = (
        F.when(F.col("_number").isNull(), "sumula:sem_numero").when(clash, "sumula:fora_da_tabela:vinculante_tribunal_divergente")
        .when(hit & F.col("_court").isNull(), "sumula:na_tabela:sem_tribunal").when(hit & F.col("_said").isNull(), "sumula:na_tabela:tribunal_implicito").when(hit, "sumula:na_tabela")
        .when(F.col("_court").isNull(), "sumula:fora_da_tabela:sem_tribunal").when(F.col("_known"), "sumula:fora_da_tabela:tribunal_divergente").otherwise("sumula:fora_da_tabela")
    )
    path = F.when((F.col("fields")["letters"] != "0") & ~path.endswith("sem_numero"), F.concat(path, F.lit(":ocr"))).otherwise(path)
    label = F.when(F.col("_number").isNull(), "incompleta").when(clash | ~hit, "inventada").otherwise("real")
    return _finish(j, found.columns, label, path, F.col("canonical_id"))


def statutes(found: DataFrame, table: DataFrame) -> DataFrame:
    """Against (statute, article, canonical_id); laws by number are outside the base."""
    c = found.withColumns({"_statute": _field("statute"), "_article": _field("article")})
    t = table.select(F.col("statute").alias("_statute"), F.regexp_replace(F.col("article").cast("string"), r"^0+|\.", "").alias("_article"), "canonical_id")
    j = c.join(t, ["_statute", "_article"], "left")
    hit = F.col("canonical_id").isNotNull()
    path = (
        F.when(F.col("_article").isNull(), "dispositivo:sem_artigo").when(F.col("_statute").isNull(), "dispositivo:sem_diploma")
        .when(F.col("_statute").rlike("^(LEI|DL|LC)-"), "dispositivo:diploma_fora_da_base").when(hit, "dispositivo:na_tabela")
        .when(F.col("_statute") == "OUTRO", "dispositivo:fora_da_tabela:diploma_outro").otherwise("dispositivo:fora_da_tabela")
    )
    label = F.when(F.col("_article").isNull() | F.col("_statute").isNull(), "incompleta").when(hit & ~F.col("_statute").rlike("^(LEI|DL|LC)-"), "real").otherwise("inventada")
    return _finish(j, found.columns, label, path, F.col("canonical_id"))


def themes(found: DataFrame) -> DataFrame:
    """The base has no themes: all are made up; the path tells their form."""
    sub = F.when(F.endswith("origin", F.lit(":sem_complemento")), "solto").when(F.col("fields")["court"] == "STJ", "repetitivo").otherwise("repercussao")
    return _finish(found, found.columns, F.lit("inventada"), F.concat(F.lit("tema:inventada:"), sub), F.lit(None).cast("bigint"))


def vague(found: DataFrame, records: DataFrame) -> DataFrame:
    """Court, year and rapporteur identify nothing alone: always incomplete; the path tells how many records fit.

    Different (court, year, name) triples are few, so they are counted once each,
    by an equi-join on the year.
    """
    c = found.withColumns({"court": _field("court"), "year": F.col("fields")["year"].try_cast("int"), "_name": _field("rapporteur")})
    asked = c.select("court", "year", "_name").distinct().withColumn("cid", F.xxhash64("court", "year", "_name"))
    words = F.filter(F.split(F.lower(F.coalesce("_name", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin("de", "da", "do", "dos", "das", "e"))
    n = lookup.by_rapporteur(asked.select("cid", "court", "year", words.alias("words")).where("year IS NOT NULL"), records)
    j = c.withColumn("cid", F.xxhash64("court", "year", "_name")).join(n, "cid", "left")
    many = F.coalesce("n", F.lit(0))
    sub = F.when(F.col("_name").isNull(), "sem_relator").when(many == 0, "0cand").when(many == 1, "1cand").otherwise("multi")
    return _finish(j, found.columns, F.lit("incompleta"), F.concat(F.lit("vaga:"), sub), F.lit(None).cast("bigint"))


def mark_wide(decided: DataFrame) -> DataFrame:
    """Paths of wide findings end with :amplo; weak ones that the base doesn't confirm get status descartada."""
    wide = F.col("strength") < 1
    confirmed = F.col("label") == "real"
    status = F.when(wide & (F.col("strength") < LEAST) & ~confirmed, "descartada:amplo_sem_confirmacao").otherwise("emitida")
    return decided.withColumns({"status": status, "path": F.when(wide, F.concat("path", F.lit(":amplo"))).otherwise(F.col("path"))})


def resolve(found: DataFrame, identifiers: DataFrame, sumula_table: DataFrame, statute_table: DataFrame) -> DataFrame:
    """``found`` with label, path, canonical_id and status: each family by its own cascade, put together again."""
    of = lambda f: found.where(F.col("family") == f)
    parts = [processes(of("processo"), identifiers), sumulas(of("sumula"), sumula_table), themes(of("tema")), statutes(of("dispositivo"), statute_table), vague(of("vaga"), identifiers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return mark_wide(out)

