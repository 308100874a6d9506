"""A seeded generator of citing documents with their gold spans.

Everything about a document follows from the seed and its number, so tasks make
them by themselves and a lost one makes the same again.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import detect, numbers

FAMILIES = ("processo", "sumula", "tema", "dispositivo", "vaga")
# Sentences around citations.
OPENINGS = ("Conforme decidido no", "Nesse sentido, o", "Veja-se o", "Como assentado no", "No mesmo rumo, o")
ENDINGS = ("nega-se provimento.", "a tese foi acolhida.", "o pedido procede.", "mantém-se a sentença.")
CLASSES = ("REsp", "HC", "Rcl", "RMS", "AgRg no REsp")
NAMES = ("Ana Costa", "Rui Silva", "José Alves", "Eva Lima")
STATUTES = ("Código Civil", "Código de Processo Civil", "Constituição Federal", "CDC")
#: Sentences with numbers that cite nothing.
TRAPS = ("Junte-se às fls. {n}.", "O valor é de R$ {n},00.", "Advogado inscrito na OAB/SP sob o nº {n}.", "O laudo de {n} de março foi anexado.", "Incide multa de {n}% ao mês.")
LOOKALIKE = {"0": "O", "1": "l", "5": "S", "8": "B"}
_SCHEMA = "doc_id string, text string, gold array<struct<first:int,last:int,piece:string,family:string,key:string,label:string,noise:array<string>>>"


def dotted(n: int) -> str:
    return f"{n:,}".replace(",", ".")


def _process(rng: random.Random, level: int, known: int, share_known: float) -> tuple[str, str, str, list[str]]:
    real = rng.random() < share_known
    n = 1_000_000 + (rng.randrange(known) if real else known + rng.randrange(1_000_000))
    written, noise = dotted(n), []
    if level > 1 and rng.random() < 0.5:
        at = [i for i, c in enumerate(written) if c in LOOKALIKE and i > 0]
        if at:
            i = rng.choice(at)
            written = written[:i] + LOOKALIKE[written[i]] + written[i + 1 :]
            noise.append("ocr")
    if level > 1 and rng.random() < 0.3:
        noise.append("conector")
        written = "nº " + written
    return f"{rng.choice(CLASSES)} {written}", str(n), "real" if real else "inventada", noise


def _other(rng: random.Random, family: str, level: int) -> tuple[str, str, str, list[str]]:
    n = rng.randint(1, 900)
    court = rng.choice(numbers.COURTS)
    if family == "sumula":
        piece, key = rng.choice((f"Súmula {n} do {court}", f"Súmula {court} nº {n}", f"Súmulas {n} e {n + 1} do {court}", f"Súmula Vinculante {n}")), str(n)
    elif family == "tema":
        piece, key = rng.choice((f"Tema {n} do {court}", f"Tema {n} da repercussão geral", f"Tema Repetitivo {n}")), str(n)
    elif family == "dispositivo":
        statute = rng.choice(STATUTES)
        of = "da" if statute.startswith("Cons") else "do"
        piece, key = rng.choice((f"art. {n} {of} {statute}", f"arts. {n} e {n + 1} {of} {statute}", f"art. {n}, caput, {of} {statute}")), str(n)
    else:
        year, name = 1990 + n % 30, rng.choice(NAMES)
        piece, key = rng.choice((f"precedente do {court} de {year}, Rel. Min. {name}", f"acórdão relatado pelo Ministro {name}, do {court}, em {year}")), str(year)
    noise = []
    if level > 1 and rng.random() < 0.2:
        at = piece.find(" ")
        piece, noise = piece[:at] + "\xa0" + piece[at + 1 :], ["espaco_duro"]
    return piece, key, "incompleta" if family == "vaga" else "inventada", noise


def document(seed: int, number: int, level: int, known: int, share_known: float = 0.6, families: tuple[str, ...] = ("processo",)) -> tuple[str, str, list[dict]]:
    """One document: numbers from 1000000 on and under 1000000 + known are in the base."""
    rng = random.Random(f"{seed}:{level}:{number}")
    text = f"TRIBUNAL DE JUSTIÇA\nAutos {rng.randrange(10**6)}\n\nTrata-se de recurso interposto contra a sentença que julgou o pedido do autor.\n"
    gold = []
    for _ in range(rng.randint(1, 6)):
        family = rng.choice(families) if len(families) > 1 else families[0]
        piece, key, label, noise = _process(rng, level, known, share_known) if family == "processo" else _other(rng, family, level)
        text += rng.choice(OPENINGS) + " "
        gold.append({"first": len(text), "last": len(text) + len(piece), "piece": piece, "family": family, "key": key, "label": label, "noise": noise})
        text += piece + ", " + rng.choice(ENDINGS) + "\n"
        if len(families) > 1 and rng.random() < 0.3:
            text += rng.choice(TRAPS).format(n=rng.randint(1, 31)) + "\n"
    return f"sin_n{level}_{number:06d}", text, gold


def generate(spark: SparkSession, n_docs: int, known: int, level: int = 1, seed: int = 7, families: tuple[str, ...] = ("processo",)) -> DataFrame:
    """doc_id, text, gold of ``n_docs`` documents; equal arguments give equal rows, whatever the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document(seed, i, level, known, families=families) for i in b.column("id").to_pylist()]
            item = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("piece", pa.string()), ("family", pa.string()), ("key", pa.string()), ("label", pa.string()), ("noise", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(item))], ["doc_id", "text", "gold"])

    return spark.range(n_docs).mapInArrow(run, _SCHEMA)


def trap(seed: int, number: int) -> str:
    """A text with numbers of many kinds and no citation."""
    rng = random.Random(f"trap:{seed}:{number}")
    return "\n".join(rng.choice(TRAPS).format(n=rng.randint(1, 99_999)) for _ in range(rng.randint(1, 8)))


def mock_answers(window: str) -> list[dict[str, str]]:
    """What a stand-in for a model points at: the strong process citations of a window, as records of fields."""
    return [{"family": "processo", "piece": window[f.first : f.last], **f.fields} for f in detect.processes(window) if f.strength == detect.SURE and f.fields["key"]]


def catalogue(piece: str) -> dict[str, str | list[str]]:
    """A gold span read by itself: family, key, chain, and the noises that its writing shows."""
    found = detect.chosen(detect.candidates(piece))
    noise = [name for name, pattern in (("espaco_duro", "\xa0"), ("quebra", "\n"), ("hifen_quebrado", r"-\s*\n"), ("conector", r"(?i)\bn(?:[º°.]|um)"), ("pontuado", r"\d\.\d{3}"), ("espacado", r"\d \d{3}")) if re.search(pattern, piece)]
    letters = any(f.fields.get("letters", "0") != "0" for f in found)
    first = found[0] if found else None
    return {"family": first.family if first else "", "key": (first.fields.get("key") or first.fields.get("number") or first.fields.get("article") or first.fields.get("year") or "") if first else "", "noise": [*noise, *(["ocr"] if letters else [])]}
