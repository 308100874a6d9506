"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear
softmax on that mean gives the language. Both are learned by stochastic gradient
descent in numpy. A temperature fitted on texts left out of the training makes the
scores probabilities; below a threshold chosen on the same texts a prediction is
marked as rejected.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id; what comes to the driver is bounded by ``SAMPLE * BUCKETS`` numbers. The
prediction is one pass over the whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import slices, table, text_buffers, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 13
SIZE = 16
#: Labelled rows that the fit takes at most; every fifth of them calibrates.
SAMPLE = 2000
EPOCHS, BATCH, RATE = 12, 16, 0.5
#: Share of right predictions that accepted texts are to have.
PRECISION = 0.99
UNKNOWN = "und"
SLICE_TEXT = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; worked out once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the texts' n-grams, the text of each, and each text's number of letters.

    Texts are lower-cased; a run of anything but letters is one blank. Blanks
    stand at both ends of a text; single blanks are no n-gram.
    """
    texts = [raw[off[i] : off[i + 1]].decode("utf-8", "replace").lower() for i in range(len(off) - 1)]
    code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), sizes + 1)))
    letter = _letters()[code]
    count = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[0] = True
    # of a run of blanks the first stays; a text's own blank too, so that texts don't meet
    keep[1:] |= letter[:-1]
    edge = np.concatenate(([False], owner[1:] != owner[:-1]))
    keep |= edge
    x = np.where(letter, code, 32)[keep].astype(np.uint64)
    own, is_letter = owner[keep], letter[keep]
    out, whose = [], []
    for n in ORDERS:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = own[:m] == own[n - 1 :]
        some = is_letter[:m].copy()
        for i in range(1, n):
            some |= is_letter[i : i + m]
        ok &= some
        out.append((h[ok] >> np.uint64(7)) & np.uint64(BUCKETS - 1))
        whose.append(own[:m][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(whose), count


class Model(NamedTuple):
    """``scores`` has, for each bucket, what an n-gram of it adds to each language's mean."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Learn from (language, buckets, shares); the shares of a text add up to one."""
    names = sorted({r[0] for r in rows})
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 1 / SIZE, (BUCKETS, SIZE))
    w, b = rng.normal(0, 0.1, (SIZE, len(names))), np.zeros(len(names))
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            idx = np.concatenate([rows[i][1] for i in part])
            share = np.concatenate([rows[i][2] for i in part])
            which = np.repeat(np.arange(len(part)), [len(rows[i][1]) for i in part])
            mean = np.zeros((len(part), SIZE))
            np.add.at(mean, which, emb[idx] * share[:, None])
            err = _softmax(mean @ w + b)
            err[np.arange(len(part)), y[part]] -= 1
            err /= len(part)
            back = err @ w.T
            # embeddings of rare n-grams move with their share alone, so they take a larger step
            np.subtract.at(emb, idx, 20 * rate * back[which] * share[:, None])
            w -= 20 * rate * mean.T @ err
            b -= rate * err.sum(axis=0)
    scores = emb @ w
    logits = np.array([r[2] @ scores[r[1]] for r in rows]) + b
    cal = held if held.any() else ~held
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(_softmax(logits[cal] / t)[np.arange(cal.sum()), y[cal]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits[cal] / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[cal]
    order = np.argsort(-best, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    reject = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(names, scores, b, temperature, reject)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffers(batch.column("text"))
        idx, share = [], []
        for k in range(batch.num_rows):
            h, _, _ = ngrams(data[off[k] : off[k + 1]].tobytes(), np.array([0, off[k + 1] - off[k]]))
            u, n = np.unique(h, return_counts=True)
            idx.append(u.astype(np.int32))
            share.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["h", "lang", "idx", "share"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` rows of doc_id, text and lang; rows with a null text or lang are left out."""
    d = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), "lang", "text")
    last = d.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    rows = d.where(F.col("h") <= last).mapInArrow(tidy(_features), "h bigint, lang string, idx array<int>, share array<float>").orderBy("h", "lang", "idx").limit(sample).collect()
    return fit([(r.lang, np.array(r.idx, np.int64), np.array(r.share, np.float64)) for r in rows if r.idx])


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            pred, score = [], []
            for i, j in slices(off, SLICE_TEXT):
                h, whose, letters = ngrams(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i])
                n = np.bincount(whose, minlength=j - i)
                z = np.stack([np.bincount(whose, weights=model.scores[h, k], minlength=j - i) for k in range(len(model.languages))], axis=1) if model.languages else np.zeros((j - i, 0))
                known = (letters > 0) & (len(model.languages) > 0)
                p = _softmax((z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature) if model.languages else np.zeros((j - i, 1))
                pred.append(names[np.where(known, p.argmax(axis=1), len(model.languages))])
                score.append(np.where(known, p.max(axis=1), 0.0))
            pred, score = (np.concatenate(x) if x else np.zeros(0) for x in (pred, score))
            keep = [c for c in batch.schema.names if c != "text"]
            new = [pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(score < model.reject_below)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of doc_id and text.

    A null text, one without a letter, and any text under a model without
    languages is ``und`` with score 0 and rejected unless the threshold is 0. Equal
    texts get equal results; of equal scores the first language by name counts.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_predictor(model)), "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
