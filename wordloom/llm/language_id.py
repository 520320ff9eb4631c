"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and everything that isn't a letter counts as one blank. N-grams of one to
three characters are hashed into ``WIDTH`` features. Document frequencies are counted over all
documents that may be learned from. The classifier is fitted on a bounded sample of labelled rows,
by follow-the-regularised-leader with elastic-net penalties, and its temperature is set on a fifth
of the sample that it hasn't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import calibrate, softmax, train_ftrl
from .shared import held_out, sample_rows
from .textkit import trim

WIDTH = 1 << 15
#: Rows a language that the classifier is fitted on, and languages at most.
SAMPLE_ROWS, MOST_LANGUAGES = 500, 128
_BLANK = 32
_letters: np.ndarray | None = None


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-gram counts of a text as (indices, counts); None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(_BLANK))
    c = np.concatenate([[np.uint32(_BLANK)], c[letter | np.concatenate([[False], letter[:-1]])], [np.uint32(_BLANK)]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    parts = [((x ^ (x >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> shift for x in (one, two, three)]
    count = np.bincount(np.concatenate(parts), minlength=WIDTH)
    index = np.flatnonzero(count)
    return index.astype(np.int32), count[index]


def weigh(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length."""
    value = np.log1p(count) * idf[index]
    return value / max(np.sqrt((value * value).sum()), 1e-12)


def _frequencies(batches):
    total, documents = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if (found := features(text)) is not None:
                total[found[0]] += 1
                documents += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], documents))], names=["feature", "n"])


def _sampled(batches):
    for batch in batches:
        out = [(lang, *found) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (found := features(text)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1].tobytes() for x in out], pa.binary()), pa.array([x[2].astype(np.int32).tobytes() for x in out], pa.binary())], names=["lang", "index", "count"])


def fit(docs: DataFrame) -> LanguageModel:
    """Learns from text and non-null lang of the documents that aren't held out. Without any there is no language."""
    spark = docs.sparkSession
    learn = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id"))).where("text is not null")
    counted = {r.feature: r.n for r in learn.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    documents = counted.pop(-1, 0)
    df = np.zeros(WIDTH)
    df[list(counted)] = list(counted.values())
    idf = np.log((1 + documents) / (1 + df)) + 1
    sample, languages = sample_rows(learn.where("lang is not null"), "lang", SAMPLE_ROWS, MOST_LANGUAGES)
    rows = sorted((r.lang, bytes(r["index"]), bytes(r["count"])) for r in sample.mapInArrow(_sampled, "lang string, index binary, count binary").collect())
    if not rows:
        return LanguageModel([], idf, np.zeros((WIDTH + 1, 0)), 1.0)
    order = np.random.default_rng(1).permutation(len(rows))
    y = np.array([languages.index(rows[i][0]) for i in order])
    x = [(index, weigh(index, np.frombuffer(rows[i][2], np.int32), idf)) for i in order if (index := np.frombuffer(rows[i][1], np.int32)) is not None]
    seen = len(x) - len(x) // 5
    weights = train_ftrl(x[:seen], np.eye(len(languages))[y[:seen]], WIDTH)
    logits = np.array([v @ weights[i] + weights[-1] for i, v in x[seen:]]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, calibrate(logits, y[seen:]))


def identify(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the
    model knows no language. All columns stay, except that columns of the two new names are
    replaced. Rows that repeat stay repeated; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(pred, score)
    schema = T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        m = held.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                found = features(text) if m.languages else None
                if found is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = softmax((weigh(*found, m.idf) @ m.weights[found[0]] + m.weights[-1]) / m.temperature)
                names.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
            trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred, score])

    return kept.mapInArrow(run, schema)
