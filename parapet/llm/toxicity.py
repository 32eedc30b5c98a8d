"""Operator 3: toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are the hashed character 4- to 6-grams it holds (each once). Every feature is
scaled by its naive Bayes log-count ratio between toxic and clean texts, and a logistic regression
is trained on the scaled features. Scoring adds up one weight for each distinct n-gram.

The classifier is fitted on a bounded sample (ROWS documents, SIZE bytes) of the labelled rows
outside the held-out fold; all documents are scored.

Cases: null and empty texts have no n-gram and get the score of the intercept; without labels of
both classes all scores are 0.5 or the share of the one class seen; an id with several labels has the
greatest; an empty table gives an empty result; repeated rows and ties score alike; a very long text is
scored whole, in a block by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import labelled
from parapet.llm.shared import fold, mapped, table
from parapet.llm.words import _BYTE, LOWER, SPACE, U64, _power, blocks, give_back, mix

ORDERS = (4, 5, 6)
BITS = 20
#: Bounds of the training sample.
ROWS, SIZE = 4000, 16 << 20
#: Standard errors by which a feature's log-count ratio must differ from 0.
SURE = 4.0
#: Bytes of text worked on at once in fitting, which the driver does.
FIT_BYTES = 256 << 10
FOLDS = 5

FOLDED = LOWER.copy()
FOLDED[SPACE] = 0x20


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct hashed n-gram of each document, in order of both; only buckets where keep is true."""
    data = FOLDED[data]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.append(begins, len(data))
    doc = np.searchsorted(offsets, begins, "right") - 1
    keys = []
    for n in ORDERS:
        if len(begins) < n:
            continue
        lo, hi = edges[: len(begins) - n + 1], edges[n:]
        within = doc[: len(lo)] == doc[n - 1 :]
        h = mix((total[hi] - total[lo]) * down[lo] + U64(n))
        bucket = (h >> U64(64 - BITS)).astype(np.int64)
        if keep is not None:
            within &= keep[bucket]
        keys.append((doc[: len(lo)][within] << BITS) | bucket[within])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 300, strength: float = 1.0, penalty: float = 2e-3) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept)."""
    weights = np.zeros(1 << BITS, np.float32)
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return weights, float(np.clip(20 * (y.mean() - 0.5), -4, 4)) if len(y) else 0.0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    yes, no, n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0
    for rows, data, offsets in blocks(batch, "text", FIT_BYTES):
        d, g = features(data, offsets)
        hit = y[n + d]
        yes += np.bincount(g, hit, minlength=1 << BITS)
        no += np.bincount(g, 1 - hit, minlength=1 << BITS)
        n += rows.num_rows
    ratio = np.log((yes + strength) / (yes + strength).sum()) - np.log((no + strength) / (no + strength).sum())
    # a ratio that chance explains is noise, and long texts hold a lot of it
    used = np.flatnonzero((np.abs(ratio) >= SURE * np.sqrt(1 / (yes + strength) + 1 / (no + strength))) & (yes + no >= 5))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    found, n = [], 0
    for rows, data, offsets in blocks(batch, "text", FIT_BYTES):
        d, g = features(data, offsets, place >= 0)
        found.append((d + n, place[g]))
        n += rows.num_rows
    doc, at = (np.concatenate(x) for x in zip(*found))
    r = ratio[used]
    v, b = np.zeros(len(used)), 0.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for k in range(1, rounds + 1):
        s = np.bincount(doc, (v * r)[at], minlength=n) + b
        e = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y) * balance / n
        g = np.append(np.bincount(at, e[doc], minlength=len(used)) * r + penalty * v / max(1, len(used)) ** 0.5, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.02 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        v, b = v - step[:-1], b - step[-1]
    weights[used] = v * r
    return weights, float(b)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercept: float, used: np.ndarray | None = None) -> np.ndarray:
    doc, gram = features(data, offsets, weights != 0 if used is None else used)
    s = np.bincount(doc, weights[gram].astype(np.float64), minlength=len(offsets) - 1) + intercept
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", FOLDS) > 0))
    texts, y = labelled.sample(docs, known, ROWS, SIZE)
    model = fit(texts, (y == "1").astype(float))
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # 2 ** BITS floats, whatever the data

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = held.value
        used = weights != 0
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(data, offsets, weights, intercept, used))], ["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")


def keep(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5; texts without an n-gram stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = held.value
        used = weights != 0
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                fine = (scores(data, offsets, weights, intercept, used) < 0.5) | (np.diff(offsets) == 0)
                yield pa.RecordBatch.from_arrays(rows.columns, rows.schema.names).filter(pa.array(fine))

    return mapped(docs, kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
