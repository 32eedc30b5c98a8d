"""Operator 6: quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Bytes are
embedded, learned filters run over each chunk, a rectifier and a max-pool over the chunk leave one
value a filter. The mean and the maximum of these over the document's chunks go through a hidden
layer to one probability. Training is gradient descent (Adam) on the cross-entropy, through the
max-pool, on a bounded sample (ROWS documents, SIZE bytes) of the labelled rows outside the
held-out fold; all documents are scored.

Cases: null and empty texts are one chunk of padding; without labels of both classes the network
stays as it began, with a bias towards the class seen; an id with several labels has the greatest; an
empty table gives an empty result; repeated rows and ties score alike; a very long text is scored
whole, AT_ONCE chunks at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import labelled
from parapet.llm.shared import fold, mapped, table
from parapet.llm.words import blocks, give_back

CHUNK, OVERLAP = 256, 32
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 1, 16, 16
#: Bounds of the training sample.
ROWS, SIZE = 3000, 6 << 20
EPOCHS, BATCH, RATE, SEED = 12, 24, 0.01, 11
#: Bytes of a training batch of several texts, at most.
BATCH_BYTES = 96 << 10
#: Weight of good texts in training, whatever their share of the sample.
GOOD_SHARE = 0.65
FOLDS = 5
KEEP_FROM = 0.3
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks worked on at once, which bounds memory.
AT_ONCE = 512


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of each chunk; an empty document has one empty chunk."""
    size = np.diff(offsets)
    many = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = offsets[:-1][doc] + nth * (CHUNK - OVERLAP)
    return doc, begin, np.minimum(begin + CHUNK, offsets[1:][doc])


def chunk_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of CHUNK bytes as 1..256, and 0 as padding."""
    at = begin[:, None] + np.arange(CHUNK)
    padded = np.append(data.astype(np.int16) + 1, np.zeros(1, np.int16))
    return np.where(at < end[:, None], padded[np.minimum(at, len(data))], 0)


def begin_model(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: (rng.standard_normal(shape) / by**0.5).astype(np.float32)
    m = {
        "embed": normal(257, EMBED, by=EMBED),
        "filter": normal(WIDTH * EMBED, FILTERS, by=WIDTH),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN, by=2 * FILTERS),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, by=HIDDEN),
        "out_bias": np.zeros(1, np.float32),
    }
    m["embed"][0] = 0
    return m


def pooled(m: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks: the largest value of each filter, where it is, and the windows' inputs."""
    x = m["embed"][rows].reshape(len(rows), CHUNK * EMBED)
    s = x.strides
    windows = np.lib.stride_tricks.as_strided(x, (len(rows), PLACES, WIDTH * EMBED), (s[0], STRIDE * EMBED * s[1], s[1]))
    windows = windows.reshape(-1, WIDTH * EMBED)
    y = (windows @ m["filter"]).reshape(len(rows), PLACES, FILTERS)
    return y.max(1) + m["bias"], y, windows


def combined(m: dict[str, np.ndarray], chunk: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of documents from the rectified values of their chunks; first: where each document's chunks begin."""
    count = np.diff(np.append(first, len(chunk)))[:, None].astype(np.float32)
    both = np.hstack([np.add.reduceat(chunk, first, 0) / count, np.maximum.reduceat(chunk, first, 0)])
    hidden = np.tanh(both @ m["hidden"] + m["hidden_bias"])
    return hidden @ m["out"] + m["out_bias"][0], hidden, both, count


def scores(m: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    doc, begin, end = chunks(data, offsets)
    values = [np.maximum(pooled(m, chunk_bytes(data, begin[k : k + AT_ONCE], end[k : k + AT_ONCE]))[0], 0) for k in range(0, len(doc), AT_ONCE)]
    logit = combined(m, np.vstack(values), np.searchsorted(doc, np.arange(len(offsets) - 1)))[0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def fit(texts: list[str], good: np.ndarray) -> dict[str, np.ndarray]:
    m = begin_model()
    y = np.asarray(good, np.float32)
    if not len(y) or y.min() == y.max():
        m["out"][:] = 0
        m["out_bias"][0] = 0 if not len(y) else 4 * (y[0] - 0.5)
        return m
    rng = np.random.default_rng(SEED)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    # whole texts, and an excerpt of every third one, so that short texts are seen too
    for i in range(0, len(texts), 3):
        n = min(len(raw[i]), int(rng.integers(8, 160)))
        at = int(rng.integers(len(raw[i]) // 3, len(raw[i]) - n + 1)) if len(raw[i]) - n >= len(raw[i]) // 3 else len(raw[i]) - n
        raw.append(raw[i][at : at + n])
    y = np.append(y, y[::3])
    weight = np.where(y == 1, GOOD_SHARE / y.mean(), (1 - GOOD_SHARE) / (1 - y.mean())).astype(np.float32)
    step = 0
    plan = [batch for _ in range(EPOCHS) for batch in batches([len(r) for r in raw], rng.permutation(len(raw)))]
    total = len(plan)
    for pick in plan:
        offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in pick])])
        data = np.concatenate([raw[i] for i in pick])
        doc, begin, end = chunks(data, offsets)
        g = gradient(m, chunk_bytes(data, begin, end), np.searchsorted(doc, np.arange(len(pick))), y[pick], weight[pick])
        step += 1
        rate = RATE * (1 - step / (total + 1))
        for name, v in m.items():
            first[name] = 0.9 * first[name] + 0.1 * g[name]
            second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
            v -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
        m["embed"][0] = 0
    return m


def batches(sizes: list[int], order: np.ndarray) -> list[list[int]]:
    """Texts in this order, in batches of at most BATCH texts and BATCH_BYTES (a longer text alone)."""
    out, size = [[]], 0
    for i in order.tolist():
        if out[-1] and (len(out[-1]) == BATCH or size + sizes[i] > BATCH_BYTES):
            out.append([])
            size = 0
        out[-1].append(i)
        size += sizes[i]
    return out


def gradient(m: dict[str, np.ndarray], rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    top, values, windows = pooled(m, rows)
    chunk = np.maximum(top, 0)
    logit, hidden, both, count = combined(m, chunk, first)
    e = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)
    g = {"out": hidden.T @ e, "out_bias": e.sum(keepdims=True)}
    back = e[:, None] * m["out"] * (1 - hidden**2)
    g["hidden"], g["hidden_bias"] = both.T @ back, back.sum(0)
    back = back @ m["hidden"].T
    many = count[:, 0].astype(int)
    doc = np.repeat(np.arange(len(first)), many)
    to_max = (chunk == both[doc, FILTERS:]) / np.maximum(np.add.reduceat((chunk == both[doc, FILTERS:]).astype(np.float32), first, 0), 1)[doc]
    to_chunk = (back[:, :FILTERS] / count)[doc] + back[doc, FILTERS:] * to_max
    to_chunk *= top > 0
    g["bias"] = to_chunk.sum(0)
    # only the windows that won the max-pool pass a gradient on
    won = values.argmax(1) + np.arange(len(rows))[:, None] * PLACES
    g["filter"] = np.empty_like(m["filter"])
    to_input = np.zeros((len(rows), CHUNK, EMBED), np.float32)
    for f in range(FILTERS):
        g["filter"][:, f] = windows[won[:, f]].T @ to_chunk[:, f]
        place = (won[:, f] % PLACES) * STRIDE
        part = (to_chunk[:, f, None] * m["filter"][:, f]).reshape(-1, WIDTH, EMBED)
        to_input[np.arange(len(rows))[:, None], place[:, None] + np.arange(WIDTH)] += part
    g["embed"] = np.stack([np.bincount(rows.ravel(), to_input[:, :, k].ravel(), minlength=257) for k in range(EMBED)], 1).astype(np.float32)
    return {k: v.astype(np.float32) for k, v in g.items()}


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", FOLDS) > 0))
    texts, y = labelled.sample(docs, known, ROWS, SIZE)
    model = fit(texts, (y == "1").astype(np.float32))
    give_back()
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(held.value, data, offsets))], ["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")


def keep(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, that score KEEP_FROM or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                fine = scores(held.value, data, offsets) >= KEEP_FROM
                yield pa.RecordBatch.from_arrays(rows.columns, rows.schema.names).filter(pa.array(fine))

    return mapped(docs, kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
