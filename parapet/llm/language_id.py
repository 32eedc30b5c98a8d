"""Operator 9: language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the character n-grams that are typical of it. The filters are
bit-sliced: a slot holds one bit for each language, so one look-up of an n-gram (an AND over its
HASHES slots) returns all languages that contain it. A text's votes for a language are the set bits
over its n-grams, corrected by the share of n-grams that the filter lets through by chance; the
language with the most votes wins.

N-grams are runs of code points of the text with A-Z lowered and everything but letters, as far as
ASCII tells, as one space. One is typical of a language if its share there is at least TYPICAL of
its largest share anywhere. The filters are fitted on a bounded sample (ROWS documents of each
language, SIZE bytes of text in all) of documents outside the held-out fold; all documents are
scored.

Cases: a null text, or one without a letter, is `und` with score 0; texts without any known n-gram
get the most frequent language with score 0, ties, in votes too, going to the first by code point;
without training rows all are `und`. An empty table gives an empty result; repeated rows are alike; a
very long text is counted whole, in a block by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import labelled
from parapet.llm.shared import fold, mapped, table
from parapet.llm.words import _BYTE, U64, _power, blocks, give_back, mix, per_document

ORDERS = (3, 4)
SLOT_BITS = 19
HASHES = 3
TYPICAL = 0.5
LEAST = 2
#: Bounds of the training sample.
ROWS, SIZE = 6000, 12 << 20
FOLDS, HELD = 3, 1

PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
PLAIN[0x80:] = np.arange(0x80, 0x100)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (document, hash) of each n-gram of a block in text order, with its repeats; each text stands between spaces."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint8)
    place = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))
    padded[place] = PLAIN[data]
    doc = np.repeat(np.arange(n), np.diff(offsets) + 2)
    keep = np.ones(len(padded), bool)
    keep[1:] = ~((padded[1:] == 0x20) & (padded[:-1] == 0x20) & (doc[1:] == doc[:-1]))
    padded, doc = padded[keep], doc[keep]
    up, down = _power(len(padded) + 1)
    total = np.zeros(len(padded) + 1, U64)
    np.cumsum(_BYTE[padded] * up[:-1], out=total[1:])
    begins = np.flatnonzero((padded & 0xC0) != 0x80)
    edges = np.append(begins, len(padded))
    doc = doc[begins]
    for k in ORDERS:
        if len(begins) < k:
            continue
        lo, hi = edges[: len(begins) - k + 1], edges[k:]
        ok = doc[: len(lo)] == doc[k - 1 :]
        yield doc[: len(lo)][ok], mix((total[hi] - total[lo]) * down[lo] + U64(k))[ok]


def slots(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> U64(SLOT_BITS)) | U64(1)
    return [((h + U64(i) * step) & U64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters: bit i % 8 of slices[slot, i // 8] is set if language i has an n-gram with that slot."""

    def __init__(self, languages: list[str], members: list[np.ndarray], usual: int = 0):
        self.languages, self.usual = languages, usual
        self.slices = np.zeros((1 << SLOT_BITS, -(-len(languages) // 8)), np.uint8)
        for i, h in enumerate(members):
            for s in slots(h):
                self.slices[s, i // 8] |= np.uint8(1 << (i % 8))
        fill = [np.count_nonzero(self.slices[:, i // 8] & (1 << (i % 8))) / (1 << SLOT_BITS) for i in range(len(languages))]
        self.by_chance = np.array(fill) ** HASHES

    def votes(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """For each document and language: its n-grams in the filter, less those let through by chance."""
        first = np.searchsorted(doc, np.arange(n + 1))
        out = np.zeros((n, len(self.languages)))
        some = np.flatnonzero(np.diff(first) > 0)
        if not len(some):
            return out
        places = slots(h)
        for k in range(self.slices.shape[1]):  # eight languages at a time
            part = np.ascontiguousarray(self.slices[:, k]) if self.slices.shape[1] > 1 else self.slices[:, 0]
            mask = part[places[0]]
            for p in places[1:]:
                mask &= part[p]
            for i in range(8 * k, min(8 * k + 8, len(self.languages))):
                out[some, i] = np.add.reduceat((mask >> np.uint8(i % 8)) & np.uint8(1), first[some], dtype=np.int64)
        chance = np.diff(first)[:, None] * self.by_chance
        return np.maximum(0, (out - chance) / np.maximum(1 - self.by_chance, 1e-9))


def fit(texts: list[str], langs: np.ndarray) -> Filters:
    languages = sorted(set(langs))
    keys, counts = [], []
    for lang in languages:
        batch = pa.RecordBatch.from_arrays([pa.array([t for t, x in zip(texts, langs) if x == lang], pa.large_string())], ["text"])
        key, count = np.zeros(0, U64), np.zeros(0, np.int64)
        for _, data, offsets in blocks(batch, "text", 256 << 10):
            k, c = np.unique(np.concatenate([h for _, h in grams(data, offsets)] or [key[:0]]), return_counts=True)
            key, back = np.unique(np.concatenate([key, k]), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, c]), minlength=len(key)).astype(np.int64)
        keys.append(key)
        counts.append(count)
    every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, U64)
    most = np.zeros(len(every))
    for key, count in zip(keys, counts):
        place = np.searchsorted(every, key)
        most[place] = np.maximum(most[place], count / max(1, count.sum()))
    members = []
    for key, count in zip(keys, counts):
        place = np.searchsorted(every, key)
        members.append(key[(count >= LEAST) & (count / max(1, count.sum()) >= TYPICAL * most[place])])
    usual = int(np.argmax([np.sum(langs == x) for x in languages])) if languages else 0
    return Filters(languages, members, usual)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents have a letter."""
    out = per_document(ASCII_LETTER[data], offsets) > 0
    for d in np.flatnonzero(~out & (per_document(data >= 0x80, offsets) > 0)):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode())
    return out


def predict(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    if not filters.languages:
        return ["und"] * n, np.zeros(n)
    votes = np.zeros((n, len(filters.languages)))
    for doc, h in grams(data, offsets):
        votes += filters.votes(doc, h, n)
    best = votes.argmax(1)
    total = votes.sum(1)
    share = np.where(total > 0, votes[np.arange(n), best] / np.where(total > 0, total, 1), 0)
    best = np.where(total > 0, best, filters.usual)
    known = lettered(data, offsets)
    return [filters.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, share, 0)


def train(docs: DataFrame) -> Filters:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label")).filter(F.col("label").isNotNull() & (fold("doc_id", FOLDS) >= 0) & (fold("doc_id", FOLDS) != HELD))
    texts, langs = labelled.sample(docs.filter("text IS NOT NULL"), known, ROWS, SIZE)
    filters = fit(texts, langs)
    give_back()
    return filters


def label(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** SLOT_BITS bytes for each 8 languages

    def labelled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", 1 << 20):
                lang, share = predict(held.value, data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labelled_rows, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, train(docs)).select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
