"""Operator 2: quality rules combined by weak supervision.

Every rule looks at one measure of the whole text and votes good, bad or abstains. How often each
vote occurs among good and among bad texts is not set by hand: expectation-maximisation estimates
it from all documents, and the posterior probability of good quality replaces all-must-pass.
The documents enter the estimate only as counts of vote patterns, at most 3 ** rules of them.

Cases: a null or empty text has no words and fails the base test; an empty table gives an empty
result; repeated rows and ties are scored alike; a very long text is measured whole, in a block by
itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.shared import mapped, table, written
from parapet.llm.words import Words, blocks, inside, mix, per_document, range_hashes, window_hashes

WINDOW = 5
GOOD, ABSTAIN, BAD = 2, 1, 0

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True

#: name, measure, bad from (or below, if negative), good up to; between them the rule abstains.
RULES = (
    ("symbols per character", lambda m: m["n_symbols"] / m["word_chars"], 0.05, 0.005),
    ("upper case per letter", lambda m: m["upper"] / np.maximum(m["letters"], 1), 0.5, 0.15),
    ("exclamations per word", lambda m: m["exclaims"] / m["n_words"], 0.25, 0.05),
    ("words without a letter", lambda m: m["wordless"] / m["n_words"], 0.3, 0.05),
    ("digits per character", lambda m: m["digits"] / m["word_chars"], 0.2, 0.05),
    ("repeated lines", lambda m: m["n_dup_lines"] / np.maximum(m["lines"], 1), 0.3, 0.0),
    ("repeated windows", lambda m: m["n_repeat_words"] / m["n_words"], 0.15, 0.02),
    ("mean word length off 6", lambda m: np.abs(m["word_chars"] / m["n_words"] - 6), 4.5, 2.5),
    ("words per stop", lambda m: m["n_words"] / np.maximum(m["stops"], 0.5), 120, 40),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern int"


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a block, over its whole text."""
    w = Words(data, offsets)
    n = len(offsets) - 1
    count = lambda mask: per_document(mask, offsets)
    step = np.zeros(len(data) + 1, np.int8)
    step[w.starts] += 1
    step[w.ends] -= 1
    solid = np.cumsum(step[:-1], dtype=np.int8) > 0
    m = {
        "n_words": np.diff(w.first),
        "word_chars": count(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": count(SYMBOL[data]),
        "upper": count(UPPER[data]),
        "letters": count(LETTER[data]),
        "digits": count(DIGIT[data]),
        "exclaims": count(data == 0x21),
    }
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    m["wordless"] = per_document(letters[w.ends] == letters[w.starts], w.first)
    m["stops"] = per_document(STOP[data[w.ends - 1]], w.first) if len(w.ends) else np.zeros(n, np.int64)
    # lines: ranges between line ends, none across documents
    cuts = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 0x0A, ends - 1, ends) if len(ends) else ends
    worded = np.concatenate([[0], np.cumsum(solid)])
    has = worded[ends] > worded[starts]
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(offsets, starts, "right") - 1
    m["lines"] = np.bincount(doc, minlength=n)
    same = np.unique(range_hashes(data, starts, ends) ^ mix(doc.astype(np.uint64)), return_index=True)[1]
    m["n_dup_lines"] = m["lines"] - np.bincount(doc[same], minlength=n)
    # words in windows that occur twice or more in the document
    m["n_repeat_words"] = np.zeros(n, np.int64)
    at = np.flatnonzero(inside(w.first, WINDOW))
    if len(at):
        key = window_hashes(w.hashes(), WINDOW)[at] ^ mix(w.document()[at].astype(np.uint64))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key) + 1, bool)
        twin[1:-1] = key[1:] == key[:-1]
        twice = at[order[twin[1:] | twin[:-1]]]
        step = np.bincount(twice, minlength=len(w.starts) + WINDOW) - np.bincount(twice + WINDOW, minlength=len(w.starts) + WINDOW)
        m["n_repeat_words"] = per_document(np.cumsum(step)[: len(w.starts)] > 0, w.first)
    return m


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """The rules' votes as digits of a base-3 number."""
    some = {k: v for k, v in m.items()} | {"n_words": np.maximum(m["n_words"], 1), "word_chars": np.maximum(m["word_chars"], 1)}
    out = np.zeros(len(m["n_words"]), np.int64)
    for _, f, bad, good in RULES:
        x = f(some)
        out = out * 3 + np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in blocks(batch, "text"):
            m = measures(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(votes(m).astype(np.int32))], ["doc_id", *COUNTS, "pattern"]
            )


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good quality of each vote pattern.

    For each rule and class the probabilities of the three votes are estimated (a Dirichlet prior of
    one vote each, and the belief that rules are right more often than not, by the start: a pattern
    with a bad vote is bad with 0.9). The classes keep their meaning: good is the one with fewer bad
    votes.
    """
    r = len(RULES)
    digits = (patterns[:, None] // 3 ** np.arange(r - 1, -1, -1)[None, :]) % 3
    hot = (digits[:, :, None] == np.arange(3)[None, None, :]).astype(float)
    weight = counts.astype(float)
    good = np.where((digits == BAD).any(1), 0.1, 0.95)
    for _ in range(rounds):
        logs = []
        for q in (1 - good, good):
            seen = np.tensordot(q * weight, hot, 1) + 1
            logs.append(hot.reshape(len(hot), -1) @ np.log(seen / seen.sum(1, keepdims=True)).ravel() + np.log((q @ weight + 1) / (weight.sum() + 2)))
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        moved = np.abs(now - good).max(initial=0)
        good = now
        if moved < 1e-9:
            break
    bad_votes = (digits == BAD).sum(1)
    if (good * weight) @ bad_votes * ((1 - good) @ weight) > ((1 - good) * weight) @ bad_votes * (good @ weight):
        good = 1 - good
    return good


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and quality (posterior) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    measured = written(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _measured, SCHEMA), "rules")
    seen = measured.filter(~base_failed()).groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 ** rules rows
    good = estimate(seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)) if len(seen) else np.zeros(0)
    verdicts = spark.createDataFrame([(int(p), float(g)) for p, g in zip(seen["pattern"], good)], "pattern int, quality double")
    return measured.join(F.broadcast(verdicts), "pattern", "left").select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (F.coalesce("quality", F.lit(0.0)) >= 0.5)).alias("kept"), "quality"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
