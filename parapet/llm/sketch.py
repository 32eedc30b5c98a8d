"""Shingle sets of documents, and their fast similarity sketches."""

from __future__ import annotations

import numpy as np

from parapet.llm.words import LOWER, U64, Words, inside, mix, per_document, window_hashes

SHINGLE = 5
BANDS, BAND_ROWS = 40, 5
COORDINATES = BANDS * BAND_ROWS


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, one after another; where each document's begin)."""
    w = Words(LOWER[data], offsets)
    n = len(offsets) - 1
    h = w.hashes()
    doc = w.document()
    at = np.flatnonzero(inside(w.first, SHINGLE))
    keys, docs = [window_hashes(h, SHINGLE)[at]], [doc[at]]
    count = np.diff(w.first)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            keys.append(window_hashes(h, k)[w.first[:-1][short]])
            docs.append(short)
    key, of = np.concatenate(keys), np.concatenate(docs).astype(np.uint16)  # a block has at most BLOCK_ROWS documents
    order = np.argsort(key)
    order = order[np.argsort(of[order], kind="stable")]
    key, of = key[order], of[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])) if len(key) else np.zeros(0, bool)
    return key[fresh], np.searchsorted(of[fresh], np.arange(n + 1))


def sketch(sets: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch: a row of t values a document (empty sets: all the largest value).

    In round i every element goes to a random one of t bins, with a random value below those of
    round i + 1; after t such rounds, round t + j sends all elements to bin j, so that none stays
    empty. Rounds end for a document when all its bins are filled: for sets of over t ln t elements
    that is after about one.
    """
    n = len(first) - 1
    size = np.diff(first)
    empty = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), empty, U64)
    doc = np.repeat(np.arange(n), size)
    x = sets
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + U64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF))
        place = ((h >> U64(40)) * U64(t) >> U64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), doc * t + place, (U64(i) << U64(40)) | (h & U64((1 << 40) - 1)))
        open_ = (out == empty).any(1)
        if not open_[doc[0]] or not open_.all():
            keep = open_[doc]
            if not keep.all():
                x, doc = x[keep], doc[keep]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch, with the band's number in it."""
    n = len(sketches)
    rows = sketches.reshape(n, BANDS, BAND_ROWS)
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=U64)), (n, 1))
    for k in range(BAND_ROWS):
        out = mix(out * U64(0x9FB21C651E98DF25) + rows[:, :, k])
    return out


def fingerprints(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, alike for equal sets."""
    sums = []
    for seed in (U64(0x51ED270B), U64(0x2545F491)):
        total = np.zeros(len(sets) + 1, U64)
        np.cumsum(mix(sets ^ seed), out=total[1:])
        sums.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)))
    return sums[0].view(np.int64), sums[1].view(np.int64)
