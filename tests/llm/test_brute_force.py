"""Scores of the classifiers against versions that look at one n-gram, one window at a time."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from parapet.llm import language_id, quality_cnn, toxicity
from parapet.llm.words import _BASE, _BYTE, mix, string_block

TEXTS = ["What an Idiot\tyou are, what an idiot", "abc", "", None, "é😀 Straße und\nwörter " * 9, "plain words of a text about nothing much " * 20, "x" * 700]


def gram_hash(gram):
    raw = sum(int(_BYTE[b]) * pow(_BASE, k, 1 << 64) for k, b in enumerate(gram.encode())) + len(gram)
    return int(mix(np.array([raw % (1 << 64)], np.uint64))[0])


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_toxicity():
    rng = np.random.default_rng(3)
    weights = np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(0, 0.1, 1 << toxicity.BITS), 0).astype(np.float32)
    data, offsets = string_block(pa.array(TEXTS, pa.string()))
    got = toxicity.scores(data, offsets, weights, 0.25)
    for text, s in zip(TEXTS, got):
        t = "".join(" " if c in " \t\n\v\f\r" else c for c in lower(text))
        buckets = {gram_hash(t[i : i + n]) >> (64 - toxicity.BITS) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
        assert s == pytest.approx(1 / (1 + math.exp(-(sum(float(weights[b]) for b in buckets) + 0.25))), rel=1e-6)


def test_languages():
    rng = random.Random(4)
    words = {"en": ["the", "cat", "about", "plain", "words"], "de": ["und", "wörter", "Straße"], "xx": ["xxxx", "abc"]} | {f"l{i}": [f"q{i}w{i}z"] for i in range(9)}
    texts = [(" ".join(rng.choice(w) for _ in range(60)), x) for x, w in words.items() for _ in range(4)]
    filters = language_id.fit([t for t, _ in texts], np.array([x for _, x in texts], object))
    data, offsets = string_block(pa.array(TEXTS, pa.string()))
    got, shares = language_id.predict(filters, data, offsets)
    for text, lang, share in zip(TEXTS, got, shares):
        t = " ".join("".join(c if c.isalpha() or c > "\x7f" else " " for c in lower(text)).split())
        t = f" {t} " if t else " "
        votes = np.zeros(len(filters.languages))
        for n in language_id.ORDERS:
            grams = [t[i : i + n] for i in range(len(t) - n + 1)]
            hit = np.zeros(len(filters.languages))
            for g in grams:
                places = [int(p[0]) for p in language_id.slots(np.array([gram_hash(g)], np.uint64))]
                hit += [all(filters.slices[p, i // 8] >> (i % 8) & 1 for p in places) for i in range(len(filters.languages))]
            votes += np.maximum(0, (hit - len(grams) * filters.by_chance) / np.maximum(1 - filters.by_chance, 1e-9))
        if not any(c.isalpha() for c in text or ""):
            assert (lang, share) == ("und", 0)
        elif votes.sum() > 0:
            assert lang == filters.languages[int(votes.argmax())] and share == pytest.approx(votes.max() / votes.sum())


def test_quality_network():
    m = quality_cnn.begin_model(5)
    data, offsets = string_block(pa.array(TEXTS, pa.string()))
    got = quality_cnn.scores(m, data, offsets)
    for text, s in zip(TEXTS, got):
        raw, values = (text or "").encode(), []
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        for at in range(0, max(1, len(raw) - quality_cnn.OVERLAP), step):
            codes = [b + 1 for b in raw[at : at + quality_cnn.CHUNK]]
            codes += [0] * (quality_cnn.CHUNK - len(codes))
            best = np.full(quality_cnn.FILTERS, -np.inf)
            for k in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                window = np.concatenate([m["embed"][c] for c in codes[k : k + quality_cnn.WIDTH]])
                best = np.maximum(best, window @ m["filter"])
            values.append(np.maximum(best + m["bias"], 0))
        both = np.concatenate([np.mean(values, 0), np.max(values, 0)])
        logit = np.tanh(both @ m["hidden"] + m["hidden_bias"]) @ m["out"] + m["out_bias"][0]
        assert s == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-4)
