"""The suffix-tree operator at its joints: steps of addition, equal texts, and its parameters."""

import random

import pytest

from parapet.llm import language_model


def texts(n):
    rng = random.Random(5)
    words = ["the", "cat", "on", "mat", "der", "Hund", "é", "and", "then"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(300)))
    same = texts(3)[2] + " of equal texts"
    return spark.createDataFrame(rows + [(1000 + 7 * i, same) for i in range(40)], "doc_id long, text string").repartition(6)


def by_id(df):
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def test_steps_of_addition_change_nothing(docs, monkeypatch):
    want = by_id(language_model.score(docs))
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 500)  # many blocks
    monkeypatch.setattr(language_model, "FAN", 3)
    monkeypatch.setattr(language_model, "SPAN", 4)
    got = by_id(language_model.score(docs))
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:3] == row[:3] and got[i][3:] == pytest.approx(row[3:], rel=1e-6)


def test_equal_texts_have_equal_scores(docs):
    got = by_id(language_model.score(docs.repartition(5)))
    assert len({row[3:] for i, row in got.items() if i >= 1000}) == 1


def test_depth_is_a_parameter(docs):
    shallow, deep = (by_id(language_model.score(docs, depth=d)) for d in (2, 7))
    assert sum(r[4] for r in deep.values()) > sum(r[4] for r in shallow.values())
    assert all(r[:4] == shallow[i][:4] for i, r in deep.items())
