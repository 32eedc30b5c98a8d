"""The methods' own parts against plain versions, and the queries against SQL and held-out labels."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parapet.llm import fm_index, language_id, language_model, near_dup, quality_cnn, quality_rules, registry, sketch, suffix_tree, toxicity
from parapet.llm.components import components
from parapet.llm.words import LOWER, Words, blocks, inside, string_block, window_hashes


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, same_rows, name):
    same_rows(registry.queries()[name](spark, sf), registry.oracle_sql()[name])


def test_words_and_windows():
    texts = ["a b  c", "", None, "b c", " x ", "a b c d e f", "é è"]
    data, offsets = string_block(pa.array(texts, pa.string()))
    w = Words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in (t or "").split()]
    h = w.hashes()
    same = {}
    for x, k in zip(got, h):
        assert same.setdefault(x, k) == k
    assert len(set(same.values())) == len(same)
    at = np.flatnonzero(inside(w.first, 2))
    pairs = [(got[i], got[i + 1]) for i in at]
    assert pairs == [("a", "b"), ("b", "c"), ("b", "c"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("é", "è")]
    k = window_hashes(h, 2)[at]
    assert k[1] == k[2] and k[0] == k[3] and k[0] != k[1]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 50, pa.string())], ["text"])
    assert sum(r.num_rows for r, _, _ in blocks(batch, "text", 7)) == len(texts) * 50


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((4, 1.0), (30, 0.8), (400, 0.75), (3000, 0.5)):
        common = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 52, 2 * n, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - common : 2 * n - common])
        s = sketch.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s < np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.17
    assert (sketch.sketch(np.zeros(0, np.uint64), np.zeros(2, np.int64)) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_sketch_does_not_depend_on_neighbours():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 52, n, dtype=np.uint64)) for n in (1, 3, 700, 2, 40)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    together = sketch.sketch(np.concatenate(sets), first)
    for k, s in enumerate(sets):
        assert (sketch.sketch(s, np.array([0, len(s)]))[0] == together[k]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_links_between_all_members_of_a_bucket(spark, monkeypatch):
    """A chain of texts, each like its neighbours only, is one component; blocks of buckets change nothing."""
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(24):
        words = base.copy()
        for j in range(0, k):
            words[j * 5 % 120] = f"x{j}"
        data.append((k, " ".join(words)))
    rng = random.Random(8)
    data += [(100 + k, " ".join(base[:70] + [f"y{rng.random()}" for _ in range(50)])) for k in range(30)]
    from tests.llm.test_edges import classes

    want = classes(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.classes(docs).collect()} == want
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in near_dup.classes(docs).collect()} == want


def test_fm_index():
    rng = random.Random(2)
    for symbols in (1, 2, 7):
        s = np.array([rng.randint(0, symbols) for _ in range(400)], np.int64)
        index = fm_index.FMIndex(s, symbols)
        phrases = [tuple(rng.randint(1, symbols) for _ in range(rng.randint(1, 5))) for _ in range(60)]
        rows = np.zeros((60, 5), np.int64)
        for k, p in enumerate(phrases):
            rows[k, 5 - len(p) :] = p
        which, lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
        for k, p in enumerate(phrases):
            want = [i for i in range(len(s) - len(p) + 1) if tuple(s[i : i + len(p)]) == p]
            assert got.get(k, []) == want


def test_suffix_tree_against_plain_recursion():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "ba", "c", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    data, offsets = string_block(pa.array(texts, pa.string()))
    out, first = suffix_tree.symbols(Words(LOWER[data], offsets), len(texts))
    for k, t in enumerate(texts):
        assert bytes(out[first[k] : first[k + 1]]) == b"\n" * suffix_tree.DEPTH + t.encode() + b"\n"
    key, count = suffix_tree.grams(out, first)
    assert count.sum() == sum(len(t.encode()) + 1 for t in texts)
    level = {suffix_tree.DEPTH: (key, count)}
    for d in range(suffix_tree.DEPTH - 1, -1, -1):
        level[d] = suffix_tree.shorter(*level[d + 1], d)
    low = np.uint64(255)
    contexts = [(b"", (level[0][0] & low).astype(np.int64), level[0][1])]
    for d in range(1, suffix_tree.DEPTH + 1):
        for x, (a, b), gain in zip(*suffix_tree.divergent(*level[d], *level[d - 1], d)):
            assert gain > 0
            contexts.append((int(x).to_bytes(d, "big"), (level[d][0][a:b] & low).astype(np.int64), level[d][1][a:b]))
    assert len(contexts) > 3
    tree = suffix_tree.Tree(contexts)
    states = {c: (s, n) for c, s, n in contexts}

    def p(context, symbol):
        sym, n = states[context]
        own = int(n[sym == symbol].sum())
        below = 1 / 256 if not context else p(next(context[j:] for j in range(1, len(context) + 1) if context[j:] in states), symbol)
        return (own + len(sym) * below) / (n.sum() + len(sym))

    assert sum(p(b"", s) for s in range(256)) == pytest.approx(1)
    got = tree.score(out, first)
    for k in range(0, len(texts), 7):
        raw = bytes(out[first[k] : first[k + 1]])
        want = sum(math.log10(p(next(raw[i - suffix_tree.DEPTH + j : i] for j in range(suffix_tree.DEPTH + 1) if raw[i - suffix_tree.DEPTH + j : i] in states), raw[i])) for i in range(suffix_tree.DEPTH, len(raw)))
        assert got[k] == pytest.approx(want, rel=1e-5)


def test_bloom_slices_have_no_false_negatives():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(70)]
    f = language_id.Filters([f"l{i:02}" for i in range(70)], members)
    for i in (0, 63, 64, 69):
        votes = f.votes(np.zeros(2000, np.int64), members[i], 1)
        assert votes[0].argmax() == i and votes[0, i] == pytest.approx(2000, rel=0.01)
        assert np.delete(votes[0], i).max() < 100


def test_estimated_accuracies():
    """Votes drawn from known accuracies: the posterior separates the classes."""
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.85
    r = len(quality_rules.RULES)
    digits = np.ones((20000, r), int)
    for k in range(r):
        digits[:, k] = np.where(good, rng.choice(3, 20000, p=[0.01, 0.09, 0.9]), rng.choice(3, 20000, p=[0.5, 0.2, 0.3]))
    pattern = (digits * 3 ** np.arange(r - 1, -1, -1)).sum(1)
    u, back, n = np.unique(pattern, return_inverse=True, return_counts=True)
    kept = quality_rules.estimate(u, n)[back] >= 0.5
    assert (kept == good).mean() > 0.97


def test_gradient_of_the_network():
    m = {k: v.astype(np.float64) for k, v in quality_cnn.begin_model(3).items()}
    texts = [b"abc def " * 60, b"!!!! $$$$ " * 9]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.array([0, len(texts[0]), len(data)])
    doc, begin, end = quality_cnn.chunks(data, offsets)
    assert begin[0] == 0 and all(b - a == quality_cnn.CHUNK - quality_cnn.OVERLAP for a, b in zip(begin[:-1], begin[1:]) if b < offsets[1]) and end.max() == len(data)
    rows, first = quality_cnn.chunk_bytes(data, begin, end), np.searchsorted(doc, np.arange(2))
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss(model):
        chunk = np.maximum(quality_cnn.pooled(model, rows)[0], 0)
        logit = quality_cnn.combined(model, chunk, first)[0]
        return float(np.mean(np.log1p(np.exp(-logit * (2 * y - 1)))))

    g = quality_cnn.gradient(m, rows, first, y, weight)
    rng = np.random.default_rng(0)
    for name in m:
        at = tuple(rng.integers(0, s) for s in m[name].shape)
        if name == "embed":
            at = (int(data[5]) + 1, 2)
        up, down = ({**m, name: m[name].copy()} for _ in range(2))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=2e-5, rel=1e-2)


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("sf0.001", "sf0.1")


@pytest.mark.parametrize("name, column, least", [("op3_toxicity", "toxic", 0.97), ("op6_quality_cnn", "quality", 0.95)])
def test_held_out_labels(spark, larger, name, column, least):
    got = registry.queries()[name](spark, larger).filter("held_out").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").select("doc_id", "score", column).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    assert auc(got["score"].to_numpy(), got[column].to_numpy()) > least


def test_held_out_languages(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    got = registry.queries()["op9_language_id"](spark, larger).filter("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_model_beats_its_base_on_held_out_texts(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    s = registry.queries()["op5_suffix_tree"](spark, folder).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_toxic_marks(spark):
    texts = [f"good words about item {i} and more of them" for i in range(60)] + [f"you are a worthless idiot number {i}" for i in range(60)]
    w, b = toxicity.fit(texts, np.array([0] * 60 + [1] * 60))
    data, offsets = string_block(pa.array(["what an IDIOT", "what a nice item", ""], pa.string()))
    s = toxicity.scores(data, offsets, w, b)
    assert s[0] > 0.5 > s[1]


def test_all_contexts_that_pass_are_states(spark):
    """More contexts than any bound of the model's size: scores by parts are those of one tree of all states."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    follows = {a + b: rng.sample(letters, 2) for a in letters for b in letters}
    follows |= {x + c: rng.sample(letters, 2) for x in list(follows) for c in letters}
    follows |= {x + c: rng.choice(letters) for x in list(follows) if len(x) == 3 for c in letters}
    rows = []
    for i in range(160):
        t = "abcd"
        for _ in range(9000):
            t += rng.choice(letters) if rng.random() < 0.15 else follows[t[-4:]]
        rows.append((i, t))
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]

    def as_symbols(texts):
        data, offsets = string_block(pa.array(texts, pa.string()))
        return suffix_tree.symbols(Words(LOWER[data], offsets), len(texts))

    level = {suffix_tree.DEPTH: suffix_tree.grams(*as_symbols(train))}
    for d in range(suffix_tree.DEPTH - 1, -1, -1):
        level[d] = suffix_tree.shorter(*level[d + 1], d)
    low = np.uint64(255)
    contexts = [(b"", (level[0][0] & low).astype(np.int64), level[0][1])]
    for d in range(1, suffix_tree.DEPTH + 1):
        for x, (a, b), _ in zip(*suffix_tree.divergent(*level[d], *level[d - 1], d)):
            contexts.append((int(x).to_bytes(d, "big"), (level[d][0][a:b] & low).astype(np.int64), level[d][1][a:b]))
    assert sum(len(c) > 2 for c, _, _ in contexts) > 40000
    want = suffix_tree.Tree(contexts).score(*as_symbols([t for _, t in rows]))
    assert [got[i] for i in range(len(rows))] == pytest.approx(list(want), rel=1e-5)


def test_filters_see_a_pattern_at_every_offset():
    model = quality_cnn.begin_model(3)
    text = np.full((8, quality_cnn.CHUNK), ord("a") + 1)
    for k in range(8):
        text[k, 40 + k : 48 + k] = np.frombuffer(b"p4tt3rn!", np.uint8).astype(int) + 1
    pooled = quality_cnn.pooled(model, text)[0]
    assert np.allclose(pooled, pooled[0], rtol=1e-5, atol=1e-6)
