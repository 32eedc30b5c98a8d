"""Rows as nodes, frequent keys, and recall against an exact join."""

from collections import Counter, defaultdict

import pytest

from parapet import shared
from parapet.llm import near_dup
from tests.llm.test_edges import shingles

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_an_id_on_different_texts(spark):
    docs = frame(spark, [(0, A), (1, A), (1, B)])
    assert found(near_dup.classes(docs)) == Counter([(0, 56, 0, True), (1, 56, 0, False), (1, 56, 1, True)])
    assert Counter((r.doc_id, r.text) for r in near_dup.keep(docs).collect()) == Counter([(0, A), (1, B)])
    docs = frame(spark, [(1, A), (1, B), (2, A + " word"), (3, B + " word")])
    assert {r.doc_id: r.component_id for r in near_dup.classes(docs).collect()} == {1: 1, 2: 1, 3: 1}
    assert Counter(r.doc_id for r in near_dup.keep(docs).collect()) == Counter([1, 1])


def test_one_text_of_a_class_stays(spark):
    docs = frame(spark, [(5, A), (5, A + " word"), (5, A), (5, B), (6, A + " other"), (None, A), (None, A), (7, None), (7, None), (8, ""), (9, None)])
    left = near_dup.keep(docs).collect()
    assert Counter(r.doc_id for r in left) == Counter([5, 5, None, None, 7, 8, 9])
    assert B in {r.text for r in left}


def test_frequent_keys(spark, monkeypatch):
    """The same classes where every bucket, leader and hub counts as frequent, and where none does."""
    docs = frame(spark, [(k, " ".join([*(f"w{i}" for i in range(100)), f"own{k}"])) for k in range(60)] + [(100 + k, f"only words of number {k} here") for k in range(20)])
    want = found(near_dup.classes(docs))
    assert sum(n for (_, _, c, _), n in want.items() if c == 0) == 60
    for hot, dealt in ((1 << 40, 4), (0, 1 << 30)):
        monkeypatch.setattr(shared, "HOT", hot)
        monkeypatch.setattr(near_dup, "HOT", hot)
        monkeypatch.setattr(near_dup, "DEALT", dealt)
        assert found(near_dup.classes(docs)) == want


def test_buckets_of_the_same_members_are_dealt_once(spark):
    """Keys 7, 8 and -2 have the members 1, 2; key 5 has one more; key 6 has one component only."""
    rows = [(k, n, n, 50) for k in (7, 8, -2, 5) for n in (1, 2)] + [(5, 3, 3, 50), (6, 1, 1, 50), (6, 4, 1, 50)]
    members = spark.createDataFrame(rows, "key long, node long, component long, n_shingles long")
    buckets = near_dup._per_bucket(members)
    assert {(r.key, r.n, r.main) for r in buckets.collect()} == {(-2, 2, 1), (5, 3, 1)}
    assert Counter((r.key, r.node) for r in near_dup._across(members, buckets).filter("key = -2").collect()).keys() == {(-2, 1), (-2, 2)}


def exact_components(texts):
    """Least id of each id's component, by a join of the rarest shingles of each set."""
    sets, first = {}, {}
    for i, t in sorted(texts):
        s = frozenset(hash(x) for x in shingles(t))
        first[i] = sets.setdefault(s, i) if s else i
    often = Counter(x for s in sets for x in s)
    held = defaultdict(list)
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in first.items():
        parent[i] = j
    links = 0
    for s, i in sets.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - (75 * len(s) + 99) // 100 + 1]
        for j, other in {j: o for x in rare for j, o in held[x]}.items():
            both = len(s & other) if 75 * len(s) <= 100 * len(other) and 75 * len(other) <= 100 * len(s) else 0
            if both and 100 * both >= 75 * (len(s) + len(other) - both):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in rare:
            held[x].append((i, s))
    return {i: root(i) for i in parent}, links


def test_every_link_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    want, links = exact_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in near_dup.classes(docs).collect()}
    assert links > 100
    assert {i: (got[i], c) for i, c in want.items() if got[i] != c} == {}


def test_shipped_before_functions_are_made(spark):
    assert near_dup.classes(frame(spark, [(1, "a b c")])).count() == 1


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_bitmap_names_all_keys(spark, n):
    from pyspark.sql import functions as F

    keys = spark.range(n).withColumn("k", F.concat(F.lit("k"), "id"))
    bits = shared.bitmap_bits(n)
    told = shared.flagged(spark.range(2000).withColumn("k", F.concat(F.lit("k"), "id")), F.col("k"), shared.bitmap(keys, "k", bits), bits, "told")
    got = {r.id for r in told.filter("told").collect()}
    assert set(range(n)) <= got and len(got) <= n + 120 + (2000 - n) // 8
