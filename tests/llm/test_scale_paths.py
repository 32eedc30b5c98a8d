"""Ways that small tables do not take: benchmarks of several blocks, many sources, samples of skewed labels."""

import pytest
from pyspark.sql import functions as F

from parapet.llm import decontaminate, labelled, mixing, warc
from parapet import shared as base


def rows(df):
    return sorted(map(str, df.collect()))


def test_benchmark_of_several_blocks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    bench = bench.unionByName(bench.limit(3)).unionByName(spark.createDataFrame([(None, "is and"), (None, None), (900001, "der"), (900001, "the of")], bench.schema))
    want = rows(decontaminate.report(docs, bench))
    clean = rows(decontaminate.cut(docs, bench).select("doc_id", "text"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert decontaminate.store(bench).blocks > decontaminate.KEPT
    assert rows(decontaminate.report(docs, bench)) == want
    assert rows(decontaminate.cut(docs, bench).select("doc_id", "text")) == clean


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 500}, {"a": 300, "b": 100, "c": 200}, {"a": 0}, {None: 7}, {f"h{i}": i * i % 37 for i in range(200)}, {}])
def test_targets_of_any_number_of_sources(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.planned(df).collect()}
    assert got == pytest.approx(mixing.targets(sizes))


def test_mix_with_many_sources(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.concat("source", (F.col("doc_id") % 9).cast("string")))
    want = rows(mixing.mix(docs))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert rows(mixing.mix(docs)) == want
    with_text = mixing.mix(docs, carried=("text", "lang"))
    assert rows(with_text.drop("text", "lang")) == want
    assert rows(with_text.select("doc_id", "text")) == rows(docs.select("doc_id", "text"))


def test_sample_takes_the_first_of_each_label(spark):
    known = [(i, "a" if i % 50 else "b") for i in range(5000)] + [(50, "c"), (None, "a"), (7, None), (3, "a")]
    df = spark.createDataFrame(known, "doc_id long, label string").unionByName(spark.createDataFrame(known[:3000], "doc_id long, label string"))
    got = labelled.chosen(df, 300, 7).collect()
    turns = {r.doc_id: r.turn for r in df.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("turn")).distinct().collect()}
    last = {i: max(x for j, x in known if j == i and x) for i, x in known if i is not None}
    for label in "abc":
        want = sorted((turns[i], i) for i, x in last.items() if x == label)[:100]
        assert sorted((r.turn, r.doc_id) for r in got if r.label == label) == want
    assert labelled.chosen(df.filter("false"), 300, 7).count() == 0


def test_records_of_frequent_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>gone" if i % 3 else f"<p>{i % 40}") for i in range(200)], "page_id long, url string, html string")
    want = rows(warc.read(warc.write(pages)))
    for hot in (0, 1 << 40):
        monkeypatch.setattr(warc, "HOT", hot)
        assert rows(warc.read(warc.write(pages))) == want


def test_frequent_keys_are_at_most_hot(spark):
    big = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    assert base.met(big, small, "k", 1000).count() == 1000
