import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parapet.llm import decontaminate, near_dup
from parapet.llm.shared import written


def test_stages(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "near duplicates", "decontamination", "mixing"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, now, folder), "test")
        if k < 4:
            assert out.columns == docs.columns and 0 < out.count() <= now.count()
        if name == "near duplicates":
            assert near_dup.classes(out).filter("NOT kept").count() == 0
        if name == "decontamination":
            assert decontaminate.report(out, bench).filter("contaminated").count() == 0
        if name == "mixing":
            assert out.count() == now.count()
            assert out.filter(F.col("taken") > 2 * F.col("size")).count() == 0
            assert {"text", "lang", "source", "n_chars"} <= set(out.columns)
            assert out.join(now, "doc_id").filter(~out["text"].eqNullSafe(now["text"])).count() == 0
        now = out


def test_repeated_rows_become_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x")], "doc_id long, text string").withColumn("dropped", F.lit(1))
    assert sorted(map(str, [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()])) == ["1", "None"]


@pytest.mark.parametrize("table", ["documents"])
def test_empty_tables(spark, sf, tmp_path, table):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_cases(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns through all stages."""
    phrase = "one two three four five six seven eight nine ten eleven"
    good = "A sentence of plain words that tells about a place and its people. " * 5
    rows = [(1, good), (1, good), (2, good), (3, good + phrase), (4, None), (5, ""), (6, " \t\n"), (7, "plain words " * 60_000), (None, good + "without id"), (None, None), (8, phrase)]
    docs = spark.createDataFrame([(i, t, "en", "a" if i else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"size": F.lit(7), "key": F.lit("k"), "label": F.lit("x"), "of": F.lit(1), "node": F.lit(2), "component": F.lit("c")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, phrase), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert set(out) == {1, 3, 4, 5, 6, 7, None} and all(len(v) == 1 for i, v in out.items() if i is not None) and len(out[None]) == 2
    assert "eight nine" not in "".join(r.text or "" for v in out.values() for r in v) and out[4][0].text is None and out[4][0].taken == 0
    assert out[7][0]["size"] == 120_000 and {"key", "label", "of", "node", "component"} <= set(out[7][0].asDict())
