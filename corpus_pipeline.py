"""The training-corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of documents. The last returns the corpus: documents with their columns
and how many of their words the mix takes.

Cases: rows without id are judged by their texts in the classifiers and stay as they are in the
near-duplicate stage; null, empty and wordless texts are judged as the classifiers judge them, are
no near-duplicates of anything, have no passage to cut, and take no words; repeated rows become one;
very long texts are worked on whole; of equal texts that with the least id stays; empty tables give
an empty result; other columns are kept, but for those with a name of the mix's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import decontaminate, mixing, near_dup, quality_cnn, toxicity
from parapet.llm.shared import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional quality classifier rejects go."""
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.keep(docs, model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; repeated rows become one."""
    return near_dup.keep(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.cut(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: all columns of each document, and how many of its words the mix takes."""
    return mixing.mix(docs, carried=tuple(c for c in docs.columns if c not in mixing.RESULTS))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The trained stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents; what each keeps is the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
