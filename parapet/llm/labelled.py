"""A bounded, deterministic sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.shared import written
from parapet.llm.words import give_back


def chosen(labelled: DataFrame, rows: int, seed: int) -> DataFrame:
    """doc_id, label, turn: of each label the first documents by hash (turn), rows / number of labels of them at most.

    labelled (doc_id, label) is read three times, however many labels there are: to count them, for
    the ids with hashes below a bound that the counts give, and for the labels of these ids: the
    greatest of each. What is gathered is in proportion to `rows`.
    """
    spark = labelled.sparkSession
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", F.col("label").cast("string").alias("label"))
    schema = "doc_id long, label string, turn long"
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}  # one row a label
    if not counts:
        return spark.createDataFrame([], schema)
    most = max(1, rows // len(counts))
    turn = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    # so many of a label's ids have a hash below its bound that `most` of them are there, but for a chance of 1e-9
    wanted = 1.2 * most + 6 * most**0.5 + 50
    bounds = {x: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, wanted / max(1, n)) * (1 << 64))) for x, n in counts.items()}
    bound = F.create_map(*[F.lit(y) for x, b in bounds.items() for y in (x, b)])[F.col("label")]
    ids = known.withColumn("turn", turn).filter(F.col("turn") <= bound).groupBy("doc_id").agg(F.min("turn").alias("turn"))
    ids = written(ids, "turns")
    last = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "turn").agg(F.max("label").alias("label"))
    by: dict[str, list] = {x: [] for x in counts}
    for r in last.collect():
        by[r["label"]].append((r["turn"], r["doc_id"]))
    return spark.createDataFrame([(int(i), x, t) for x in sorted(by) for t, i in sorted(by[x])[:most]], schema)


def sample(docs: DataFrame, labelled: DataFrame, rows: int, size: int, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Texts and classes of at most `rows` documents, equally many of each class where there are as many, with at most `size` bytes.

    labelled has doc_id and label. Ids are taken in the order of their hashes, so that reruns agree;
    whole texts are taken, and one that does not fit into what is left of `size` is passed over. An id
    given more than once counts as its first text, so that the sample has at most `rows` texts.
    """
    spark = docs.sparkSession
    ids = chosen(labelled, rows, seed).withColumnRenamed("doc_id", "chosen")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("chosen"))
    held = written(found.groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text")), "sample")
    left, take = size, []
    by: dict[str, list] = {}
    for r in held.select("doc_id", "label", "turn", "size").collect():
        by.setdefault(r["label"], []).append((r["turn"], r["doc_id"], r["size"]))
    queues = [sorted(by[x]) for x in sorted(by)]
    for k in range(max(map(len, queues), default=0)):
        for q in queues:
            if k < len(q) and q[k][2] <= left:
                left -= q[k][2]
                take.append(q[k][1])
    if not take:
        return [], np.zeros(0, object)
    picked = spark.createDataFrame([(int(i),) for i in sorted(take)], "picked long")
    got = held.join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("label", "text", "turn").toArrow().sort_by([("turn", "ascending"), ("text", "ascending")])
    texts, classes = got.column("text").to_pylist(), np.array(got.column("label").to_pylist(), object)
    del got
    give_back()
    return texts, classes
