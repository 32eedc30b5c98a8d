"""Connected components of an edge table, by alternating large-star and small-star steps.

No step gathers a component: each takes minima over neighbours by partial aggregation and joins
them back, those of nodes with very many neighbours by broadcast (shared.met). Every round is
written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.shared import met, written


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """edges (u, v), u > v, at most total of them. Large: neighbours above u go to the least of u and its neighbours; small: those below, and u."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        moved = met(around, least, "u", 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = met(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), component being the least node; nodes without edges are not in it."""
    now = written(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    seen = (now.count(), None)
    for _ in range(most_rounds):
        state = seen
        stars = written(_star(now, seen[0], True), "stars")
        now = written(_star(stars, stars.count(), False), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
