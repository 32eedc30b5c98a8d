"""Operator 8: mixing sources to target weights.

Every document gets a random key, the MD5 of a seed and its id (without an id: its text). Within a
source documents are taken in key order: a key prefix splits a source into ranges, sums per range are
added up, over groups of ranges first, and the one range in which the source's budget ends is summed
key by key. So every source has a cut: whole epochs, then the keys below one, and of the document at
the cut the part that is left. A document's share follows from its own key and its source's cut, so
documents are neither sorted nor dealt, whatever share of them a source has.

Cases: null or empty text has size 0 and takes 0. A null source is a source of its own, last. An
empty table gives an empty result. Repeated rows count as often as they occur; ties in the key are
ordered by id, then size (only those at the cut are ordered); a very long text is one document, cut
where the budget ends. Other columns are ignored, or carried along where asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.llm.shared import met, prepared, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1:"
RESULTS = ("doc_id", "size", "source_size", "target", "taken")
#: Documents that a key range should hold at most, on average, of the largest source.
RANGE_ROWS = 1000
#: Sources whose sizes the driver takes; the targets of more are found by sorted ranges of sources.
SOURCES = 50_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, cap=CAP) -> dict[str | None, float]:
    """Words to take of each source: share of all words split by weight, none above cap times its size.

    Sources with the least cap a weight reach it first; what is over goes to the others by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    order = sorted(range(len(names)), key=lambda i: (float(cap * sizes[names[i]]) / weight[names[i]], i))
    budget, left = share * sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    spent, level = 0, None
    for i in order:
        s = names[i]
        if level is None and (budget - spent) / left <= float(cap * sizes[s]) / weight[s]:
            level = (budget - spent) / left
        out[s] = float(cap * sizes[s]) if level is None else level * weight[s]
        spent += cap * sizes[s]
        left -= weight[s]
    return out


def _ranked(df: DataFrame, order: list, place: str, sums: dict[str, str]) -> DataFrame:
    """df with the place (from 0) of each row in an order without ties, and for column: name of `sums` the sum of a column over the rows before.

    Rows are dealt by ranges of the order; what is gathered is one row a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranked")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = held.groupBy("range").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    first = per.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"first_{c}") for c in ("rows", *(f"all_{c}" for c in sums))])
    inner = Window.partitionBy("range").orderBy(*order)
    out = held.join(F.broadcast(first), "range").withColumn(place, F.col("first_rows") + F.row_number().over(inner) - 1)
    for c, name in sums.items():
        own = F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(name, F.col(f"first_all_{c}") + F.coalesce(own, F.lit(0)))
    return out.drop("range", "first_rows", *[f"first_all_{c}" for c in sums])


def planned(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source, source_size, target of sources (source, size): targets() of any number of sources."""
    named = _ranked(sources.select("source", "size"), [F.col("source").asc_nulls_last()], "i", {})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    full = F.lit(cap) * F.col("size")
    rated = named.withColumn("weight", weight).withColumn("full", full).withColumn("ratio", F.col("full").cast("double") / F.col("weight"))
    rated = written(_ranked(rated, [F.col("ratio"), F.col("i")], "k", {"full": "spent", "weight": "passed"}), "ranked")
    whole = rated.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["size"] is None:
        return rated.select("source", F.col("size").alias("source_size"), F.lit(0.0).alias("target"))
    level = (F.lit(share * whole["size"]) - F.col("spent").cast("double")) / (F.lit(whole["weight"]) - F.col("passed")).cast("double")
    first = rated.withColumn("level", level).filter("level <= ratio").agg(F.min_by(F.struct("k", "level"), "k").alias("first")).first()["first"]
    at, height = (first["k"], first["level"]) if first else ((1 << 62), 0.0)
    target = F.when(F.col("k") < at, F.col("full").cast("double")).otherwise(F.lit(height) * F.col("weight"))
    return rated.select("source", F.col("size").alias("source_size"), target.alias("target"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str):
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.coalesce("text", F.lit(""))))))


def _of(source):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("of")


def _cuts(keyed: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """of, source_size, target, epochs, rest, cut (the key at which the rest ends; null without words), first (words before it), n."""
    digits = max(1, math.ceil(math.log(max(1, most / RANGE_ROWS), 16)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    part = F.substring("key", 1, digits).alias("part")
    sums = written(keyed.filter("size > 0").groupBy("of", part).agg(F.sum("size").alias("words")).withColumn("group", F.substring("part", 1, digits // 2)), "ranges")
    groups = sums.groupBy("of", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("of", "group", F.coalesce(F.sum("words").over(earlier(Window.partitionBy("of").orderBy("group"))), F.lit(0)).alias("start"))
    before = F.col("start") + F.coalesce(F.sum("words").over(earlier(Window.partitionBy("of", "group").orderBy("part"))), F.lit(0))
    ends = lambda: (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    at = sums.join(groups, ["of", "group"]).withColumn("before", before).join(plan.select("of", "rest"), "of").filter(ends()).select("of", "part", "rest", "before")
    # the documents of one range of each source, key by key
    keys = keyed.filter("size > 0").select("of", part, "key", "size").join(at, ["of", "part"]).groupBy("of", "key", "rest", "before").agg(F.sum("size").alias("words"))
    first = F.col("before") + F.coalesce(F.sum("words").over(earlier(Window.partitionBy("of").orderBy("key"))), F.lit(0))
    cut = keys.withColumn("before", first).filter(ends()).select("of", F.col("key").alias("cut"), F.col("before").alias("first"))
    return plan.join(cut, "of", "left")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the carried columns, for each row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    prepared(spark)
    sized = docs.select("doc_id", "source", _key(seed).alias("key"), _size().alias("size"))
    keyed = written(sized.select("doc_id", "source", _of(F.col("source")), "size", "key"), "mix")
    sources = written(keyed.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sources")
    some = sources.agg(F.count("*").alias("sources"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    few = some["sources"] <= SOURCES
    if few:
        sizes = {r["source"]: r["size"] for r in sources.collect()}
        target = targets(sizes, weights, share, cap)
        plan = spark.createDataFrame([(s, sizes[s], target[s]) for s in sizes], "source string, source_size long, target double")
    else:
        plan = planned(sources, weights, share, cap)
    plan = plan.withColumn("budget", F.bround("target", 0).cast("long")).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.col("budget") - epochs * F.col("source_size")).otherwise(F.lit(0))
    cuts = written(_cuts(keyed, plan.select(_of(F.col("source")), "source_size", "target", epochs.alias("epochs"), rest.alias("rest"), "n"), some["most"] or 1), "cuts")
    if carried:  # the documents themselves, whose words are counted anew: they are neither sorted nor dealt
        rows = docs.select("doc_id", _of(F.col("source")), _key(seed).alias("key"), "text", F.struct(*[F.col(c) for c in carried]).alias("row"))
    else:
        rows = keyed.drop("source")
    placed = rows.join(F.broadcast(cuts), "of") if few else met(rows, cuts, "of", some["n"])
    at = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
    parts = [placed.filter(~at), placed.filter(at)]
    if carried:
        parts = [p.withColumn("size", _size()).drop("text") for p in parts]
    whole = F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("first") - inner))
    out = parts[0].withColumn("part", whole).unionByName(parts[1].withColumn("part", cut))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *[F.col(f"row.{c}").alias(c) for c in carried])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, '|' || coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, (2 * source_size)::DOUBLE / weight AS cap, row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, i) AS k FROM w),
l AS (
  SELECT *, ({SHARE} * (SELECT sum(source_size) FROM s)::DOUBLE
       - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
f AS (SELECT k AS fk, level AS flevel FROM l WHERE level <= cap ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN fk IS NULL OR k < fk THEN (2 * source_size)::DOUBLE ELSE flevel * weight END AS target
  FROM l LEFT JOIN f ON true),
b AS (SELECT *, round_even(target, 0)::BIGINT AS budget FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""
