"""Operator 7: near-duplicates by fast similarity sketching, banding and exact verification.

1. Every row's shingle set gets a 128-bit fingerprint and a sketch of COORDINATES values (sketch.py).
   Rows with equal sets are one class, a node of what follows, so copies are never paired.
2. Nodes that agree in a whole band share a bucket. With 40 bands of 5 rows a pair of similarity
   0.75 misses all buckets with probability 2e-5.
3. Each bucket's members are verified against its least member on the full sets, and components of
   these links are found.
4. What such stars can miss is checked pair by pair, in buckets whose members are still in several
   components: members of the bucket's largest component meet those of others, and the others meet
   one another. Pairs that cannot be linked are left out: of too different sizes, with too many
   shingles that no other such node has (all exact bounds), or whose sketches agree in less than
   AGREE of the coordinates (8 standard deviations below 0.75, a chance of 1e-14). Large buckets are
   worked on in pairs of blocks, which have the full sets with them, so that only links come out.
   These join the components.

A bucket, a text or a leader that a large share of all rows has is met by broadcast or dealt over
tasks (shared.met, _with_set), so no task holds all rows of one.

Cases: rows, not ids, are the nodes, so an id on several rows with different texts is in the class of
each of them; a component's id is the least doc_id of its rows. Null or empty text has an empty set
and no links (component_id is its own id, kept); rows without id get component_id null, are linked
with nothing and kept; repeated rows have equal sets and are one class; very long texts are sets like
others; ties go to the least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.components import components
from parapet.llm.shared import HOT, bitmap, bitmap_bits, flagged, mapped, met, rounded, table, written
from parapet.llm.sketch import BANDS, COORDINATES, band_keys, fingerprints, shingle_sets, sketch
from parapet.llm.words import blocks

#: Links: 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
#: Least number of equal coordinates of a pair to be verified.
AGREE = 100
#: Members of a bucket that are compared with one another at once, about, and the bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: No key is above it.
LAST = np.iinfo(np.int64).max
#: Pairs of one node that are verified by a task, about, if the node has a large share of all.
DEALT = 256

SIGNED = "doc_id long, of long, n_shingles long, f1 long, f2 long, keys array<long>, coords binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in blocks(batch, "text"):
            sets, first = shingle_sets(data, offsets)
            s = sketch(sets, first)
            n = rows.num_rows
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band_keys(s).view(np.int64).ravel()))
            coords = pa.array([r.tobytes() for r in (s & np.uint64(255)).astype(np.uint8)], pa.binary())
            f1, f2 = fingerprints(sets, first)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(first)), pa.array(f1), pa.array(f2), keys, coords], ["doc_id", "of", "n_shingles", "f1", "f2", "keys", "coords"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in blocks(batch, "text"):
            sets, first = shingle_sets(data, offsets)
            raw = pa.array([sets[first[k] : first[k + 1]].tobytes() for k in range(rows.num_rows)], pa.binary())
            f1, f2 = fingerprints(sets, first)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(f1), pa.array(f2), raw], ["id", "f1", "f2", "set"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets are linked."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(both) - common)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))], bool)
        yield batch.select([0, 1]).filter(pa.array(ok))


def _attached(rows: DataFrame, counted: DataFrame, total: int, payload: DataFrame, side: str, spread: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of payload (node, ...) of the node in column `side`.

    counted are the rows, or a narrow table of them. A node with a large share of all rows (there are
    at most HOT) has its payload sent to several tasks, over which its rows are dealt by `spread`.
    """
    busy = counted.groupBy(side).agg(F.count("*").alias("n")).filter((F.col("n") > DEALT) & (F.col("n") * HOT > rounded(total)))
    busy = written(busy.select(F.col(side).alias("busy"), F.ceil(F.col("n") / DEALT).alias("parts")), "busy")
    bits = bitmap_bits(total)
    wanted = flagged(payload, F.col("node"), written(bitmap(counted, side, bits), "marks"), bits, "wanted").filter("wanted").drop("wanted")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.join(F.broadcast(busy), F.col(side) == F.col("busy"), "left").withColumn("part", F.pmod(F.xxhash64(*spread), parts)).drop("busy", "parts")
    held = wanted.join(F.broadcast(busy), F.col("node") == F.col("busy"), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(held.drop("busy", "parts").withColumnRenamed("node", side), [side, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of distinct pairs (a, b) of nodes whose full sets are similar."""
    pairs = written(pairs, "pairs")
    total = pairs.count()
    half = _attached(pairs, pairs, total, sets.withColumnRenamed("set", "set_b"), "b", ("a",))
    both = _attached(half, pairs, total, sets.withColumnRenamed("set", "set_a"), "a", ("b",))
    return mapped(both.select("a", "b", "set_a", "set_b"), _linked, "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        held = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        for k in range(0, len(ids), 500):
            part = held[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[k : k + 500], [len(x) for x in part])), pa.array(np.concatenate(part))], ["node", "shingle"])


def _shared(open_nodes: DataFrame) -> DataFrame:
    """node, shared: how many shingles of each open node (node, set) another one has too; nodes without any are not in it."""
    each = written(mapped(open_nodes.select("node", "set"), _shingles, "node long, shingle long"), "shingles")
    twice = written(each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    some = twice.agg(F.count("*").alias("shingles"), F.sum("n").alias("n")).first()
    bits = bitmap_bits(some["shingles"])
    maybe = flagged(each, F.col("shingle"), written(bitmap(twice, "shingle", bits), "marks"), bits, "twice").filter("twice").drop("twice")
    return met(maybe, twice, "shingle", some["n"] or 0).groupBy("node").agg(F.count("*").alias("shared"))


def _links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The links between members of a group that are in no bucket of a lesser key together.

    A group is a block of the bucket's main component with one of other members (i < 0: only pairs
    across count), or one or two blocks of other members (of two, only pairs across count).
    """
    nodes, comp, size, shared, block = (group.column(c).to_numpy() for c in ("node", "component", "n_shingles", "shared", "block"))
    coords = np.frombuffer(b"".join(group.column("coords").to_pylist()), np.uint8).reshape(len(nodes), COORDINATES)
    keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(len(nodes), BANDS)
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    if i == j:
        rows, others = np.arange(len(nodes)), None
    else:
        rows, others = np.flatnonzero(block == i), np.flatnonzero(block != i)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
    out = []
    for x in rows:
        y = np.arange(x + 1, len(nodes)) if others is None else others
        small, large = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
        may = (comp[y] != comp[x]) & (100 * small >= PERCENT * large) & ((100 + PERCENT) * np.minimum(shared[y], shared[x]) >= PERCENT * (size[y] + size[x]))
        y = y[may]
        y = y[np.count_nonzero(coords[y] == coords[x], axis=1) >= AGREE]
        if len(y):
            y = y[np.where(keys[y] == keys[x], keys[x], LAST).min(1) == key]  # in the bucket of the least key that both have in common
            out += [(nodes[x], nodes[k]) for k in y if similar(sets[x], sets[k])]
    return np.array([a for a, _ in out], np.int64), np.array([b for _, b in out], np.int64)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); a group may go over batches."""

    def made(t: pa.Table) -> pa.RecordBatch:
        a, b = _links(t)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]) if left is not None else t
        if not t.num_rows:
            continue
        at = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
        edges = [0, *cut.tolist()]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                yield made(t.slice(lo, hi - lo))
        left = t.slice(edges[-1]).combine_chunks()
    if left is not None and left.num_rows > 1:
        yield made(left)


def _per_bucket(members: DataFrame) -> DataFrame:
    """Of the buckets (key, component, n_shingles) whose members are in several components: key, main (the largest, the least of equals), n and n_main members, w and w_main shingles.

    Of buckets with the same members (by 128 bits) only that of the least key is in it, which is the
    one in which _links() looks at their pairs.
    """
    who = [F.xxhash64("node"), F.xxhash64("node", F.lit(1))]
    each = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"), F.bit_xor(who[0]).alias("h1"), F.bit_xor(who[1]).alias("h2"))
    turn = F.struct("c", -F.col("component"))
    per = each.groupBy("key").agg(F.max_by("component", turn).alias("main"), F.sum("c").alias("n"), F.max("c").alias("n_main"), F.sum("w").alias("w"), F.max_by("w", turn).alias("w_main"), F.count("*").alias("kinds"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    return per.filter("kinds > 1").groupBy("h1", "h2", "n").agg(F.min(F.struct("key", "main", "n_main", "w", "w_main")).alias("first")).select("first.*", "n")


def _blocks(members, shingles):
    """Blocks for so many members with so many shingles."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("long")


def _across(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of members dealt to groups (key, i, j) of two blocks each, as _links() has them: blocks of the main component are -1, -2 ..., those of others 0, 1 ..."""
    buckets = written(buckets, "buckets")
    held = met(members, buckets, "key", buckets.agg(F.sum("n")).first()[0] or 0)
    held = held.withColumn("mains", _blocks(F.col("n_main"), F.col("w_main"))).withColumn("rests", _blocks(F.col("n") - F.col("n_main"), F.col("w") - F.col("w_main")))
    is_main = F.col("component") == F.col("main")
    turn = F.xxhash64("node")
    block = F.when(is_main, -1 - F.pmod(turn, F.col("mains"))).otherwise(F.pmod(turn, F.col("rests")))
    rests = F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)
    # a member of the main component meets all blocks of others; another one also all blocks of the main one
    meets = F.when(is_main, rests).otherwise(F.concat(F.transform(F.sequence(F.lit(1).cast("long"), F.col("mains")), lambda x: -x), rests))
    dealt = held.withColumn("block", block).withColumn("other", F.explode(meets))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")


def _among(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The rows whose node is one of at most total nodes, and a few others: a bitmap tells, so that nothing is shuffled."""
    bits = bitmap_bits(total)
    return flagged(rows, F.col("node"), written(bitmap(nodes, "node", bits), "marks"), bits, "among").filter("among").drop("among")


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text), n_shingles, component (a node of it; null without set or id), component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"))
    signed = written(mapped(docs, _signed, SIGNED), "signed")
    same = ["f1", "f2", "n_shingles"]
    rated = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = rated.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("coords").alias("coords"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    # the leader is that of the least id, most likely the text that others were made from
    banded = reps.select("node", "id", F.explode("keys").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.min_by("node", "id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    some = buckets.agg(F.count("*").alias("keys"), F.sum("n").alias("n")).first()
    bits = bitmap_bits(some["keys"])
    # most keys are of one node, which a bitmap of the others tells where they are read
    shared_keys = flagged(banded.drop("id"), F.col("key"), written(bitmap(buckets, "key", bits), "marks"), bits, "shared").filter("shared").drop("shared")
    members = written(met(shared_keys, buckets, "key", some["n"] or 0).select("key", "node", "leader"), "members")
    involved = written(members.select("node").distinct().join(reps.select("node", "id", "f1", "f2"), "node"), "involved")
    bits = bitmap_bits(involved.count())
    wanted = flagged(docs.filter("doc_id IS NOT NULL"), F.col("doc_id"), written(bitmap(involved, "id", bits), "marks"), bits, "wanted").filter("wanted")
    key = ["id", "f1", "f2"]
    sets = mapped(wanted.select("doc_id", "text"), _sets, "id long, f1 long, f2 long, set binary")
    # a second bitmap, of fingerprints, keeps what the first let through from being shuffled
    sets = flagged(sets, F.col("f1"), written(bitmap(involved, "f1", bits), "marks"), bits, "wanted").filter("wanted").drop("wanted").dropDuplicates(key)
    sets = written(sets.join(involved, key).select("node", "set"), "sets")

    star = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_verified(star, sets), "links")
    found = written(components(links), "components")

    sizes = reps.select("node", "n_shingles")
    known = members.join(found, "node", "left").join(sizes, "node").select("key", "node", F.coalesce("component", "node").alias("component"), "n_shingles")
    known = written(known, "known")
    parted = written(_per_bucket(known), "parted")
    total = parted.agg(F.sum("n")).first()[0] or 0
    open_ = written(met(known, parted, "key", total).select("key", "node", "component", "n_shingles"), "open")
    # nodes that are not open only raise the number of shared shingles, which is a bound from above
    shared = _shared(_among(sets, open_, total)).join(sizes, "node").filter(F.col("shared") * 100 >= F.col("n_shingles") * PERCENT)
    shared = written(shared.join(open_.select("node").distinct(), "node", "left_semi"), "shared")
    able = shared.join(_among(reps.select("node", "keys", "coords"), shared, total), "node")
    able = written(able.join(_among(sets, shared, total), "node"), "able")
    narrow = written(open_.join(able.select("node"), "node"), "narrow")
    dealt = written(_across(narrow, _per_bucket(narrow)), "dealt")
    whole = _attached(dealt, dealt, dealt.count(), able, "node", ("key", "i", "j"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = mapped(whole.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j"), _paired, "a long, b long").distinct()
    found = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    named = written(reps.select(*same, "id", "copies", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"), "named")
    least = written(named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
    named = met(named, least, "component", least.agg(F.sum("n")).first()[0] or 0).select(F.struct(*same).alias("set"), F.col("copies"), "component", "component_id")
    named = written(named, "named")
    mine = rated.select("doc_id", "of", "n_shingles", F.struct(*same).alias("set"))
    out = met(mine, named, "set", named.agg(F.sum("copies")).first()[0] or 0, "copies").select("doc_id", "of", "n_shingles", "component", "component_id")
    none = F.lit(None).cast("long")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL")
    out = out.unionByName(alone.select("doc_id", "of", "n_shingles", none.alias("component"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return _nodes(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each class stays; equal rows with an id become one.

    Where an id has several texts of one class, that with the least hash stays; rows without a word
    or without id stay. Rows whose id no decision is about, which a bitmap of ids tells, are not shuffled.
    """
    found = written(_nodes(docs), "classes")
    row = ["doc_id", "of"]
    dropped = found.filter("NOT kept").select(*row)
    again = written(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    repeated = not again.isEmpty()
    if repeated:
        several = found.filter("kept AND component IS NOT NULL").join(again, "doc_id", "left_semi")
        first = several.groupBy("doc_id", "component").agg(F.min("of").alias("first"))
        dropped = dropped.unionByName(several.join(first, ["doc_id", "component"]).filter("of <> first").select(*row))
    dropped = written(dropped.distinct(), "dropped")
    ids = dropped.select("doc_id").unionByName(again).distinct()
    bits = bitmap_bits(ids.count())
    marks = written(bitmap(ids, "doc_id", bits), "marks")

    names = docs.columns
    id_ = docs["doc_id"].cast("long")
    placed = flagged(docs.withColumn("__id", id_), F.col("__id"), marks, bits, "__told")
    sure = placed.filter("NOT __told OR __id IS NULL").select(*names)
    told = placed.filter("__told AND __id IS NOT NULL").select(*names)
    if repeated:
        told = told.dropDuplicates()
    gone = dropped.select(F.col("doc_id").alias("__gone"), F.col("of").alias("__of"))
    left = told.join(gone, (told["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(told["text"]) == F.col("__of")), "left_anti")
    return sure.unionByName(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT a AS doc_id, b AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.reach), w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(min(r.reach), w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
GROUP BY w.doc_id
"""
