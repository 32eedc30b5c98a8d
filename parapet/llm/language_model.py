"""Operator 5: language-model scores by a probabilistic suffix tree.

Learning and scoring. A symbol's probability depends on the DEPTH symbols before it alone. Blocks of
documents send their distinct (context, next symbol) with training counts (suffix_tree.py) to parts
by the last SPLIT symbols of the context. Counts of a part are added up in steps of at most FAN
partial sums, whatever the number of blocks. A part then has all counts of the longer contexts that
end so; with it blocks, SPAN of them at a time, make the divergence tests, each against the context
one symbol shorter, and get the logarithms of their entries. All contexts that pass are states; no
process holds the whole tree, and none holds what all blocks have of a part. Counts of pairs of
symbols (65,536 entries at most), which the shortest contexts need, are broadcast.

Base. Exact counts of all words are added up over the corpus in the same way: each block of documents
sends its distinct words to parts by hash, gets their totals back, and adds up its documents'
logarithms. The block's symbols are kept meanwhile, compressed.

Cases: null and empty texts are one end token; rows without id are scored but not learned from; an
empty table gives an empty result; without training rows counts are 0 and every symbol has
probability 1/256; repeated rows, and equal texts, have equal scores to the last bit (and count as
often); a very long text is a block by itself, scored in one piece; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.shared import fold, mapped, prepared, table, written
from parapet.llm.suffix_tree import COST, DEPTH, LEAST, SPLIT, found, grams, log_probabilities, shorter, summed, symbols, windows
from parapet.llm.words import LOWER, U64, Words, blocks, give_back, mix, per_document

FOLDS, HELD = 7, 2
#: Bytes of text in a block of documents, of which a part at a time is worked on.
BLOCK_BYTES = 8 << 20
#: Partial sums that are added up at once, and blocks that meet a part at once.
FAN, SPAN = 64, 256


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _opened(raw, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack_keys(key: np.ndarray) -> bytes:
    """Sorted distinct keys as their differences."""
    return len(key).to_bytes(8, "little") + _squeezed(np.diff(key, prepend=U64(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_opened(raw[8:], U64, int.from_bytes(raw[:8], "little")), dtype=U64)


def _pack_counts(count: np.ndarray) -> bytes:
    small = count.astype(np.uint8 if count.max(initial=0) < 256 else np.uint32 if count.max(initial=0) < 1 << 32 else np.int64)
    return small.dtype.itemsize.to_bytes(1, "little") + len(count).to_bytes(8, "little") + _squeezed(small)


def _counts(raw: bytes) -> np.ndarray:
    return _opened(raw[9:], {1: np.uint8, 4: np.uint32, 8: np.int64}[raw[0]], int.from_bytes(raw[1:9], "little")).astype(np.int64)


def _parts(docs: DataFrame) -> int:
    """Parts that counts are split into: a power of 2 that grows with the table's partitions as distinct words do with texts."""
    return 1 << max(3, int(8 * docs.rdd.getNumPartitions() ** 0.6).bit_length())


BLOCKS = "block string, what string, part int, keys binary, counts binary, ids array<long>, held array<boolean>, firsts array<int>, symbols binary"


def read_blocks(docs: DataFrame, parts: int, depth: int = DEPTH) -> DataFrame:
    """For each block of documents (doc_id, text, train, held_out): rows of its words and of its grams by part, and one (docs) of its documents with its pairs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = parts.bit_length() - 1
        types = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
        names = ["block", "what", "part", "keys", "counts", "ids", "held", "firsts", "symbols"]

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*values, *[None] * (len(types) - len(values))], types)], names)

        def dealt(block: str, what: str, key: np.ndarray, count: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                yield row(block, what, int(p), _pack_keys(key[at]), _pack_counts(count[at]))

        def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows, outs, firsts, words, counts = (list(x) for x in zip(*held))
            held.clear()
            block = uuid.uuid4().hex
            key, count = _merged(words)
            yield from dealt(block, "words", key, count, (key >> U64(64 - bits)).astype(np.uint16))
            key, count = _merged(counts)
            # the part is that of the last symbols of the context, so that longer contexts meet there
            tail = (key >> U64(8)) & U64((1 << (8 * SPLIT)) - 1)
            yield from dealt(block, "grams", key, count, (mix(tail) % U64(parts)).astype(np.uint16))
            pair, times = shorter(key[count > 0], count[count > 0], 1)
            before = np.cumsum([0, *(len(x) for x in outs[:-1])])
            first = np.concatenate([[0], *(f[1:] + b for f, b in zip(firsts, before))])
            column = lambda c: np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows])
            ids = [x for r in rows for x in r.column(0).to_pylist()]
            yield row(block, "docs", -1, _pack_keys(pair), _pack_counts(times), ids, column(3).astype(bool), first.astype(np.int32), _squeezed(np.concatenate(outs)))

        held, size = [], 0
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                w = Words(LOWER[data], offsets)
                out, first = symbols(w, len(offsets) - 1, depth)
                train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
                learned, rest = grams(out, first, train, depth), grams(out, first, ~train, depth)
                h, own = w.hashes(), np.repeat(train, np.diff(w.first))
                word, times = np.unique(h[own], return_counts=True)
                other = np.unique(h[~own])
                words = summed(np.concatenate([word, other]), np.concatenate([times, np.zeros(len(other), np.int64)]))
                both = summed(np.concatenate([learned[0], rest[0]]), np.concatenate([learned[1], np.zeros(len(rest[0]), np.int64)]))
                held.append((rows.select([0, 2, 2, 3]), out, first, words, both))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flushed(held)
                    size = 0
                    give_back()
        if held:
            yield from flushed(held)

    return mapped(docs.select("doc_id", "text", "train", "held_out"), read, BLOCKS)


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several parts, added up as they come, so that what is held at once is in proportion to the sum."""
    key, count = np.zeros(0, U64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > max(1 << 19, len(key)):
            key, count = summed(np.concatenate([key, *(x for x, _ in held)]), np.concatenate([count, *(y for _, y in held)]))
            held, size = [], 0
    return summed(np.concatenate([key, *(x for x, _ in held)]), np.concatenate([count, *(y for _, y in held)]))


SUMS = "part int, turn int, keys binary, counts binary, total long, types long"


def _sum(group: pa.Table) -> pa.Table:
    """Counts of some blocks, or partial sums, of one part as one row; without keys that have no count."""
    key, count = _merged((_keys(k.as_py()), _counts(c.as_py())) for k, c in zip(group.column("keys"), group.column("counts")))
    key, count = key[count > 0], count[count > 0]
    row = {"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "turn": pa.array([group.column("turn")[0].as_py()], pa.int32())}
    row |= {"keys": pa.array([_pack_keys(key)], pa.binary()), "counts": pa.array([_pack_counts(count)], pa.binary())}
    return pa.table(row | {"total": pa.array([int(count.sum())], pa.int64()), "types": pa.array([len(key)], pa.int64())})


def _turn(of: str, n: int):
    return F.pmod(F.crc32(of), F.lit(n)).cast("int").alias("turn")


def sums(read: DataFrame, what: str, blocks: int) -> DataFrame:
    """SUMS of all blocks' rows of a kind, one row a part: added up in steps, FAN rows of a part at a time."""
    n = max(1, -(-blocks // FAN))
    rows = read.filter(F.col("what") == what).select("part", _turn("block", n), "keys", "counts")
    while True:
        rows = written(rows.groupBy("part", "turn").applyInArrow(_sum, SUMS), what)
        if n == 1:
            return rows
        n = -(-n // FAN)
        rows = rows.select("part", F.pmod("turn", F.lit(n)).cast("int").alias("turn"), "keys", "counts")


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a part's sums, of which there may be none."""
    if not table.num_rows:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return _keys(table.column("keys")[0].as_py()), _counts(table.column("counts")[0].as_py())


def _meet(read: DataFrame, what: str, blocks: int, model: DataFrame, f, schema: str) -> DataFrame:
    """f(rows of up to SPAN blocks, sums) for each part; the sums of a part go to as many tasks as it has such groups."""
    n = max(1, -(-blocks // SPAN))
    rows = read.filter(F.col("what") == what).select("part", _turn("block", n), "block", "keys")
    held = model.select("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("turn"), "keys", "counts")
    return rows.groupBy("part", "turn").cogroup(held.groupBy("part", "turn")).applyInArrow(f, schema)


def scored_grams(read: DataFrame, blocks: int, pairs, depth: int = DEPTH, least: int = LEAST, cost: float = COST) -> DataFrame:
    """Of each block and part: its keys and their log10 probabilities (single precision)."""

    def part(rows: pa.Table, held: pa.Table) -> pa.Table:
        key, count = _counted(held)
        own = [_keys(k.as_py()) for k in rows.column("keys")]
        wanted = np.unique(np.concatenate([np.zeros(0, U64), *own]))
        log = log_probabilities(wanted, key, count, pairs.value, depth, least, cost).astype(np.float32)
        back = [_squeezed(log[np.searchsorted(wanted, k)]) for k in own]
        del own, wanted, log, key, count
        give_back()
        return pa.table({"block": rows.column("block"), "keys": rows.column("keys"), "logs": pa.array(back, pa.binary())})

    return _meet(read, "grams", blocks, sums(read, "grams", blocks), part, "block string, keys binary, logs binary")


def _totals(rows: pa.Table, held: pa.Table) -> pa.Table:
    """Of some blocks and one part: the totals of each block's words."""
    key, count = _counted(held)

    def back(raw: bytes) -> bytes:
        at, seen = found(key, _keys(raw))
        return _pack_counts(np.where(seen, count[at], 0) if len(key) else np.zeros(len(at), np.int64))

    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "totals": pa.array([back(k.as_py()) for k in rows.column("keys")], pa.binary())})


def score_symbols(out: np.ndarray, first: np.ndarray, key: np.ndarray, log: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the logarithms of each document's grams, first word of each document, hashes of words), some documents at a time."""
    scores, many, hashes = [], [], []
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 20), "right")) - 1)
        own, at = out[first[a] : first[b]], first[a : b + 1] - first[a]
        w = Words(own, at)
        hashes.append(w.hashes())
        many.append(np.diff(w.first))
        gram, real = windows(own, at, depth)
        distinct, place = np.unique(gram[real], return_inverse=True)
        each = np.zeros(len(own))
        each[depth:][real] = log[np.searchsorted(key, distinct)][place]
        scores.append(per_document(each, at))
        a = b
    return np.concatenate(scores), np.concatenate([[0], np.cumsum(np.concatenate(many))]), np.concatenate(hashes)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, cost: float = COST) -> DataFrame:
    """SCORED for each row of docs (doc_id, text), by a tree of contexts of up to `depth` symbols that occur `least` times or more."""
    spark = docs.sparkSession
    prepared(spark)
    rest = fold("doc_id", FOLDS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ((rest >= 0) & (rest != HELD)).alias("train"), (rest == HELD).alias("held_out"))
    read = written(read_blocks(docs, _parts(docs), depth), "blocks")
    n_blocks = read.filter("what = 'docs'").count()
    pair = sums(read, "docs", n_blocks).select("keys", "counts").toArrow()  # one row of at most 65,536 counts
    logs = written(scored_grams(read, n_blocks, spark.sparkContext.broadcast(_counted(pair)), depth, least, cost), "grams")
    words = sums(read, "words", n_blocks)
    totals = written(_meet(read, "words", n_blocks, words, _totals, "block string, part int, totals binary"), "totals")
    n_docs = docs.filter("train").count()
    found_words = words.agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    n, v = (found_words["n"] or 0) + n_docs, (found_words["v"] or 0) + (n_docs > 0)  # the end is a token and a type

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, held, firsts, packed, back, grammed = (batch.column(c)[k] for c in range(6))
                first = np.array(firsts.as_py(), np.int64)
                out = _opened(packed.as_py(), np.uint8, int(first[-1]))
                key = [_keys(x["keys"]) for x in grammed.as_py() or []]
                log = [_opened(x["logs"], np.float32, len(q)) for x, q in zip(grammed.as_py() or [], key)]
                key, log = np.concatenate(key), np.concatenate(log)
                order = np.argsort(key)
                key, log = key[order], log[order]
                scores, firsts_of_words, hashes = score_symbols(out, first, key, log, depth)
                del key, log, order, out
                of = [_counts(x["totals"]) for x in sorted(back.as_py() or [], key=lambda x: x["part"])]
                total = np.concatenate(of) if of else np.zeros(0, np.int64)
                _, place = np.unique(hashes, return_inverse=True)  # the parts are ranges of hashes
                log_of = lambda c: np.log10((c + 1) / (n + 1 * (v + 1)))
                known = per_document(total[place] > 0, firsts_of_words) + (n_docs > 0)
                base = per_document(log_of(total)[place].astype(np.float64), firsts_of_words) + log_of(np.int64(n_docs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.as_py(), pa.int64()), pa.array(held.as_py(), pa.bool_()), pa.array(np.diff(firsts_of_words) + 1), pa.array(known), pa.array(np.full(len(scores), n, np.int64)), pa.array(base), pa.array(scores)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del total, place, hashes
                give_back()

    back = totals.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("back"))
    grammed = logs.groupBy("block").agg(F.collect_list(F.struct("keys", "logs")).alias("grammed"))
    store = read.filter("what = 'docs'").select("block", "ids", "held", "firsts", "symbols")
    return mapped(store.join(back, "block", "left").join(grammed, "block", "left").select("ids", "held", "firsts", "symbols", "back", "grammed"), summed_up, SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
