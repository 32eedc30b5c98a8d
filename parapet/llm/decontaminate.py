"""Operator 10: benchmark decontamination with an FM-index per training shard.

The phrases are the benchmark's windows of WINDOW words (a shorter item is one phrase). A shard is
a run of documents; its index is built over the sequence of their words. Words that no phrase has
are separators, and stretches between them that are shorter than the shortest phrase are left out
of the sequence, as no phrase can occur there. All phrases are searched backwards together; rows
found are located by sampled suffix positions; overlapping occurrences merge to spans of hit words.

The benchmark's vocabulary and phrases are made by tasks and written to the shared folder, phrases in
blocks of about BLOCK_BYTES of text. A task that searches reads the vocabulary, builds the index of a
shard once and meets the blocks one after another, so documents are read once whatever the benchmark's
size, and no process holds more than a few blocks of it.

Cases: null or wordless texts have no words, no hits and the SHA-256 of an empty string; items
without words have no phrase; equal items are found each by its own id; items without id mark words
but are not listed; ties do not occur, as all occurrences count; an empty benchmark finds nothing;
empty documents give an empty result; repeated rows are alike; a very long text is a shard by itself;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.fm_index import FMIndex
from parapet.llm.shared import mapped, new_path, prepared, table
from parapet.llm.words import LOWER, NOT_ALNUM, U64, Words, blocks, give_back, inside, per_document, string_block

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
FILTER_BITS = 20
#: Blocks that a worker keeps from one task to the next.
KEPT = 4


class Vocabulary:
    """All words of a benchmark, by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> U64(64 - FILTER_BITS)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, from 1 on; 0 for words that the benchmark lacks."""
        out = np.zeros(len(h), np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.filter[h >> U64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == h[maybe], at + 1, 0)
        return out


class Phrases:
    """The distinct windows of some benchmark items, as rows of word numbers aligned at their ends, and the items that have each."""

    def __init__(self, names: list[str | None], texts: list[str | None], vocabulary: Vocabulary):
        data, offsets = string_block(pa.array(texts, pa.large_string()))
        w = Words(LOWER[data], offsets, NOT_ALNUM)
        number = vocabulary.numbers(w.hashes())
        self.names = sorted({x for x in names if x is not None})
        place = {name: k for k, name in enumerate(self.names)}
        item = np.array([-1 if x is None else place[x] for x in names], np.int64)
        at = np.flatnonzero(inside(w.first, WINDOW))
        rows, lengths, owners = [number[at[:, None] + np.arange(WINDOW)]], [np.full(len(at), WINDOW)], [item[w.document()[at]]]
        count = np.diff(w.first)
        for k in np.flatnonzero((count > 0) & (count < WINDOW)):
            row = np.zeros((1, WINDOW), np.int64)
            row[0, WINDOW - count[k] :] = number[w.first[k] : w.first[k + 1]]
            rows.append(row)
            lengths.append(count[k : k + 1])
            owners.append(item[k : k + 1])
        every = np.concatenate(rows).reshape(-1, WINDOW).astype(np.int32)
        self.rows, first, which = np.unique(every, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first]
        owners = np.concatenate(owners)
        pair = np.unique(which.ravel()[owners >= 0] * (len(self.names) + 1) + owners[owners >= 0])
        self.owners = pair % (len(self.names) + 1)
        self.owner_first = np.searchsorted(pair // (len(self.names) + 1), np.arange(len(self.rows) + 1))

    COLUMNS = {"rows": pa.binary(), "lengths": pa.binary(), "owners": pa.binary(), "owner_first": pa.binary(), "names": pa.list_(pa.string())}
    SCHEMA = "rows binary, lengths binary, owners binary, owner_first binary, names array<string>, shortest int"

    def packed(self) -> pa.Table:
        raw = lambda x, kind: pa.array([np.ascontiguousarray(x.astype(kind)).tobytes()], pa.binary())
        shortest = int(self.lengths.min(initial=WINDOW))
        return pa.table(
            {"rows": raw(self.rows, np.int32), "lengths": raw(self.lengths, np.int8), "owners": raw(self.owners, np.int64), "owner_first": raw(self.owner_first, np.int64)}
            | {"names": pa.array([self.names], pa.list_(pa.string())), "shortest": pa.array([shortest], pa.int32())}
        )

    @classmethod
    def opened(cls, row: dict) -> Phrases:
        out = cls.__new__(cls)
        out.rows = np.frombuffer(row["rows"], np.int32).reshape(-1, WINDOW).astype(np.int64)
        out.lengths = np.frombuffer(row["lengths"], np.int8).astype(np.int64)
        out.owners, out.owner_first = np.frombuffer(row["owners"], np.int64), np.frombuffer(row["owner_first"], np.int64)
        out.names = row["names"]
        return out


def _read(folder: str, columns: dict[str, pa.DataType]) -> pa.dataset.Dataset:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    return pa.dataset.dataset(path, filesystem=fs, format="parquet", schema=pa.schema(list(columns.items())))


def _vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(_read(folder, {"word": pa.int64()}).to_table().column("word").to_numpy().view(U64))


#: What a worker has read of the store that it used last.
_held: dict = {}


@dataclass(frozen=True)
class Store:
    """A benchmark's vocabulary and blocks of phrases in the shared folder."""

    folder: str
    blocks: int
    shortest: int

    def vocabulary(self) -> Vocabulary:
        if _held.get("folder") != self.folder:
            _held.clear()
            _held.update(folder=self.folder, vocabulary=_vocabulary(f"{self.folder}/vocabulary"))
        return _held["vocabulary"]

    def phrases(self) -> Iterator[Phrases]:
        if "phrases" in _held:
            yield from _held["phrases"]
            return
        rows = (Phrases.opened(r) for batch in _read(f"{self.folder}/phrases", Phrases.COLUMNS).to_batches(batch_size=1, batch_readahead=0, fragment_readahead=0) for r in batch.to_pylist())
        if self.blocks <= KEPT:
            _held["phrases"] = list(rows)
            rows = _held["phrases"]
        yield from rows


def store(benchmark: DataFrame) -> Store:
    """The store of a benchmark (item_id, text), made by tasks."""
    spark = benchmark.sparkSession
    prepared(spark)
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    folder = new_path(spark, "benchmark")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch, "t"):
                h = np.unique(Words(LOWER[data], offsets, NOT_ALNUM).hashes())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["word"])

    mapped(rows.select("t"), words, "word long").distinct().write.parquet(f"{folder}/vocabulary")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES

    def phrases(group: pa.Table) -> pa.Table:
        return Phrases(group.column("i").to_pylist(), group.column("t").to_pylist(), _vocabulary(f"{folder}/vocabulary")).packed()

    # rows of one id meet in a block; those without id are dealt by their texts
    part = F.pmod(F.xxhash64(F.coalesce("i", "t")), F.lit(n)).alias("part")
    rows.select("i", "t", part).groupBy("part").applyInArrow(phrases, Phrases.SCHEMA).write.parquet(f"{folder}/phrases")
    made = spark.read.schema(Phrases.SCHEMA).parquet(f"{folder}/phrases").agg(F.count("*").alias("n"), F.min("shortest").alias("shortest")).first()
    return Store(folder, made["n"], WINDOW if made["shortest"] is None else made["shortest"])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k]+1, ... (count[k] of them) for each k."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)


class Shard:
    """Words of some documents, reduced to the stretches in which a phrase can occur."""

    def __init__(self, store: Store):
        self.store, self.vocabulary = store, store.vocabulary()
        self.words, self.docs = 0, 0
        self.parts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = [np.zeros(1, np.int64)]

    def add(self, w: Words) -> None:
        number = self.vocabulary.numbers(w.hashes())
        known = number > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        edge = w.first[1:-1]
        edge = edge[edge < len(known)]
        begin[edge] = known[edge]
        start = np.flatnonzero(begin)
        stop = known.copy()
        stop[:-1] &= ~known[1:]
        stop[edge[edge > 0] - 1] = known[edge[edge > 0] - 1]
        end = np.flatnonzero(stop) + 1
        long_ = end - start >= self.store.shortest
        start, end = start[long_], end[long_]
        # each stretch, and a separator
        at = _spread(start, end - start + 1)
        last = np.cumsum(end - start + 1) - 1
        part = number[np.minimum(at, len(number) - 1)] if len(number) else at
        part[last] = 0
        self.parts.append(part)
        self.places.append(at + self.words)
        self.firsts.append(w.first[1:] + self.words)
        self.words += len(number)
        self.docs += len(w.first) - 1

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each document and the end, hit flag of each word, documents and names of the items found in them, sorted by both)."""
        first = np.concatenate(self.firsts)
        step = np.zeros(self.words + 1, np.int64)
        docs, names = [np.zeros(0, np.int64)], [np.zeros(0, "U1")]
        s = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        if len(s) and len(self.vocabulary.hashes):
            index = FMIndex(s, len(self.vocabulary.hashes))
            places = np.concatenate(self.places)
            for p in self.store.phrases():
                which, lo, hi = index.search(p.rows, p.lengths)
                place = places[index.locate(_spread(lo, hi - lo))]
                which = np.repeat(which, hi - lo)
                step += np.bincount(place, minlength=self.words + 1) - np.bincount(place + p.lengths[which], minlength=self.words + 1)
                pair = np.unique((np.searchsorted(first, place, "right") - 1) * (len(p.rows) + 1) + which)
                doc, which = pair // (len(p.rows) + 1), pair % (len(p.rows) + 1)
                count = p.owner_first[which + 1] - p.owner_first[which]
                pair = np.unique(np.repeat(doc, count) * (len(p.names) + 1) + p.owners[_spread(p.owner_first[which], count)])
                docs.append(pair // (len(p.names) + 1))
                names.append(np.array(p.names or [""])[pair % (len(p.names) + 1)])
        doc, name = np.concatenate(docs), np.concatenate(names)
        order = np.lexsort((name, doc))
        return first, np.cumsum(step)[: self.words] > 0, doc[order], name[order]


FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<int>"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND for each row of docs (doc_id, text). items: names of the items found, sorted; spans: begin and end (words) of hit stretches."""
    held = store(benchmark)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, size = Shard(held), [], 0
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                shard.add(Words(LOWER[data], offsets, NOT_ALNUM))
                ids.append(rows.column(0))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield found(shard, ids)
                    shard, ids, size = Shard(held), [], 0
        if ids:
            yield found(shard, ids)

    def found(shard: Shard, ids: list) -> pa.RecordBatch:
        first, hit, doc, item = shard.find()
        many = np.bincount(doc, minlength=shard.docs)
        inner = first[1:-1]
        begin, end = hit.copy(), hit.copy()
        begin[1:] &= ~hit[:-1]
        end[:-1] &= ~hit[1:]
        inner = inner[(inner > 0) & (inner < len(hit))]
        begin[inner] = hit[inner]
        end[inner - 1] = hit[inner - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        owner = np.searchsorted(first, begin, "right") - 1
        spans = np.stack([begin - first[owner], end - first[owner]], 1).ravel().astype(np.int32)
        lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.array(np.diff(first)),
                pa.array(per_document(hit, first)),
                lists(pa.array(item.tolist(), pa.string()), many),
                lists(pa.array(spans), 2 * np.bincount(owner, minlength=shard.docs)),
            ],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), searched, FOUND)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return search(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit stretches taken out of their texts; documents left without a word go.

    What a cut brings together is searched again, until no phrase is left.
    """
    held = store(benchmark)
    columns = docs.columns

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", SHARD_BYTES):
                yield cleaned(rows, data, offsets)
                give_back()

    def cleaned(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        texts: dict[int, str] = {}
        todo = np.arange(rows.num_rows)
        while len(todo):
            w = Words(LOWER[data], offsets, NOT_ALNUM)
            shard = Shard(held)
            shard.add(w)
            hit = shard.find()[1]
            dirty = np.flatnonzero(per_document(hit, w.first) > 0)
            for d in dirty:
                raw, out, at = data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                flags = hit[w.first[d] : w.first[d + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for a, b in zip(edge[::2], edge[1::2]):
                    out.append(raw[at : w.starts[w.first[d] + a] - offsets[d]])
                    at = w.ends[w.first[d] + b - 1] - offsets[d]
                texts[int(todo[d])] = b" ".join([*out, raw[at:]]).decode()
            todo = todo[dirty]
            data, offsets = string_block(pa.array([texts[int(k)] for k in todo], pa.large_string()))
        if not texts:
            return rows
        text = rows.column(columns.index("text")).to_pylist()
        keep = np.ones(rows.num_rows, bool)
        for k, t in texts.items():
            text[k] = t
            keep[k] = bool(t.strip(" \t\n\v\f\r"))
        place = columns.index("text")
        arrays = list(rows.columns)
        arrays[place] = pa.array(text, pa.string())
        if "n_chars" in columns:
            size = rows.column(columns.index("n_chars")).to_pylist()
            for k, t in texts.items():
                size[k] = len(t)
            arrays[columns.index("n_chars")] = pa.array(size, rows.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(arrays, rows.schema.names).filter(pa.array(keep))

    return mapped(docs, cut_rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 10 THEN [words]
        ELSE list_transform(range(1, len(words) - 8), lambda i: words[i:i + 9]) END) AS phrase FROM b),
q AS (SELECT item_id, array_to_string(phrase, ' ') AS phrase, len(phrase) AS size FROM p),
z AS (SELECT DISTINCT size FROM q),
o AS (SELECT doc_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase
      FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d, z WHERE len(words) >= size)),
f AS (SELECT o.doc_id, o.pos, o.size, q.item_id FROM o JOIN q USING (phrase)),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS w FROM f) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
