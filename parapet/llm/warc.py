"""Operator 4: WARC archives, index first.

Every task writes one archive of gzip members, one a record, into the shared folder and gives an
index row for each record: page, URL, digest, archive, offset, length. The index is a Parquet table,
so it names the archives of the attempts that counted, and of no other. Reading starts from the
index: its selected rows are sorted by archive and offset, neighbouring ranges are read together,
and each record is cut out of what was read, unpacked and checked against its digest.

Of pages with equal payloads of at least LEAST bytes the one with the largest id is kept as a
response; the others are revisits, records without payload that refer to it. Digests that occur more
than once are found on digests alone, and a bitmap of them is broadcast: pages that are like no other
are written where they are read, pages of very frequent payloads (of which there are few) meet these
by broadcast, and only the rest is dealt by digest.

Cases: null html is an empty payload; null page ids are responses that nothing refers to; repeated
rows are records each, and where they hold the largest id all are responses; ties in the largest id
are thereby responses; a very long page is one record, read back in one range; an empty table gives an
empty archive set and result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.shared import HOT, bitmap, bitmap_bits, flagged, mapped, new_path, table, written

LEAST = 0
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
#: Ranges at most so far apart are read at once, up to so many bytes.
GAP, SPAN = 1 << 16, 4 << 20
#: Bytes of archive that a reading task gets, about.
READ_BYTES = 8 << 20

INDEX = "page_id long, url string, digest string, archive string, start long, size long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page: int | None) -> str:
    return f"<urn:parapet:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of page `refers`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else _name(page)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: {_name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _page(name: str) -> int | None:
    part = name.rstrip(">").rpartition(":")[2]
    return None if part == "none" else int(part)


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of all rows of pages (page_id, url, html); their index."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    alike = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    alike = written(alike, "alike")
    known = alike.agg(F.count("*").alias("shas"), F.sum("n").alias("pages")).first()
    frequent = F.col("n") * HOT > (known["pages"] or 0)  # at most HOT payloads
    bits = bitmap_bits(known["shas"])
    told = flagged(rows, F.col("sha"), written(bitmap(alike, "sha", bits), "marks"), bits, "told")
    told = told.join(F.broadcast(alike.filter(frequent).select("sha", "top")), "sha", "left")
    refers = F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers")
    dealt = told.filter(~F.col("told") | F.col("top").isNotNull()).select("page_id", "url", "html", "sha", refers)
    rest = told.filter(F.col("told") & F.col("top").isNull()).drop("top").join(alike.filter(~frequent).select("sha", "top"), "sha", "left")
    dealt = dealt.unionByName(rest.select("page_id", "url", "html", "sha", refers))

    def written_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"  # of this attempt alone
        at, out = 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500).to_pydict()
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                starts, sizes, digests = [], [], []
                for page, url, text, sha, refers in zip(rows["page_id"], rows["url"], rows["html"], rows["sha"], rows["refers"]):
                    payload = text.encode()
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    data = packed(record(page, url, payload, digest, refers))
                    out.write(data)
                    starts.append(at)
                    sizes.append(len(data))
                    digests.append(digest)
                    at += len(data)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(digests, pa.string()), pa.array([name] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    ["page_id", "url", "digest", "archive", "start", "size"],
                )
        if out:
            out.close()

    index = written(mapped(dealt, written_archive, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def spans(start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the sorted ranges that are read together."""
    out, first = [], 0
    for k in range(1, len(start) + 1):
        if k == len(start) or start[k] > start[k - 1] + size[k - 1] + GAP or start[k] + size[k] - start[first] > SPAN:
            out.append((first, k))
            first = k
    return out if len(start) else []


def read(index: DataFrame) -> DataFrame:
    """The records that rows of an index name."""
    total = index.agg(F.sum("size")).first()[0] or 0
    n = 1 + int(total) // READ_BYTES

    def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            out = []
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and t["archive"][end] == t["archive"][at]:
                    end += 1
                fs, path = pa.fs.FileSystem.from_uri(t["folder"][at])
                start, size = np.array(t["start"][at:end]), np.array(t["size"][at:end])
                with fs.open_input_file(f"{path}/{t['archive'][at]}") as f:
                    for a, b in spans(start, size):
                        data = f.read_at(int(start[b - 1] + size[b - 1] - start[a]), int(start[a]))
                        for k in range(a, b):
                            lo = int(start[k] - start[a])
                            out.append((*_checked(data[lo : lo + int(size[k])], t["digest"][at + k]), t["url"][at + k]))
                at = end
            page, size, digest, kind, refers, url = (list(x) for x in zip(*out)) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    ranges = index.select("archive", "start", "size", "digest", "url", "folder").repartitionByRange(n, "archive", "start").sortWithinPartitions("archive", "start")
    return mapped(ranges, read_records, RECORD)


def _checked(data: bytes, digest: str) -> tuple:
    fields, http, payload = parse(zlib.decompress(data, 31))
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http["Content-Length"])
    refers = fields.get("WARC-Refers-To")
    if found != digest or (refers is None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest)):
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its index row")
    return _page(fields["WARC-Record-ID"]), size, found, fields["WARC-Type"], None if refers is None else _page(refers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
t AS (SELECT sha, max(page_id) AS top FROM p GROUP BY sha)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN t ON t.sha = p.sha
"""
