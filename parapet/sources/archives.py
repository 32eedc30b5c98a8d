"""Package archives as a files relation."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parapet.ship import mapped

FILES = "pkg_id string, path string, content binary, src string, error string"


#: Bytes of files that are sent on together (a larger file goes by itself).
BATCH_BYTES = 64 << 20


class Refused(ValueError):
    """An archive that breaks a limit or leaves its folder."""


def sanitize(raw: str) -> str:
    """A clean relative path with forward slashes; anything with '..' in it, and absolute paths, are refused."""
    path = posixpath.normpath(raw.replace("\\", "/"))
    if ".." in path or path.startswith("/"):
        raise Refused(f"path leaves the archive: {raw}")
    return path


class _Gunzip:
    """What a gzip stream holds up to its first fault, which is remembered."""

    def __init__(self, data: bytes) -> None:
        self.file = gzip.GzipFile(fileobj=io.BytesIO(data))
        self.fault: Exception | None = None

    def read(self, n: int) -> bytes:
        try:
            return self.file.read1(n)
        except (EOFError, OSError, zlib.error) as e:
            self.fault = e
            return b""


def unpack(data: bytes, max_files: int, max_file_bytes: int, max_total_bytes: int) -> dict[str, bytes]:
    """The regular files of a .tgz; of one path the last counts. Limits refuse the archive as a whole.

    So does an archive that breaks off before its end mark: what it lost is not known.
    """
    out: dict[str, bytes] = {}
    total = seen = 0
    stream = _Gunzip(data)
    with tarfile.open(fileobj=stream, mode="r|") as tar:
        for member in tar:
            if not member.isreg():
                continue
            path = sanitize(member.name)
            seen += 1
            if seen > max_files:
                raise Refused("too many files")
            if member.size > max_file_bytes:
                raise Refused(f"file too large: {path}")
            content = tar.extractfile(member).read(max_file_bytes + 1)
            total += len(content)
            if total > max_total_bytes:
                raise Refused("archive too large")
            out[path] = content
        # an end mark is a block of its own; the stream may also end cleanly between blocks
        left = tar.fileobj.tell() - tar.offset
        if left < tarfile.BLOCKSIZE and (stream.fault or left):
            raise Refused(f"archive breaks off: {stream.fault or 'part of a header'}")
    return out


def files(archives: DataFrame, limits) -> DataFrame:
    """FILES of archives (pkg_id, content); a refused archive is one row with its error.

    Archives are opened one at a time and their files sent on in small batches.
    """
    bounds = (limits.max_files, limits.max_file_bytes, limits.max_total_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pkg, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    found = [(p, c, c.decode("utf-8", "replace"), None) for p, c in sorted(unpack(data, *bounds).items())]
                except (Refused, tarfile.TarError, EOFError, OSError, TypeError) as e:
                    found = [(None, None, None, str(e) or type(e).__name__)]
                at = 0
                while at < len(found):  # 64 files, or fewer large ones
                    to, size = at + 1, len(found[at][1] or b"")
                    while to < min(at + 64, len(found)) and size + len(found[to][1]) <= BATCH_BYTES:
                        size += len(found[to][1])
                        to += 1
                    path, content, src, error = zip(*found[at:to])
                    at = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pkg] * len(path), pa.string()), pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(src, pa.string()), pa.array(error, pa.string())], ["pkg_id", "path", "content", "src", "error"]
                    )

    return mapped(archives.selectExpr("cast(pkg_id as string) pkg_id", "content"), rows, FILES)


def archive_files(spark: SparkSession, path: str, glob: str = "*.tgz") -> DataFrame:
    """Archives below a folder: pkg_id (the path), content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.selectExpr("path as pkg_id", "content")


def common_prefix(names: list[str]) -> str:
    """The leading folder that all names share, with its slash; '' if none."""
    heads = {n.split("/", 1)[0] for n in names if n}
    return f"{heads.pop()}/" if len(heads) == 1 and all("/" in n for n in names if n) else ""


def from_zip(data: bytes, password: bytes | None = None) -> bytes:
    """The .tgz of an encrypted sample: the one inside, or its files below package/ packed anew. Nothing is run."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        inner = [n for n in names if n.endswith((".tgz", ".tar.gz"))]
        if inner:
            return z.read(inner[0], pwd=password)
        prefix = common_prefix(names)
        root = next((n[: -len("package.json")] for n in sorted(names, key=lambda n: (n.count("/"), n)) if posixpath.basename(n) == "package.json"), prefix)
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for n in names:
                if n.startswith(root):
                    content = z.read(n, pwd=password)
                    info = tarfile.TarInfo("package/" + n[len(root) :])
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
        return out.getvalue()


def from_zips(zips: DataFrame, password: bytes | None = None) -> DataFrame:
    """S17 as a relation: zips (pkg_id, content) to archives (pkg_id, content, error), one opened at a time; content is null where it cannot be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = error = None
                try:
                    content = from_zip(batch.column(1)[k].as_py(), password)
                except (zipfile.BadZipFile, RuntimeError, EOFError, OSError, TypeError, ValueError, zlib.error) as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["pkg_id", "content", "error"])

    return mapped(zips.selectExpr("cast(pkg_id as string) pkg_id", "content"), rows, "pkg_id string, content binary, error string")
