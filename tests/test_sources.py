import json
import tarfile

import pytest
from pyspark.sql import functions as F

from parapet.config import load
from parapet.plans import scoring
from parapet.queries import sources as queries
from parapet.sources import archives, registry


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "left.json").write_text(json.dumps(queries.DOCUMENT))
    docs = registry.documents(spark, str(tmp_path))
    assert docs.first().name == "left"
    assert {r.maintainer for r in registry.maintainers(docs).collect()} == {"ann", "bob"}
    p = registry.packages(docs).first()
    assert p.latest == "1.0.1" and p.created.year == 2020
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(Exception):
        registry.documents(spark, str(tmp_path)).collect()


def test_version_document(spark):
    raw = spark.createDataFrame([(json.dumps(queries.DOCUMENT["versions"]["1.0.1"]),), ("{",)], "document string")
    got = registry.version_documents(raw).filter("doc.version IS NOT NULL").select("doc.version", registry.license_text(F.col("doc.license")).alias("license"), "doc.dist.unpackedSize").collect()
    assert [tuple(r) for r in got] == [("1.0.1", "GPL-3.0", 9)]


def test_calibration_runs(spark):
    rows = [(n, bytearray(queries.tgz(f))) for n, f in queries.PACKAGES.items()] + [("noise", bytearray(b"x"))]
    config = load(env={}, layer3={"entropy_min_string_len": 20})
    files = archives.files(spark.createDataFrame(rows, "pkg_id string, content binary"), config.extractor)
    corpus = spark.createDataFrame([("clean", "malicious", True), ("hidden", "malicious", False)], "pkg_id string, label string, osv_vulnerable boolean")
    found = {(r.pkg_id, r.rule) for r in scoring.calibration_runs(corpus, files, config).collect()}
    assert ("clean", "osv_known_vulnerability") in found and ("hidden", "sink_with_obfuscation") in found
    assert [r.pkg_id for r in scoring.dropped(files).collect()] == ["noise"]
    stripped = {r.rule for r in scoring.calibration_runs(corpus, files, config, strip_advisories=True).collect()}
    assert "osv_known_vulnerability" not in stripped


def test_calibration_unpacks_large_samples(spark):
    """A file beyond the production limit is a run in calibration."""
    config = load(env={})
    large = queries.tgz([("package/index.js", b"eval(x)"), ("package/lib.node", b"\0" * (config.extractor.max_file_bytes + 1))])
    found = spark.createDataFrame([("large", bytearray(large))], "pkg_id string, content binary")
    corpus = spark.createDataFrame([("large", "malicious", False)], "pkg_id string, label string, osv_vulnerable boolean")
    assert [r.pkg_id for r in scoring.dropped(archives.files(found, config.extractor)).collect()] == ["large"]
    assert scoring.dropped(scoring.calibration_files(found, config)).count() == 0
    assert "sink_eval" in {r.rule for r in scoring.calibration_runs(corpus, found, config).collect()}
    limits = config.calibration
    assert (limits.max_files, limits.max_file_bytes, limits.max_total_bytes) == (100000, 100 << 20, 2 << 30)


def test_cut_archives_are_refused():
    """An archive cut anywhere is refused unless its end mark is there; what follows the mark does not count."""
    whole = queries.tgz([("package/package.json", b"{}"), ("package/a.js", b"x" * 5000), ("package/b.js", b"1" * 30)])
    for n in range(len(whole)):
        try:
            assert len(archives.unpack(whole[:n], 10, 10**6, 10**7)) == 3
        except (archives.Refused, tarfile.TarError):
            assert n < len(whole) - 1
    assert len(archives.unpack(whole + b"garbage", 10, 10**6, 10**7)) == 3


def test_zip_relation(spark):
    zips = [("a", bytearray(queries.zipped([("p/x.js", b"1")]))), ("b", None), ("c", bytearray(b"PK"))]
    got = {r.pkg_id: (r.content is None, r.error is None) for r in archives.from_zips(spark.createDataFrame(zips, "pkg_id string, content binary")).collect()}
    assert got == {"a": (False, True), "b": (True, False), "c": (True, False)}


def test_dropped_entries_have_no_advisory(spark):
    rows = [("noise", bytearray(b"x"))]
    corpus = spark.createDataFrame([("noise", "malicious", True)], "pkg_id string, label string, osv_vulnerable boolean")
    assert scoring.calibration_runs(corpus, spark.createDataFrame(rows, "pkg_id string, content binary"), load(env={})).count() == 0
