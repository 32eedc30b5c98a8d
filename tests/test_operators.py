import json
import tarfile

import pytest
from pyspark.sql import functions as F

from parapet import rules, sinks
from parapet.config import dump, load
from parapet.operators import calibrate, policy, versions
from parapet.plans import scoring
from parapet.queries import calibration, sources as source_queries
from parapet.schema import SIGNALS
from parapet.sources import archives, lists, registry


def bag(spark, rows):
    """signals of (pkg, rule, score, veto)."""
    return spark.createDataFrame([(p, r, str(s), v) for p, r, s, v in rows], "pkg_id string, rule string, s string, veto boolean").select("pkg_id", "rule", F.col("s").cast("decimal(18,9)").alias("score"), "veto", F.lit("").alias("cwe"), F.lit("").alias("matched"), F.lit("").alias("detail"))


@pytest.mark.parametrize(
    "rows, gate, want",
    [
        ([], 0, ("allow", 0.0)),
        ([("capability_exec", 0.29, False)], 0, ("allow", 0.29)),
        ([("capability_exec", 0.30, False)], 0, ("warn", 0.30)),
        ([("capability_exec", 0.30, False)], 2, ("allow", 0.30)),
        ([("capability_exec", 0.2, False), ("sink_eval", 0.1, False)], 2, ("warn", 0.30)),
        ([("capability_exec", 0.1, False), ("sink_eval", 0.6, False)], 0, ("block", 0.7)),
        ([("capability_exec", 0.9, False)], 5, ("block", 0.9)),
        ([("capability_exec", 0.9, False), ("sink_eval", 0.9, False)], 0, ("block", 1.0)),
        ([("osv_known_vulnerability", 0.0, True)], 5, ("block", 1.0)),
        ([("capability_exec", 0.2, False), ("capability_exec", 0.2, False)], 2, ("allow", 0.4)),
    ],
)
def test_decide(spark, rows, gate, want):
    packages = spark.createDataFrame([("p",)], "pkg_id string")
    d = policy.decide(packages, bag(spark, [("p", *r) for r in rows]), load(env={}, policy={"min_categories": gate})).first()
    assert (d.verdict, float(d.score)) == want


def test_combos(spark):
    base = bag(spark, [("p", r, 0.1, False) for r in ("typosquat_close", "install_script_external_url_install", "capability_exec", "obfuscation_high_entropy")])
    config = load(env={})
    once = policy.with_combos(base, config)
    assert {r.rule for r in once.collect()} >= set(rules.COMBOS)
    assert policy.combo_signals(once, config).count() == 0
    off = load(env={}, combo={c + "_score": 0.0 for c in rules.COMBOS})
    assert policy.combo_signals(base, off).count() == 0


def test_capability_diff_only_where_scripts_differ(spark):
    row = "pkg_id string, version string, previous string, scripts map<string,string>, previous_scripts map<string,string>, caps array<string>, previous_caps array<string>"
    pairs = spark.createDataFrame([("a", "1.0.1", "1.0.0", {}, {}, ["exec"], []), ("b", "1.0.1", "1.0.0", {}, {"install": "x"}, ["exec", "net_access"], []), ("c", "1.1.0", "1.0.0", {}, {"install": "x"}, ["exec"], [])], row)
    config = load(env={})
    assert {(r.pkg_id, r.rule) for r in versions.capability_diff(pairs, config).collect()} == {("b", "version_diff_new_exec_in_patch"), ("b", "version_diff_new_net_in_patch")}
    assert {r.pkg_id for r in versions.capability_diff(pairs, config, deep="always").collect()} == {"a", "b"}
    assert versions.script_diff(pairs, config).count() == 0


def test_config(tmp_path):
    c = load(env={"PROXY_POLICY_ALLOW": "1", "PROXY_CACHE_REDIS_ADDR": "x", "PROXY_RECHECK_ENABLED": "false"})
    assert c.policy.allow_threshold == 0.30 and c.recheck.enabled is False
    path = tmp_path / "c.yaml"
    sinks.write_config(c, {**rules.default_weights(c), "cap_exec": 0.77}, str(path))
    back = load(str(path), env={})
    assert back.layer3.capability_exec_score == 0.77 and back.layer1.typosquat_close_score == 0.55
    dump(back, str(path))
    assert rules.default_weights(load(str(path), env={}))["cap_exec"] == 0.77


def test_manifest_of_several(spark):
    found = {r.pkg_id: r.scripts for r in registry.manifests(spark.createDataFrame(source_queries.MANIFESTS, "pkg_id string, path string, src string")).collect()}
    assert found == {"a": {"install": "node x"}, "b": {}, "f": {"prepare": "p", "test": "t"}}


def test_archives_from_disk(spark, tmp_path):
    (tmp_path / "x.tgz").write_bytes(source_queries.tgz([("package/a.js", "é".encode()), ("package/b", b"\xff")]))
    got = archives.files(archives.archive_files(spark, str(tmp_path)), load(env={}).extractor).collect()
    assert {(r.path, r.src) for r in got} == {("package/a.js", "é"), ("package/b", "�")}
    with pytest.raises(archives.Refused):
        archives.sanitize("/x")
    with pytest.raises(archives.Refused):
        archives.sanitize("a/..b")


def test_zip_samples(tmp_path):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("pkg-1/package.json", "{}")
        z.writestr("pkg-1/lib/a.js", "1")
    inner = archives.from_zip(out.getvalue())
    assert set(archives.unpack(inner, 9, 99, 99)) == {"package/package.json", "package/lib/a.js"}
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("s/x.tgz", inner)
    assert archives.from_zip(whole.getvalue()) == inner
    assert archives.common_prefix(["a/b", "a/c"]) == "a/" and archives.common_prefix(["a/b", "c"]) == ""


def test_retries():
    import io
    import urllib.error

    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b"x" * 20)

    assert registry.get("http://r", retries=2, limit=9, opener=opener, sleep=waits.append) == b"x" * 9
    assert waits == [0.5, 2.0]

    def missing(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        registry.get("http://r", opener=missing, sleep=waits.append)


def test_corpus(spark, tmp_path):
    row = {"name": "a", "version": "1", "tarball": "t.tgz", "osv_vulnerable": True}
    (tmp_path / "malicious").mkdir()
    (tmp_path / "malicious/labels.jsonl").write_text(json.dumps(row) + "\n")
    got = lists.corpus(spark, str(tmp_path)).collect()
    assert [(r.name, r.label, r.osv_vulnerable) for r in got] == [("a", "malicious", True)]
    lists.append_labels(spark.createDataFrame([("b", "1", "t")], "name string, version string, tarball string"), str(tmp_path / "more"))
    (tmp_path / "benign").mkdir()
    (tmp_path / "benign/labels.jsonl").write_text('{"name": "x"}\n')
    with pytest.raises(ValueError):
        lists.corpus(spark, str(tmp_path))
    with pytest.raises(ValueError):
        lists.corpus(spark, str(tmp_path / "none"))


def test_name_list(spark, tmp_path):
    path = tmp_path / "top" / "list.txt"
    lists.write_names(spark.createDataFrame([("b",), ("a",)], "name string").orderBy("name"), str(path), ["two names"])
    assert path.read_text() == "# two names\na\nb\n"
    assert [r.name for r in lists.package_list(lists.read_lines(spark, str(path)), 1).collect()] == ["a"]


def test_staged_scoring(spark):
    """A package that names block is not scanned; a vetoed manifest ends the scan; others go through all layers."""
    packages = spark.createDataFrame([("bad", "raect", "1"), ("piped", "fine-name", "1"), ("hidden", "other", "1"), ("none", "nothing", "1")], "pkg_id string, name string, version string").withColumn("created", F.lit("2020-01-01").cast("timestamp"))
    bodies = {"bad": "piped", "piped": "piped", "hidden": "hidden"}
    rows = [(p, bytearray(source_queries.tgz(source_queries.PACKAGES[b]))) for p, b in bodies.items()]
    config = load(env={}, layer3={"entropy_min_string_len": 20})
    files = archives.files(spark.createDataFrame(rows, "pkg_id string, content binary"), config.extractor)
    none = lambda schema: spark.createDataFrame([], schema)
    s = scoring.Snapshot(
        packages,
        none("pkg_id string, version string, ts timestamp"),
        none("pkg_id string, maintainer string"),
        none("pkg_id string, monthly long"),
        none("maintainer string, created timestamp"),
        spark.createDataFrame([("raect", "1")], "name string, version string"),
        spark.createDataFrame([("react",)], "name string"),
        files.filter("error IS NULL"),
    )
    signals, decisions = scoring.score(s, F.to_timestamp(F.lit("2024-01-01 00:00:00")), config)
    by = {}
    for r in signals.collect():
        by.setdefault(r.pkg_id, set()).add(r.rule)
    assert by["bad"] == {"typosquat_close", "osv_known_vulnerability"}
    assert by["piped"] == {"install_script_curl_pipe_postinstall"}
    assert by["hidden"] == {"capability_dynamic_eval", "obfuscation_high_entropy", "sink_with_obfuscation"}
    assert {r.pkg_id: r.verdict for r in decisions.collect()} == {"bad": "block", "piped": "block", "hidden": "block", "none": "allow"}


def test_search_separates(spark):
    rows = [(f"b{i}", "metadata_single_maintainer", 0.05, False) for i in range(20)] + [(f"m{i}", r, 0.2, False) for i in range(20) for r in ("capability_exec", "sink_eval")]
    runs = spark.createDataFrame([(f"{k}{i}", "benign" if k == "b" else "malicious") for k in "bm" for i in range(20)], "pkg_id string, label string")
    bags = calibrate.collapsed(runs, bag(spark, rows))
    assert bags.count() == 2
    log = calibrate.search(bags, bags, load(env={}), trials=20, branches=(2, 2, -1), passes=3).persist()
    got = calibrate.best(log, ("min_categories",)).collect()
    assert sorted(r.min_categories for r in got) == [0, 2]
    assert all(r.worth >= 0.9 for r in got)
    # every logged trial, replayed by the declarative evaluation
    again = calibrate.evaluate(bags, log.select("trial", "min_categories", "allow", "block", "weights"))
    want = {r.trial: tuple(r[c] for c in calibrate.COUNTS) for r in again.collect()}
    rows = log.orderBy("trial").collect()
    assert [r.trial for r in rows] == list(range(len(rows))) and len(rows) > 1500
    assert {r.phase for r in rows} == {"random", "baseline", "from random", "from baseline"}
    for r in rows:
        assert want[r.trial] == tuple(r[c] for c in calibrate.COUNTS) == tuple(r[f"train_{c}"] for c in calibrate.COUNTS)
    rated = calibrate.rates(log)
    assert calibrate.feasible(rated).count() > 0 and calibrate.pareto(rated.drop("weights", "phase")).count() > 0
    assert len(sinks.trial_table(rated).columns) == 18 + 34


def _plain_search(bags, config, least, hard_cap, soft_cap):
    """700 draws, then ten passes from the best of them and from the base, one setting evaluated at a time over the bags."""
    base = rules.default_weights(config)

    def worth(t):
        n = {}
        for r in bags:
            score = round(min(1.0, sum(t["weights"].get(x["key"], float(x["score"])) for x in r["bag"])), 9)
            if any(x["veto"] for x in r["bag"]) or score >= t["block"]:
                v = "block"
            elif score >= t["allow"] and (least <= 1 or len({x["category"] for x in r["bag"]}) >= least):
                v = "warn"
            else:
                v = "allow"
            n[r["label"], v] = n.get((r["label"], v), 0) + r["runs"]
        share = lambda label, *vs: sum(n.get((label, v), 0) for v in vs) / max(1, sum(c for (k, _), c in n.items() if k == label))
        hard, soft, caught = share("benign", "block"), share("benign", "warn"), share("malicious", "warn", "block")
        return -1 - hard + 0.01 * caught if hard > hard_cap else -0.5 - soft + 0.01 * caught if soft > soft_cap else caught - 0.1 * soft

    def better(t, tries):
        values = [worth(x) for x in tries]
        return tries[values.index(max(values))] if max(values) > worth(t) + 1e-12 else t

    def descended(t):
        for _ in range(10):
            before = worth(t)
            for k in base:
                t = better(t, [t | {"weights": t["weights"] | {k: round(i * 0.05, 10)}} for i in range(21)])
            t = better(t, [t | {"allow": a} for a in (round(0.1 + i * 0.05, 10) for i in range(11)) if a < t["block"]])
            t = better(t, [t | {"block": b} for b in (round(0.4 + i * 0.05, 10) for i in range(12)) if b > t["allow"]])
            if worth(t) <= before:
                break
        return t

    drawn = max(calibrate.random_trials(base, 700, least, 1), key=worth)
    ends = [descended(t) for t in (drawn, {"allow": config.policy.allow_threshold, "block": config.policy.block_threshold, "weights": base})]
    top = max(ends, key=worth)
    return least, top["allow"], top["block"], round(worth(top), 9)


def test_search_query_is_the_whole_search(spark, monkeypatch):
    """The registered query against a search that evaluates one setting at a time with the reference's budget."""
    kinds = ("capability_exec", "sink_eval", "typosquat_warn", "typosquat_close", "metadata_new_package", "metadata_single_maintainer", "capability_env_read", "obfuscation_high_entropy")
    rows, labels = [], []
    for i in range(40):
        labels.append((f"p{i}", "malicious" if i % 3 == 0 else "benign"))
        rows += [(f"p{i}", r, 0.1, False) for j, r in enumerate(kinds) if (i * 7 + j * j * 3 + (i % 3 == 0) * j) % 5 < 2]
    bags = calibrate.collapsed(spark.createDataFrame(labels, "pkg_id string, label string"), bag(spark, rows)).persist()
    monkeypatch.setattr(calibration, "parted", lambda spark, sf: (bags, bags))
    got = sorted((r.min_categories, r.allow, r.block, r.worth) for r in calibration.b11(spark, "").collect())
    plain = [r.asDict(recursive=True) for r in bags.collect()]
    want = [_plain_search(plain, calibration.config(), m, calibration.HARD, calibration.SOFT) for m in (1, 2, 3)]
    assert [x[0] for x in got] == [1, 2, 3]
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


def test_random_trials_do_not_depend_on_order():
    base = rules.default_weights(load(env={}))
    a = calibrate.random_trials(base, 5, 2, 9)
    b = calibrate.random_trials(dict(reversed(base.items())), 5, 2, 9)
    assert a == b and all(t["block"] > t["allow"] and all(0 <= w <= 1 for w in t["weights"].values()) for t in a)


def test_split_is_stratified_and_repeats(spark):
    runs = spark.createDataFrame([(f"s{i}", "a" if i % 3 else "b") for i in range(300)], "sha256 string, label string")
    one = {r.sha256: r.part for r in calibrate.split(runs, 0.25, 4).collect()}
    assert one == {r.sha256: r.part for r in calibrate.split(runs.repartition(7), 0.25, 4).collect()}
    assert sum(v == "val" for v in one.values()) == 50 + 25


def test_trials_written(spark, sf, tmp_path):
    weights = F.transform_values("weights", lambda k, v: v.cast("double"))
    rated = calibration.rated(spark, sf).withColumn("weights", weights)
    sinks.write_trials(rated, str(tmp_path / "t"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "t"))
    assert back.columns[:5] == ["trial", "score", "allow", "block", "min_categories"] and len(back.columns) == 18 + len(rules.TUNABLE) and back.count() == 96


def test_sinks(spark):
    events = spark.createDataFrame([("package_verdict", "p", "1", 0.5, ["r"], 0)], "event_type string, package_name string, package_version string, risk_score double, triggered_rules array<string>, response_code int")
    line = sinks.syslog_lines(events).first().value
    assert json.loads(line.removeprefix("<28>")) == {"event_type": "package_verdict", "package_name": "p", "package_version": "1", "risk_score": 0.5, "triggered_rules": ["r"]}
    got = []
    sinks.fan_out(events, [lambda df: got.append(df.count()), lambda df: got.append(sinks.signed_posts(df, "k").first().signature)])
    assert got[0] == 1 and len(got[1]) == 64
    sent = []
    sinks.post("http://x", opener=lambda req, timeout: sent.append(req))(iter([{"body": "{}", "signature": "ab"}]))
    assert sent[0].get_header("X-signature-256") == "sha256=ab"
    sinks.fan_out(events, [])


def test_empty_signals(spark):
    assert policy.aggregates(spark.createDataFrame([], SIGNALS)).count() == 0


def test_tar_links_are_skipped():
    import io

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        link = tarfile.TarInfo("package/l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    assert archives.unpack(out.getvalue(), 1, 1, 1) == {}


def test_due_entries(spark):
    from parapet.operators import cache

    at = F.lit("2025-01-02").cast("timestamp")
    rows = [(f"s{i}", "warn" if i % 2 else "allow") for i in range(10)]
    entries = cache.put(spark.createDataFrame(rows, "sha256 string, verdict string").withColumn("analyzed_at", F.lit("2025-01-01 12:00:00").cast("timestamp")), 24)
    seen = spark.createDataFrame([("s1", 5), ("s3", 1), ("s3", 9), ("s5", 7)], "sha256 string, t int").select("sha256", F.timestamp_seconds("t").alias("rechecked_at"))
    assert [r.sha256 for r in cache.due(entries, at, ["warn"], 3).collect()] == ["s1", "s3", "s5"]
    assert [r.sha256 for r in cache.due(entries, at, ["warn"], 4, seen).collect()] == ["s7", "s9", "s1", "s5"]


def test_capabilities_of_the_version_before(spark):
    """Exec and network that a patch release with a changed script adds, by scans of both archives."""
    config = load(env={})
    run = "const c = require('child_process'); c.exec('ls')"
    manifest = '{"scripts": {"install": "node x"}}'
    files = lambda rows: spark.createDataFrame(rows, "pkg_id string, path string, src string")
    now = files([(p, "package/package.json", manifest) for p in "abcd"] + [(p, "package/index.js", run) for p in "abcd"])
    was = files([("a", "package/index.js", "1"), ("b", "package/index.js", run), ("c", "package/index.js", "1")])
    maps = "map<string,string>"
    pairs = spark.createDataFrame([("a", "1.0.1", "1.0.0"), ("b", "1.0.1", "1.0.0"), ("c", "2.0.0", "1.0.0"), ("d", "1.0.1", "1.0.0")], "pkg_id string, version string, previous string")
    pairs = pairs.withColumn("scripts", F.create_map(F.lit("install"), F.lit("node x"))).withColumns({c: F.create_map().cast(maps) for c in ("previous_scripts", "deps", "previous_deps", "dev_deps", "previous_dev_deps")})
    found = scoring.later_layers(now, config, pairs, was).filter("rule LIKE '%exec_in_patch'").collect()
    assert [(r.pkg_id, r.rule) for r in found] == [("a", "version_diff_new_exec_in_patch")]


def test_calibration_runs_with_layer_one(spark):
    config = load(env={})
    files = spark.createDataFrame([("lodahs", "package/package.json", "{}", None), ("fine", "package/package.json", "{}", None)], "pkg_id string, path string, src string, error string")
    corpus = spark.createDataFrame([("lodahs", "malicious", False), ("fine", "benign", False)], "pkg_id string, label string, osv_vulnerable boolean")
    none = lambda schema: spark.createDataFrame([], schema)
    day = F.lit("2025-01-10").cast("timestamp")
    known = scoring.Snapshot(
        corpus.select("pkg_id", F.col("pkg_id").alias("name"), F.lit("1.0.0").alias("version"), F.lit("2025-01-09").cast("timestamp").alias("created")),
        spark.createDataFrame([("lodahs", f"1.0.{i}") for i in range(9)], "pkg_id string, version string").withColumn("ts", F.lit("2025-01-09 20:00:00").cast("timestamp")),
        spark.createDataFrame([("fine", "ann"), ("lodahs", "x"), ("lodahs", "y")], "pkg_id string, maintainer string"),
        none("pkg_id string, monthly long"),
        none("maintainer string, created timestamp"),
        none("name string, version string"),
        spark.createDataFrame([("lodash",)], "name string"),
        files,
    )
    got = {(r.pkg_id, r.rule) for r in scoring.calibration_runs(corpus, files, config, known=known, as_of=day).collect()}
    assert got == {("lodahs", "typosquat_close"), ("lodahs", "metadata_new_package"), ("fine", "metadata_new_package"), ("lodahs", "anomaly_version_spike"), ("fine", "metadata_single_maintainer")}
