"""Queries for verdicts, caches and events. Lines of an order stand for signals of a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import rules, sinks
from parapet.config import load
from parapet.functions import hashes
from parapet.operators import cache, names, policy
from parapet.queries.base import query, table, values
from parapet.schema import SCORE
from parapet.shared import new_path
from parapet.streaming import requests

#: Rules by line number (1 to 7) and returnflag: rule, score, CWE.
BY_LINE = (
    ("typosquat_close", 0.15, ""),
    ("metadata_new_package", 0.1, ""),
    ("install_script_external_url_install", 0.08, "CWE-506"),
    ("capability_exec", 0.15, "CWE-78"),
    ("obfuscation_high_entropy", 0.12, ""),
    ("sink_eval", 0.2, "CWE-94"),
    ("install_script_curl_pipe_install", 0.0, "CWE-506"),
)
_LINES = (
    "s AS (SELECT l_orderkey::VARCHAR AS pkg_id, x.rule, x.score::DECIMAL(18,9) AS score, l_linenumber = 7 AND l_quantity > 25 AS veto, x.cwe FROM lineitem JOIN "
    + values([(i + 1, *r) for i, r in enumerate(BY_LINE)], "line, rule, score, cwe").replace("AS v(", "AS x(")
    + " ON x.line = l_linenumber)"
)
_CATEGORY = """CASE WHEN rule IN ('typosquat_with_install_script', 'install_script_with_exec', 'install_script_with_network', 'install_script_with_obfuscation') THEN 'combo'
 WHEN starts_with(rule, 'typosquat_') THEN 'typosquat' WHEN starts_with(rule, 'metadata_') OR starts_with(rule, 'license_') THEN 'metadata' WHEN starts_with(rule, 'anomaly_') THEN 'anomaly'
 WHEN starts_with(rule, 'install_script_') THEN 'install' WHEN starts_with(rule, 'cap_') OR starts_with(rule, 'capability_') THEN 'capability' WHEN starts_with(rule, 'sink_') THEN 'sink'
 WHEN rule = 'entropy_obfuscation' THEN 'entropy' WHEN starts_with(rule, 'version_diff_') THEN 'version_diff' ELSE 'other' END"""
_COMBO = """fl AS (SELECT pkg_id, bool_or(starts_with(rule, 'typosquat_')) AS typo, bool_or(starts_with(rule, 'install_script_')) AS inst, bool_or(rule = 'capability_exec') AS ex,
  bool_or(starts_with(rule, 'install_script_external_url_')) AS net, bool_or(rule = 'obfuscation_high_entropy') AS obf FROM s GROUP BY 1),
c AS (SELECT pkg_id, 'typosquat_with_install_script' AS rule, 0.2::DECIMAL(18,9) AS score, false AS veto, 'CWE-506' AS cwe FROM fl WHERE typo AND inst
 UNION ALL SELECT pkg_id, 'install_script_with_exec', 0.2, false, 'CWE-506' FROM fl WHERE inst AND ex UNION ALL SELECT pkg_id, 'install_script_with_network', 0.15, false, 'CWE-506' FROM fl WHERE inst AND net
 UNION ALL SELECT pkg_id, 'install_script_with_obfuscation', 0.2, false, 'CWE-506' FROM fl WHERE inst AND obf),
u AS (SELECT * FROM s UNION ALL SELECT * FROM c)"""
_AGG = f"""a AS (SELECT pkg_id, bool_or(veto) AS veto, least(1.0::DECIMAL(18,9), sum(score)) AS score, array_to_string(list_sort(list(rule)), ',') AS rules, array_to_string(list_sort(list(rule)), ' ') AS spaced,
  coalesce(array_to_string(list_sort(list(DISTINCT cwe) FILTER (cwe <> '')), ','), '') AS cwes, count(DISTINCT {_CATEGORY}) AS categories, coalesce(min(CASE WHEN veto THEN rule END), '') AS veto_rule FROM u GROUP BY 1),
d AS (SELECT o_orderkey::VARCHAR AS pkg_id, coalesce(veto, false) AS veto, coalesce(score, 0) AS score, coalesce(rules, '') AS rules, coalesce(spaced, '') AS spaced, coalesce(cwes, '') AS cwes, coalesce(categories, 0) AS categories, coalesce(veto_rule, '') AS veto_rule,
  CASE WHEN coalesce(veto, false) OR coalesce(score, 0) >= 0.7 THEN 'block' WHEN coalesce(score, 0) < 0.3 THEN 'allow' WHEN coalesce(categories, 0) < 2 THEN 'allow' ELSE 'warn' END AS verdict FROM orders LEFT JOIN a ON a.pkg_id = o_orderkey::VARCHAR)"""


def config():
    return load(env={})


def line_signals(spark: SparkSession, sf: str) -> DataFrame:
    kinds = spark.createDataFrame([(i + 1, r, str(s), c) for i, (r, s, c) in enumerate(BY_LINE)], "line int, rule string, s string, cwe string")
    lines = table(spark, sf, "lineitem")
    return lines.join(kinds, F.col("line") == F.col("l_linenumber")).select(
        F.col("l_orderkey").cast("string").alias("pkg_id"), "rule", F.col("s").cast(SCORE).alias("score"), ((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 25)).alias("veto"), "cwe", F.lit("").alias("matched"), F.lit("").alias("detail")
    )


def packages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pkg_id"))


@query("p1_union", f"WITH {_LINES} SELECT rule, count(*) * 2 AS n FROM s GROUP BY 1")
def p1(spark, sf):
    from parapet.schema import union

    s = line_signals(spark, sf)
    return union(s, s).groupBy("rule").agg(F.count("*").alias("n"))


@query("p2_p3_combos", f"WITH {_LINES}, {_COMBO} SELECT pkg_id, rule, score::DOUBLE AS score, veto, cwe FROM c")
def p2(spark, sf):
    return policy.combo_signals(line_signals(spark, sf), config()).select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "veto", "cwe")


@query("p2_combo_idempotent", f"WITH {_LINES}, {_COMBO} SELECT DISTINCT pkg_id, rule FROM c")
def p2_twice(spark, sf):
    once = policy.with_combos(line_signals(spark, sf), config())
    return policy.with_combos(once, config()).filter(F.col("rule").isin(*rules.COMBOS)).select("pkg_id", "rule")


@query("p4_p9_aggregates", f"WITH {_LINES}, u AS (SELECT * FROM s), {_AGG} SELECT pkg_id, veto, score::DOUBLE AS score, rules, cwes, categories, veto_rule FROM a")
def p4(spark, sf):
    a = policy.aggregates(line_signals(spark, sf))
    return a.select("pkg_id", "veto", F.col("score").cast("double").alias("score"), F.array_join("rules", ",").alias("rules"), F.array_join("cwes", ",").alias("cwes"), "categories", F.coalesce("veto_rule", F.lit("")).alias("veto_rule"))


_RULES = [*rules.TUNABLE, *rules.EXACT_KEYS, *(p + "install" for p in rules.PREFIX_KEYS), "osv_known_vulnerability", "metadata_single_maintainer"]


@query("p8_category", f"SELECT DISTINCT rule, {_CATEGORY} AS category FROM " + values([(r,) for r in _RULES], "rule"))
def p8(spark, sf):
    return spark.createDataFrame([(r,) for r in _RULES], "rule string").distinct().select("rule", rules.category(F.col("rule")).alias("category"))


@query("p10_decide", f"WITH {_LINES}, {_COMBO}, {_AGG} SELECT pkg_id, verdict, (CASE WHEN veto THEN 1 ELSE score END)::DOUBLE AS score, rules, cwes, categories, veto_rule, CASE WHEN verdict = 'block' THEN 403 ELSE 200 END::BIGINT AS http_status, CASE WHEN verdict = 'warn' THEN printf('score=%.2f rules=[%s]', score::DOUBLE, spaced) ELSE '' END AS warning_header FROM d")
def p10(spark, sf):
    d = policy.decide(packages(spark, sf), policy.with_combos(line_signals(spark, sf), config()), config())
    return d.withColumn("score", F.col("score").cast("double")).withColumn("http_status", F.col("http_status").cast("long"))


@query("p11_early_decision", f"WITH {_LINES}, u AS (SELECT * FROM s), {_AGG} SELECT pkg_id FROM d WHERE verdict <> 'block'")
def p11(spark, sf):
    p = packages(spark, sf)
    early = policy.decide(p, line_signals(spark, sf), config())
    return policy.not_blocked(p.select(F.col("pkg_id").cast("string").alias("pkg_id")), early)


@query("p12_integrity", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'shasum mismatch' WHEN 2 THEN 'malformed integrity' WHEN 3 THEN 'integrity mismatch' ELSE '' END AS problem FROM documents")
def p12(spark, sf):
    d = table(spark, sf, "documents").withColumn("content", F.encode("text", "utf-8"))
    k = F.col("doc_id") % 5
    sha = F.when(k == 1, F.lit("0" * 40)).otherwise(F.upper(F.sha1("content")))
    declared = F.when(k == 2, F.lit("nonsense")).when(k == 3, F.lit("sha512-AAAA")).when(k == 4, F.lit("md5-AAAA")).otherwise(hashes.sri(F.col("content")))
    return d.select("doc_id", hashes.integrity(F.col("content"), sha, declared).alias("problem"))


@query("p13_content_hash", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS shasum FROM documents")
def p13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashes.content_hash(F.encode("text", "utf-8")).alias("sha256"), F.sha1("text").alias("shasum"))


_HMAC = [("", "key", "5d5d139563c95b5967b9bd9a8c9b233a9dedb45072794cd232dc1b74832607d0"), ("The quick brown fox jumps over the lazy dog", "key", "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8")]


@query("k3_hmac", "SELECT * FROM " + values(_HMAC, "message, secret, signature"))
def k3(spark, sf):
    return spark.createDataFrame([(m, s) for m, s, _ in _HMAC], "message string, secret string").withColumn("signature", hashes.hmac_sha256(F.col("message"), "key"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cache entries: the key is that of the customer."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("block")).when(F.col("o_orderstatus") == "O", F.lit("warn")).otherwise(F.lit("allow"))
    return o.select(
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"), F.col("o_orderdate").cast("timestamp").alias("analyzed_at"), F.col("o_orderkey").alias("nth"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name"), F.lit("1.0.0").alias("version"), kind.alias("verdict"), (F.col("o_orderkey") % 100 / 100).alias("score"), F.col("o_orderpriority").alias("rules")
    )


_ENTRIES = """e AS (SELECT sha256(o_custkey::VARCHAR) AS sha256, o_orderdate AS analyzed_at, o_orderkey AS nth, 'p' || o_custkey AS name, '1.0.0' AS version, CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'O' THEN 'warn' ELSE 'allow' END AS verdict,
  (o_orderkey % 100) / 100 AS score, o_orderpriority AS rules FROM orders),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY analyzed_at DESC, nth DESC) = 1),
v AS (SELECT *, analyzed_at + INTERVAL 2400 HOUR AS expires_at FROM l),
live AS (SELECT * FROM v WHERE expires_at > TIMESTAMP '2001-07-01 00:00:00')"""


def live_at():
    return F.to_timestamp(F.lit("2001-07-01 00:00:00"))


@query("k5_latest_entry", f"WITH {_ENTRIES} SELECT sha256, nth, verdict FROM l")
def k5(spark, sf):
    return cache.latest(entries(spark, sf)).select("sha256", "nth", "verdict")


@query("r1_route", "SELECT * FROM " + values([("GET", "/lodash/-/lodash-1.0.0.tgz", True, "lodash"), ("GET", "/@a/b/-/b-1.0.0.tgz", True, "@a/b"), ("POST", "/lodash/-/lodash-1.0.0.tgz", False, None), ("GET", "/lodash", False, None), ("GET", "/@a/b", False, None), ("GET", "/x/-/x-1.tar", False, None)], "method, path, is_archive, package_name"))
def r1(spark, sf):
    rows = [("GET", "/lodash/-/lodash-1.0.0.tgz"), ("GET", "/@a/b/-/b-1.0.0.tgz"), ("POST", "/lodash/-/lodash-1.0.0.tgz"), ("GET", "/lodash"), ("GET", "/@a/b"), ("GET", "/x/-/x-1.tar")]
    return cache.routed(spark.createDataFrame(rows, "method string, path string"))


@query("r2_cache_lookup", f"WITH {_ENTRIES} SELECT c_custkey, live.verdict AS cached_verdict, live.sha256 IS NOT NULL AS hit FROM customer LEFT JOIN live ON live.sha256 = sha256(c_custkey::VARCHAR)")
def r2(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    return cache.lookup(asked, cache.put(entries(spark, sf), 2400), live_at()).select("c_custkey", "cached_verdict", "hit")


@query("r3_cached_events", f"WITH {_ENTRIES} SELECT sha256, 'package_verdict' AS event_type, verdict, score AS risk_score, 200::BIGINT AS response_code FROM live")
def r3(spark, sf):
    asked = table(spark, sf, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    found = cache.cached_events(cache.lookup(asked, cache.put(entries(spark, sf), 2400), live_at()))
    return found.select("sha256", "event_type", "verdict", "risk_score", F.col("response_code").cast("long").alias("response_code"))


@query("r4_list_verdicts", f"WITH {_ENTRIES} SELECT sha256, verdict FROM live WHERE verdict IN ('warn', 'allow') ORDER BY sha256 LIMIT 50")
def r4(spark, sf):
    return cache.list_verdicts(cache.put(entries(spark, sf), 2400), live_at(), ["warn", "allow"], 50).select("sha256", "verdict")


@query("r6_recheck", f"""WITH {_ENTRIES}, w AS (SELECT * FROM live WHERE verdict = 'warn' ORDER BY sha256 LIMIT 500)
SELECT sha256, name, 'block' AS verdict, 1.0::DOUBLE AS score, rules || ',osv_known_vulnerability' AS rules FROM w WHERE substr(name, 2)::INT % 3 = 0""")
def r6(spark, sf):
    known = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"), F.lit("1.0.0").alias("version"))
    none = line_signals(spark, sf).limit(0)
    out = cache.recheck(cache.put(entries(spark, sf), 2400), live_at(), known, none, config())
    return out.select("sha256", "name", "verdict", F.col("score").cast("double").alias("score"), "rules")


@query("r7_fresh_advisories", """WITH c AS (SELECT 'p' || user_id AS name, event_type AS version, ts, (event_id % 2)::VARCHAR AS flag FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT name, version, flag AS known FROM c WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-30 20:00:00'""")
def r7(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("version"), F.col("ts").cast("timestamp").alias("checked_at"), "event_id", (F.col("event_id") % 2).cast("string").alias("flag"))
    e = e.withColumn("expires_at", F.col("checked_at") + F.expr("INTERVAL 24 HOURS")).select("name", "version", "checked_at", "event_id", "flag", "expires_at")
    best = e.select("name", "version", "checked_at", F.col("event_id").alias("a_id"), "flag", "expires_at")
    return cache.fresh_advisories(best.select("a_id", "name", "version", "checked_at", "flag", "expires_at"), F.to_timestamp(F.lit("2024-01-30 20:00:00")))


@query("r8_outcomes", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'upstream_down' WHEN 1 THEN 'integrity_mismatch' WHEN 2 THEN 'resource_limit' WHEN 3 THEN 'analysis_timeout' ELSE 'package_verdict' END AS event_type,
CASE WHEN o_orderkey % 6 = 0 THEN 502 WHEN o_orderkey % 6 <= 3 THEN 403 WHEN o_orderkey % 6 = 4 THEN 200 ELSE 403 END::BIGINT AS response_code FROM orders""")
def r8(spark, sf):
    k = F.col("o_orderkey") % 6
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, F.lit("down")).alias("upstream_error"), F.when(k <= 1, F.lit("sum")).alias("integrity_error"), F.when(k == 2, F.lit("big")).alias("resource_error"), (k == 3).alias("timed_out"), F.when(k == 4, F.lit(200)).otherwise(F.lit(403)).alias("http_status")
    )
    return cache.outcomes(o).select("o_orderkey", "event_type", F.col("response_code").cast("long").alias("response_code"))


@query("r8_events_json", "SELECT o_orderkey, '{\"event_type\":\"package_verdict\",\"package_name\":\"p' || o_custkey || '\",\"package_version\":\"1\"' || CASE WHEN o_orderstatus = 'F' THEN ',\"response_code\":403' ELSE '' END || '}' AS line FROM orders")
def r8_json(spark, sf):
    from parapet.sinks import event_json

    o = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("package_verdict").alias("event_type"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("package_name"), F.lit("1").alias("package_version"), F.lit("").alias("sha256"), F.when(F.col("o_orderstatus") == "F", F.lit(403)).otherwise(F.lit(0)).alias("response_code")
    )
    return o.select("o_orderkey", event_json(o).alias("line"))


@query("k2_syslog", "SELECT '<28>{\"event_type\":\"package_verdict\",\"package_name\":\"p' || o_custkey || '\"' || CASE WHEN o_orderstatus = 'F' THEN ',\"response_code\":403' ELSE '' END || '}' AS value FROM orders")
def k2(spark, sf):
    from parapet.sinks import syslog_lines

    events = table(spark, sf, "orders").select(F.lit("package_verdict").alias("event_type"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("package_name"), F.when(F.col("o_orderstatus") == "F", F.lit(403)).otherwise(F.lit(0)).alias("response_code"))
    return syslog_lines(events)


@query("k1_fan_out", "SELECT n AS emitter, o_orderkey::VARCHAR AS sha256, CASE WHEN o_orderstatus = 'F' THEN 403 ELSE 200 END::BIGINT AS response_code FROM orders, (VALUES ('first'), ('second')) AS v(n)")
def k1(spark, sf):
    """Events to two emitters, and what came to each."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sha256"), F.when(F.col("o_orderstatus") == "F", F.lit(403)).otherwise(F.lit(200)).cast("long").alias("response_code"))
    paths = {n: new_path(spark, f"events-{n}") for n in ("first", "second")}
    sinks.fan_out(o, [lambda df, path=path: sinks.log_lines(df).write.text(path) for path in paths.values()])
    schema = "sha256 string, response_code long"
    first, second = (spark.read.schema(schema).json(path).withColumn("emitter", F.lit(n)) for n, path in paths.items())
    return first.unionByName(second)


@query("k4_log_lines", "SELECT '{\"event_type\":\"upstream_down\",\"package_name\":\"p' || c_custkey || '\",\"sha256\":\"x\"}' AS value FROM customer")
def k4(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("upstream_down").alias("event_type"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("package_name"), F.lit("x").alias("sha256"), F.lit(0).alias("response_code"), F.lit("").alias("verdict"))
    return sinks.log_lines(c)


def _stored(spark: SparkSession, sf: str) -> str:
    """The path of a verdict table with all entries."""
    path = new_path(spark, "verdicts")
    entries(spark, sf).write.parquet(path)
    return path


@query("r2_served_stream", f"""WITH {_ENTRIES}, a AS (SELECT c_custkey, sha256(c_custkey::VARCHAR) AS sha256 FROM customer),
r AS (SELECT a.*, coalesce(live.verdict, CASE c_custkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END) AS verdict, live.sha256 IS NOT NULL AS hit FROM a LEFT JOIN live USING (sha256))
SELECT sha256, verdict, CASE WHEN hit OR verdict = 'allow' THEN 200 ELSE 403 END::BIGINT AS response_code FROM r""")
def r2_stream(spark, sf):
    """Requests of all customers as a stream: cached ones answered, others scored, stored and answered; what a scorer leaves out is refused."""
    requested, out, store = new_path(spark, "requests"), new_path(spark, "answers"), _stored(spark, sf)
    c = table(spark, sf, "customer").withColumn("name", F.concat(F.lit("p"), F.col("c_custkey").cast("string")))
    asked = c.select(F.lit("GET").alias("method"), F.format_string("/%s/-/%s-1.0.0.tgz", "name", "name").alias("path"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), F.lit("192.0.2.1").alias("source_ip"), live_at().alias("at"))
    passed = asked.limit(1).withColumn("method", F.lit("POST"))
    asked.unionByName(passed).write.json(requested)

    def scorer(missed: DataFrame) -> DataFrame:
        k = F.substring("package_name", 2, 20).cast("long") % 3
        return missed.filter(k < 2).select("sha256", F.when(k == 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), F.lit(0.5).alias("score"), F.lit("").alias("rules"))

    emit = lambda df: df.select("sha256", "verdict", F.col("response_code").cast("long").alias("response_code")).write.mode("append").parquet(out)
    stream = requests.serve(requests.requests(spark, requested), lambda s: s.read.parquet(store), emit, new_path(spark, "serve"), 2400, scorer, store)
    stream.awaitTermination()
    return spark.read.parquet(out)


@query("r5_recheck_loop", f"""WITH {_ENTRIES}, w AS (SELECT * FROM live WHERE verdict = 'warn' ORDER BY sha256 LIMIT 500)
SELECT sha256, name, 'block' AS verdict, 1.0::DOUBLE AS score, rules || ',osv_known_vulnerability' AS rules FROM w WHERE substr(name, 2)::INT % 3 = 0""")
def r5(spark, sf):
    """A run of the recheck loop at a tick; its blocks are appended to a table."""
    ticks, store, held = new_path(spark, "ticks"), new_path(spark, "rechecked"), _stored(spark, sf)
    spark.createDataFrame([("2001-07-01T00:00:00Z",)], "at string").write.json(ticks)
    known = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"), F.lit("1.0.0").alias("version"))
    none = line_signals(spark, sf).limit(0)
    again = lambda s: cache.recheck(cache.put(s.read.parquet(held), 2400), live_at(), known, none, config())
    requests.rechecks(spark.readStream.schema("at timestamp").json(ticks), again, store, new_path(spark, "loop")).awaitTermination()
    return spark.read.parquet(store).select("sha256", "name", "verdict", F.col("score").cast("double").alias("score"), "rules")


@query("name_rules_on_cache", f"""WITH {_ENTRIES}, n AS (SELECT DISTINCT sha256, name FROM e)
SELECT sha256 AS pkg_id, CASE WHEN damerau_levenshtein(name, 'p1234') <= 1 THEN 'typosquat_close' ELSE 'typosquat_warn' END AS rule FROM n WHERE name <> 'p1234' AND levenshtein(name, 'p1234') <= 2""")
def recheck_names(spark, sf):
    """R6 with name rules as well: keys of cached packages whose names look like popular ones."""
    held = entries(spark, sf).select(F.col("sha256").alias("pkg_id"), F.col("name")).distinct()
    return names.name_signals(held, spark.createDataFrame([("p1234",)], "name string"), config()).select("pkg_id", "rule")
