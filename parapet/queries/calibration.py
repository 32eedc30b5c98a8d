"""Queries for calibration: labelled documents stand for labelled runs, marks in their texts for signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import rules
from parapet.config import load
from parapet.operators import calibrate
from parapet.queries.base import query, table, values
from parapet.schema import SCORE, fired, signal
from parapet.sinks import trial_table

HARD, SOFT = 0.2, 0.3
ALLOW = (0.1, 0.2, 0.3, 0.4)
BLOCK = (0.5, 0.6, 0.7, 0.8)
BRANCHES = (0, 2, 3)
SCALE = (0.5, 1.0)
#: rule, score, and what a document must have.
MARKS = (
    ("capability_exec", 0.30, "regexp_like(text, '!!')", "regexp_matches(text, '!!')"),
    ("sink_eval", 0.20, "contains(text, '$$$')", "contains(text, '$$$')"),
    ("metadata_new_package", 0.20, "n_chars < 800", "n_chars < 800"),
    ("typosquat_warn", 0.30, "regexp_like(text, 'idiot|clown|scum')", "regexp_matches(text, 'idiot|clown|scum')"),
    ("typosquat_close", 0.55, "regexp_like(text, 'moron|trash')", "regexp_matches(text, 'moron|trash')"),
    ("metadata_single_maintainer", 0.05, "n_chars % 2 = 0", "n_chars % 2 = 0"),
)


def config():
    return load(env={})


def runs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").cast("string").alias("pkg_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.when(F.col("toxic") == 1, F.lit("malicious")).otherwise(F.lit("benign")).alias("label"), F.when(F.col("lang") != "es", F.col("lang")).otherwise(F.lit("")).alias("category"), "text", "n_chars"
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return fired(runs(spark, sf), *[(F.expr(when), signal(r, s)) for r, s, when, _ in MARKS])


def bags(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.collapsed(runs(spark, sf).drop("text"), signals(spark, sf))


def trials(spark: SparkSession) -> DataFrame:
    """A grid of thresholds, categories and two scalings of the base weights."""
    base = rules.default_weights(config())
    rows = [(i, str(a), str(b), m, {k: str(v * s) for k, v in base.items()}) for i, (s, m, a, b) in enumerate((s, m, a, b) for s in SCALE for m in BRANCHES for a in ALLOW for b in BLOCK)]
    t = spark.createDataFrame(rows, "trial int, allow string, block string, min_categories int, w map<string,string>")
    return t.select("trial", F.col("allow").cast(SCORE).alias("allow"), F.col("block").cast(SCORE).alias("block"), "min_categories", F.transform_values("w", lambda k, v: v.cast(SCORE)).alias("weights"))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    matrix = calibrate.evaluate(bags(spark, sf), trials(spark))
    return calibrate.rates(matrix).withColumn("worth", calibrate.objective(HARD, SOFT)).join(trials(spark), "trial")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    base = rules.default_weights(config())
    weights = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(str(v)).cast(SCORE))])
    return calibrate.judged(runs(spark, sf).drop("text"), signals(spark, sf), weights, config())


_RUNS = (
    """d AS (SELECT doc_id::VARCHAR AS pkg_id, sha256(doc_id::VARCHAR) AS sha256, CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN lang <> 'es' THEN lang ELSE '' END AS category, text, n_chars FROM documents JOIN labels USING (doc_id)),
s AS ("""
    + " UNION ALL ".join(f"SELECT pkg_id, '{r}' AS rule, {s}::DECIMAL(18,9) AS score, {'false' if r == 'metadata_single_maintainer' else 'true'} AS tuned, '{r.split('_')[0].replace('typosquat', 'typosquat')}' AS kind FROM d WHERE {when}" for r, s, _, when in MARKS)
    + ")"
)
_GRID = f"""g AS (SELECT row_number() OVER (ORDER BY s, m, a, b) - 1 AS trial, s, m, a, b FROM (SELECT unnest({list(SCALE)})::DECIMAL(18,9) AS s), (SELECT unnest({list(BRANCHES)}) AS m), (SELECT unnest({list(ALLOW)})::DECIMAL(18,9) AS a), (SELECT unnest({list(BLOCK)})::DECIMAL(18,9) AS b)),
r AS (SELECT g.trial, g.a, g.b, g.m, d.pkg_id, d.label, least(1, coalesce(sum((CASE WHEN tuned THEN (s.score * g.s)::DECIMAL(18,9) ELSE s.score END)), 0)) AS score, count(DISTINCT kind) AS kinds FROM g CROSS JOIN d LEFT JOIN s ON s.pkg_id = d.pkg_id GROUP BY ALL),
v AS (SELECT *, CASE WHEN score >= b THEN 'block' WHEN score < a THEN 'allow' WHEN m > 1 AND kinds < m THEN 'allow' ELSE 'warn' END AS verdict FROM r),
c AS (SELECT trial, {', '.join(f"count(*) FILTER (label = '{x}' AND verdict = '{y}') AS {x}_{y}" for x in ("benign", "malicious") for y in ("allow", "warn", "block"))} FROM v GROUP BY 1),
t AS (SELECT *, benign_allow + benign_warn + benign_block AS nb, malicious_allow + malicious_warn + malicious_block AS nm FROM c),
q AS (SELECT *, CASE WHEN nb > 0 THEN benign_block / nb ELSE 0 END AS hard_fp, CASE WHEN nb > 0 THEN benign_warn / nb ELSE 0 END AS soft_fp, CASE WHEN nm > 0 THEN (malicious_warn + malicious_block) / nm ELSE 0 END AS catch,
  CASE WHEN nm > 0 THEN malicious_block / nm ELSE 0 END AS block_recall, CASE WHEN nm > 0 THEN malicious_warn / nm ELSE 0 END AS warn_recall,
  CASE WHEN benign_block + malicious_block > 0 THEN malicious_block / (benign_block + malicious_block) ELSE 0 END AS block_precision, CASE WHEN benign_warn + malicious_warn > 0 THEN malicious_warn / (benign_warn + malicious_warn) ELSE 0 END AS warn_precision FROM t),
o AS (SELECT *, CASE WHEN hard_fp > {HARD} THEN -1 - hard_fp + 0.01::DOUBLE * catch WHEN soft_fp > {SOFT} THEN -0.5 - soft_fp + 0.01::DOUBLE * catch ELSE catch - 0.1::DOUBLE * soft_fp END AS worth FROM q)"""
_JUDGED = """j AS (SELECT d.pkg_id, d.label, d.category, least(1, coalesce(sum(score), 0)) AS score, coalesce(list_sort(list(rule) FILTER (rule IS NOT NULL)), []) AS rules, count(DISTINCT kind) AS kinds FROM d LEFT JOIN s USING (pkg_id) GROUP BY ALL),
v AS (SELECT *, CASE WHEN score >= 0.7 THEN 'block' WHEN score < 0.3 THEN 'allow' WHEN kinds < 2 THEN 'allow' ELSE 'warn' END AS verdict FROM j)"""
_RATES = ("hard_fp", "soft_fp", "catch", "block_recall", "warn_recall", "block_precision", "warn_precision")


def _round_sql(names) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


#: The tunable keys in canonical order and their default weights.
WEIGHTS = [
    ("typosquat_close", 0.55),
    ("typosquat_warn", 0.3),
    ("typosquat_ascii_homoglyph", 0.65),
    ("typosquat_combosquat", 0.2),
    ("typosquat_scope_close", 0.55),
    ("typosquat_scope_warn", 0.25),
    ("metadata_new_package", 0.2),
    ("metadata_young_maintainer", 0.25),
    ("metadata_low_downloads", 0.05),
    ("metadata_popular_but_stale", 0.15),
    ("anomaly_release_burst", 0.2),
    ("license_changed_in_patch", 0.15),
    ("install_script_present", 0.2),
    ("install_script_base64", 0.35),
    ("install_script_child_process", 0.2),
    ("install_script_eval", 0.15),
    ("install_script_node_eval", 0.15),
    ("install_script_dynamic_require", 0.1),
    ("install_script_external_url", 0.08),
    ("cap_exec", 0.3),
    ("cap_dynamic_eval", 0.2),
    ("cap_env_read", 0.1),
    ("entropy_obfuscation", 0.3),
    ("sink_alone", 0.2),
    ("sink_with_obfuscation", 0.55),
    ("version_diff_new_script_in_patch", 0.4),
    ("version_diff_script_changed_in_patch", 0.25),
    ("version_diff_new_exec_in_patch", 0.35),
    ("version_diff_new_net_in_patch", 0.25),
    ("version_diff_new_deps_in_patch", 0.1),
    ("typosquat_with_install_script", 0.2),
    ("install_script_with_exec", 0.2),
    ("install_script_with_network", 0.15),
    ("install_script_with_obfuscation", 0.2),
]
#: Emitted rules and the keys that weigh them.
RULE_KEYS = [
    ("anomaly_version_spike", "anomaly_release_burst"),
    ("license_patch_change", "license_changed_in_patch"),
    ("capability_exec", "cap_exec"),
    ("capability_dynamic_eval", "cap_dynamic_eval"),
    ("capability_env_read", "cap_env_read"),
    ("obfuscation_high_entropy", "entropy_obfuscation"),
    ("sink_eval", "sink_alone"),
    ("sink_new_function", "sink_alone"),
    ("sink_vm_run_this_context", "sink_alone"),
    ("sink_vm_run_new_context", "sink_alone"),
    ("sink_dynamic_require", "sink_alone"),
    ("version_diff_new_dependency", "version_diff_new_deps_in_patch"),
    ("install_script_base64_decode_install", "install_script_base64"),
    ("install_script_child_process_install", "install_script_child_process"),
    ("install_script_eval_install", "install_script_eval"),
    ("install_script_node_eval_install", "install_script_node_eval"),
    ("install_script_dynamic_require_install", "install_script_dynamic_require"),
    ("install_script_external_url_install", "install_script_external_url"),
    ("version_diff_new_script_install", "version_diff_new_script_in_patch"),
    ("version_diff_changed_script_install", "version_diff_script_changed_in_patch"),
    ("osv_known_vulnerability", "osv_known_vulnerability"),
]


@query("b3_weight_key", "SELECT rule, key FROM " + values([*RULE_KEYS, *((k, k) for k, _ in WEIGHTS)], "rule, key"))
def b3(spark, sf):
    names = [*(r for r, _ in RULE_KEYS), *(k for k, _ in WEIGHTS)]
    return spark.createDataFrame([(r,) for r in names], "rule string").select("rule", rules.weight_key(F.col("rule")).alias("key"))


@query("b1_b4_replay", f"WITH {_RUNS}, {_JUDGED} SELECT pkg_id, label, score::DOUBLE AS score, verdict, array_to_string(rules, ',') AS rules FROM v")
def b4(spark, sf):
    return judged(spark, sf).select("pkg_id", "label", F.col("score").cast("double").alias("score"), "verdict", F.array_join("rules", ",").alias("rules"))


@query("b5_split", f"WITH {_RUNS} SELECT label, count(*) AS n, floor(count(*) * 0.3)::BIGINT AS val FROM d GROUP BY 1")
def b5(spark, sf):
    parts = calibrate.split(runs(spark, sf).drop("text"), 0.3, 7)
    return parts.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "val").alias("val"))


@query("b6_confusion", f"WITH {_RUNS}, {_GRID} SELECT * FROM c")
def b6(spark, sf):
    return calibrate.evaluate(bags(spark, sf), trials(spark)).withColumn("trial", F.col("trial").cast("long"))


@query("b7_b8_rates_objective", f"WITH {_RUNS}, {_GRID} SELECT trial, {_round_sql((*_RATES, 'worth'))} FROM o")
def b7(spark, sf):
    return _rounded(rated(spark, sf).select(F.col("trial").cast("long").alias("trial"), *_RATES, "worth"), *_RATES, "worth")


@query("b9_per_category", f"WITH {_RUNS}, {_JUDGED} SELECT CASE WHEN category = '' THEN '(uncategorised)' ELSE category END AS category, {', '.join(f'''count(*) FILTER (label = '{x}' AND verdict = '{y}') AS {x}_{y}''' for x in ('benign', 'malicious') for y in ('allow', 'warn', 'block'))} FROM v GROUP BY 1")
def b9(spark, sf):
    return calibrate.per_category(judged(spark, sf))


@query("b10_misclassified", f"WITH {_RUNS}, {_JUDGED} SELECT pkg_id, score::DOUBLE AS score, CASE WHEN label = 'malicious' THEN 'missed' WHEN verdict = 'block' THEN 'hard_fp' ELSE 'soft_fp' END AS kind FROM v WHERE (label = 'benign' AND verdict <> 'allow') OR (label = 'malicious' AND verdict = 'allow')")
def b10(spark, sf):
    j = judged(spark, sf)
    out = None
    for kind in ("hard_fp", "soft_fp", "missed"):
        one = calibrate.misclassified(j, kind).select("pkg_id", F.col("score").cast("double").alias("score"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def parted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Collapsed bags of the training and the validation part."""
    parts = calibrate.split(runs(spark, sf).drop("text"), 0.2, 1)
    found = signals(spark, sf)
    return tuple(calibrate.collapsed(parts.filter(F.col("part") == x), found.join(parts.filter(F.col("part") == x).select("pkg_id"), "pkg_id", "left_semi")) for x in ("train", "val"))


@query("b11_b15_search")
def b11(spark, sf):
    """Best setting of each branch after random trials and coordinate descent."""
    log = calibrate.search(*parted(spark, sf), config(), hard_cap=HARD, soft_cap=SOFT)
    return calibrate.best(log, ("min_categories",)).select("min_categories", "trial", "phase", "allow", "block", F.round("worth", 9).alias("worth"), *calibrate.COUNTS)


@query("b12_baseline", "SELECT key, weight::DOUBLE AS weight FROM " + values(WEIGHTS, "key, weight"))
def b12(spark, sf):
    return spark.createDataFrame(list(rules.default_weights(config()).items()), "key string, weight double")


@query("b14_b15_best_by_branch", f"WITH {_RUNS}, {_GRID} SELECT m::BIGINT AS min_categories, trial, round(worth, 9) AS worth FROM o JOIN g USING (trial) QUALIFY row_number() OVER (PARTITION BY m ORDER BY worth DESC, trial) = 1")
def b15(spark, sf):
    best = calibrate.best(rated(spark, sf).select("trial", "worth", "min_categories"), ("min_categories",))
    return best.select(F.col("min_categories").cast("long").alias("min_categories"), F.col("trial").cast("long").alias("trial"), F.round("worth", 9).alias("worth"))


@query("b16_feasible", f"WITH {_RUNS}, {_GRID} SELECT trial FROM o WHERE hard_fp <= {HARD} AND soft_fp <= {SOFT}")
def b16(spark, sf):
    return calibrate.feasible(rated(spark, sf), HARD, SOFT).select(F.col("trial").cast("long").alias("trial"))


@query("b17_pareto", f"""WITH {_RUNS}, {_GRID}, p AS (SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.catch >= x.catch AND y.hard_fp <= x.hard_fp AND y.soft_fp <= x.soft_fp AND (y.catch > x.catch OR y.hard_fp < x.hard_fp OR y.soft_fp < x.soft_fp))),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY benign_allow, benign_warn, benign_block, malicious_allow, malicious_warn, malicious_block ORDER BY trial) = 1)
SELECT trial, {_round_sql(("catch", "hard_fp", "soft_fp"))} FROM u ORDER BY u.catch DESC, u.soft_fp, u.hard_fp, u.block_recall DESC, trial LIMIT 12""")
def b17(spark, sf):
    return _rounded(calibrate.pareto(rated(spark, sf).drop("weights")).select(F.col("trial").cast("long").alias("trial"), "catch", "hard_fp", "soft_fp"), "catch", "hard_fp", "soft_fp")


@query("b18_rule_histogram", f"WITH {_RUNS}, {_JUDGED} SELECT rule, count(*) AS n FROM (SELECT unnest(CASE WHEN len(rules) = 0 THEN ['(no rules)'] ELSE rules END) AS rule FROM v) GROUP BY 1")
def b18(spark, sf):
    return calibrate.rule_histogram(judged(spark, sf))


@query("b19_miss_report", f"WITH {_RUNS}, {_JUDGED} SELECT CASE WHEN category = '' THEN '(uncategorised)' ELSE category END AS category, pkg_id, (0.3 - score)::DOUBLE AS margin FROM v WHERE label = 'malicious' AND verdict = 'allow' QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, pkg_id) <= 5")
def b19(spark, sf):
    return calibrate.miss_report(judged(spark, sf), 0.3, 5).select("category", "pkg_id", F.col("margin").cast("double").alias("margin"))


@query("b20_silent_rules", f"""WITH {_RUNS}, {_JUDGED}, m AS (SELECT * FROM v WHERE label = 'malicious'), f AS (SELECT DISTINCT unnest(rules) AS rule FROM m), k AS (SELECT DISTINCT CASE WHEN category = '' THEN '(uncategorised)' ELSE category END AS category FROM m WHERE verdict = 'allow'),
x AS (SELECT DISTINCT category, unnest(rules) AS rule FROM m WHERE verdict = 'allow')
SELECT k.category, f.rule FROM k CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.category = k.category AND x.rule = f.rule)""")
def b20(spark, sf):
    return calibrate.silent_rules(judged(spark, sf))


@query("b21_statistics", f"WITH {_RUNS}, {_GRID} SELECT trial, benign_warn + benign_block AS total_fp, {_round_sql(('catch', 'hard_fp'))} FROM q")
def b21(spark, sf):
    s = calibrate.statistics(calibrate.evaluate(bags(spark, sf), trials(spark)))
    return _rounded(s.select(F.col("trial").cast("long").alias("trial"), "total_fp", "catch", "hard_fp"), "catch", "hard_fp")


@query("b22_top_names", "SELECT name, weekly FROM (SELECT p_name AS name, max(l_orderkey) AS weekly FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY weekly DESC, name LIMIT 20)")
def b22(spark, sf):
    hits = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("name"), F.col("l_orderkey").alias("weekly"))
    return calibrate.top_names(hits, 20)


@query("b23_incremental", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def b23(spark, sf):
    c = table(spark, sf, "customer")
    known = table(spark, sf, "orders").filter("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"))
    return calibrate.not_imported(c.select(F.col("c_name").alias("name")), known)


@query("b24_content_dedupe", "SELECT sha256(text) AS sha256, min(doc_id) AS position FROM documents GROUP BY 1")
def b24(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), "lang")
    return calibrate.distinct_content(d).select("sha256", "position")


@query("b25_key_order", "SELECT key, place::BIGINT AS place FROM " + values([*((k, i) for i, (k, _) in enumerate(WEIGHTS)), ("zzz", 999), ("aaa", 999)], "key, place"))
def b25(spark, sf):
    return spark.createDataFrame([(k,) for k in (*(k for k, _ in WEIGHTS), "zzz", "aaa")], "key string").select("key", rules.key_order(F.col("key")).cast("long").alias("place"))


@query("b26_apply_weights", "SELECT key, weight::DOUBLE AS weight FROM " + values([(k, 0.3 if k == "entropy_obfuscation" else round(i / 100, 2)) for i, (k, _) in enumerate(WEIGHTS)], "key, weight"))
def b26(spark, sf):
    changed = rules.apply_weights(config(), {k: round(i / 100, 2) for i, (k, _) in enumerate(WEIGHTS)})
    return spark.createDataFrame(list(rules.default_weights(changed).items()), "key string, weight double")


@query("k7_trial_table", f"WITH {_RUNS}, {_GRID} SELECT trial, printf('%.4f', worth) AS score, printf('%.3f', a::DOUBLE) AS allow, printf('%.4f', catch) AS val_catch, printf('%.4f', (0.3 * s)::DOUBLE) AS cap_exec FROM o JOIN g USING (trial)")
def k7(spark, sf):
    weights = F.transform_values("weights", lambda k, v: v.cast("double"))
    return trial_table(rated(spark, sf).withColumn("weights", weights)).select(F.col("trial").cast("long").alias("trial"), "score", "allow", "val_catch", "cap_exec")
