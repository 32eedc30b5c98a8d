"""Queries for the name rules. Words of documents stand for package names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.config import load
from parapet.functions.strings import normalise, osa, strip_scope
from parapet.operators import names
from parapet.plans import scoring
from parapet.queries.base import SIGNAL_COLUMNS, query, table, values

POPULAR = ("react", "lodash", "express", "axios", "typescript", "@types/node", "@types/react", "@types/express", "react-dom")
PROBES = ("react", "raect", "reactzz", "react-dom", "l0dash", "react-fake", "js-react", "reactjs", "@typess/node", "@types/node", "@a/foo", "a.b", "express.", "Axios ", "$")
#: What each probe must give: name, rule, score, matched.
EXPECTED = [
    ("raect", "typosquat_close", 0.55, "react"),
    ("reactzz", "typosquat_warn", 0.3, "react"),
    ("l0dash", "typosquat_ascii_homoglyph", 0.65, "lodash"),
    ("react-fake", "typosquat_combosquat", 0.2, "react"),
    ("js-react", "typosquat_combosquat", 0.2, "react"),
    ("reactjs", "typosquat_warn", 0.3, "react"),
    ("@typess/node", "typosquat_scope_close", 0.55, "@types"),
    ("express.", "typosquat_close", 0.55, "express"),
]
#: The same for names that are not ASCII, with popular names that are not.
UNICODE_POPULAR = (*POPULAR, "ｅｘｐｒｅｓｓｏ", "ｖｕｅｊｓ", "ﬁbre", "@Ｔypes/ｊest")
UNICODE_PROBES = ("ｒｅａｃｔ", "ｒａｅｃｔ", "ｒeactzz", "l０dash", "ｒeact-fake", "ｅspresso", "espresso", "vuejs", "Ｖuejs", "fibre", "ﬁber", "@ｔypess/node", "①", "@ｔypes/node")
UNICODE_EXPECTED = [
    ("ｒａｅｃｔ", "typosquat_close", 0.55, "react"),
    ("ｒeactzz", "typosquat_warn", 0.3, "react"),
    ("l０dash", "typosquat_ascii_homoglyph", 0.65, "lodash"),
    ("ｒeact-fake", "typosquat_combosquat", 0.2, "react"),
    ("ｅspresso", "typosquat_close", 0.55, "expresso"),
    ("espresso", "typosquat_close", 0.55, "expresso"),
    ("ﬁber", "typosquat_close", 0.55, "fibre"),
    ("@ｔypess/node", "typosquat_scope_close", 0.55, "@types"),
]
OSA_PAIRS = [("react", "raect"), ("kitten", "sitting"), ("", "abc"), ("abc", ""), ("ab", "ba"), ("lodash", "lodahs"), ("same", "same"), ("types", "tpyse")]

_WORDS = "words AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) BETWEEN 4 AND 12 GROUP BY w)"
_POPULAR = "popular AS MATERIALIZED (SELECT w AS popular FROM words WHERE n >= 200)"
_EVERY = """words AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY w),
popular AS MATERIALIZED (SELECT w AS popular FROM words WHERE n >= 200 AND length(w) >= 4), probes AS MATERIALIZED (SELECT w AS bare FROM words ANTI JOIN popular ON w = popular)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    return each.filter(F.length("w").between(4, 12)).groupBy("w").agg(F.count("*").alias("n"))


def popular(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).filter("n >= 200").select(F.col("w").alias("popular"))


def every_word(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(all words that are not popular, popular words): words of any length and count, of whole texts.

    Words longer than the longest popular one by more than two have no neighbour, so they are left out before they are taken apart.
    """
    each = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter("w <> ''")
    w = each.groupBy("w").agg(F.count("*").alias("n"))
    known = (F.col("n") >= 200) & (F.length("w") >= 4)
    frequent = w.filter(known).select(F.col("w").alias("popular"))
    longest = frequent.agg(F.max(F.length("popular")).alias("longest"))
    rest = w.filter(~known).join(F.broadcast(longest), F.length("w") <= F.col("longest") + 2)
    return rest.select(F.col("w").alias("pkg_id"), F.col("w").alias("full"), F.col("w").alias("bare")), frequent


def scoped_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("@"), "p_type", F.lit("/"), "p_name").alias("name"))


@query("t1_normalise", "SELECT * FROM " + values([("ＲＥＡＣＴ", "react"), (" Lodash ", "lodash"), ("ﬁx", "fix"), ("①", "1"), ("", "")], "name, normal"))
def t1(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("ＲＥＡＣＴ", " Lodash ", "ﬁx", "①", "")], "name string")
    return rows.select("name", normalise(F.col("name")).alias("normal"))


@query("t2_strip_scope", "SELECT p_partkey, regexp_replace('@' || p_type || '/' || p_name, '^@[^/]*/', '') AS bare FROM part")
def t2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", strip_scope(F.concat(F.lit("@"), "p_type", F.lit("/"), "p_name")).alias("bare"))


@query("t3_reference_build", "SELECT DISTINCT lower(p_name) AS popular FROM part")
def t3(spark, sf):
    return names.reference(scoped_parts(spark, sf))


@query("t3_popular_scopes", "SELECT '@' || lower(p_type) AS scope FROM part GROUP BY 1 HAVING count(*) >= 3")
def t3_scopes(spark, sf):
    return names.popular_scopes(scoped_parts(spark, sf))


@query("t4_exact_popular", f"WITH {_WORDS}, {_POPULAR} SELECT w AS bare FROM words ANTI JOIN popular ON w = popular")
def t4(spark, sf):
    every = words(spark, sf).select(F.col("w").alias("pkg_id"), F.col("w").alias("full"), F.col("w").alias("bare"))
    return names.not_popular(every, popular(spark, sf)).select("bare")


@query("t5_homoglyph", f"WITH {_WORDS}, {_POPULAR}, m AS (SELECT DISTINCT translate(w, 'oea', '03@') AS bare FROM words) SELECT bare, translate(bare, '0O1I53@$', 'oollseas') AS matched FROM m WHERE translate(bare, '0O1I53@$', 'oollseas') <> bare AND translate(bare, '0O1I53@$', 'oollseas') IN (SELECT popular FROM popular)")
def t5(spark, sf):
    masked = words(spark, sf).select(F.translate("w", "oea", "03@").alias("bare")).distinct().select(F.col("bare").alias("pkg_id"), "bare")
    return names.homoglyphs(masked, popular(spark, sf)).select("bare", "matched")


@query("t6_combosquat", """WITH r AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS popular FROM part),
s AS (SELECT p_partkey, replace(p_name, ' ', '-') AS bare, unnest(range(1, 3)) AS pos, unnest(string_split(p_name, ' ')) AS part FROM part)
SELECT p_partkey::VARCHAR AS pkg_id, bare, arg_min(part, pos) AS matched FROM s JOIN r ON part = popular WHERE strlen(part) >= 4 GROUP BY 1, 2""")
def t6(spark, sf):
    part = table(spark, sf, "part")
    known = part.select(F.split("p_name", " ")[1].alias("popular")).distinct()
    return names.combosquats(part.select(F.col("p_partkey").cast("string").alias("pkg_id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("bare")), known)


@query("t7_edit_distance", f"""WITH {_EVERY},
n AS (SELECT bare, popular, damerau_levenshtein(bare, popular) AS d FROM probes JOIN popular ON abs(length(bare) - length(popular)) <= 2 AND levenshtein(bare, popular) <= 2),
b AS (SELECT bare, min(d) AS d FROM n GROUP BY bare)
SELECT b.bare, b.d::BIGINT AS d, min(n.popular) AS matched FROM b JOIN n ON n.bare = b.bare AND n.d = b.d GROUP BY 1, 2""")
def t7(spark, sf):
    """Every word that is not popular is a probe."""
    return names.neighbours(*every_word(spark, sf)).select("bare", F.col("d").cast("long").alias("d"), "matched")


@query("t8_neighbour_pairs", f"""WITH {_EVERY}
SELECT count(*) AS n FROM (SELECT DISTINCT bare FROM probes JOIN popular ON abs(length(bare) - length(popular)) <= 1 AND levenshtein(bare, popular) <= 1)""")
def t8(spark, sf):
    return names.neighbours(*every_word(spark, sf), 1).select("bare").distinct().agg(F.count("*").alias("n"))


@query("t9_levenshtein", "WITH t AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, levenshtein(x.a, y.a)::BIGINT AS d FROM t x JOIN t y ON x.a < y.a AND levenshtein(x.a, y.a) <= 3")
def t9(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 3) >= 0)).select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


@query("t9_alignment_distance", "SELECT a, b, damerau_levenshtein(a, b)::BIGINT AS d FROM " + values(OSA_PAIRS, "a, b"))
def t9_osa(spark, sf):
    return spark.createDataFrame(OSA_PAIRS, "a string, b string").selectExpr("a", "b", f"cast({osa('a', 'b')} as long) as d")


@query("t10_scopes", """WITH own AS (SELECT DISTINCT '@' || lower(p_brand) AS scope FROM part), known AS (SELECT scope FROM own WHERE scope IN ('@brand#1', '@brand#12', '@brand#25'))
, n AS (SELECT own.scope, known.scope AS popular, damerau_levenshtein(own.scope, known.scope) AS d FROM own, known WHERE own.scope NOT IN (SELECT scope FROM known) AND abs(strlen(own.scope) - strlen(known.scope)) <= 2)
SELECT scope, min(d)::BIGINT AS d, arg_min(popular, (d, popular)) AS matched FROM n WHERE d <= 2 GROUP BY scope""")
def t10(spark, sf):
    own = table(spark, sf, "part").select(F.concat(F.lit("@"), F.lower("p_brand"), F.lit("/x")).alias("full")).distinct().select(F.col("full").alias("pkg_id"), "full")
    known = spark.createDataFrame([("@brand#1",), ("@brand#12",), ("@brand#25",)], "scope string")
    return names.near_scopes(own, known).select("scope", F.col("d").cast("long").alias("d"), "matched").distinct()


def name_rules(spark: SparkSession, probes: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    packages = spark.createDataFrame([(x, x) for x in probes], "pkg_id string, name string")
    lines = spark.createDataFrame([(x,) for x in known], "name string")
    found = names.name_signals(packages, lines, load(env={}))
    return found.select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "matched")


@query("t_name_rules", "SELECT pkg_id, rule, score::DOUBLE AS score, matched FROM " + values(EXPECTED, "pkg_id, rule, score, matched"))
def t_rules(spark, sf):
    return name_rules(spark, PROBES, POPULAR)


@query("t_name_rules_unicode", "SELECT pkg_id, rule, score::DOUBLE AS score, matched FROM " + values(UNICODE_EXPECTED, "pkg_id, rule, score, matched"))
def t_rules_unicode(spark, sf):
    return name_rules(spark, UNICODE_PROBES, UNICODE_POPULAR)


#: Names three edits away, found where the configured distance is three.
FAR = [("expressxyz", "typosquat_warn", 0.3, "express"), ("ｌｏｄａｓｈｘｙｚ", "typosquat_warn", 0.3, "lodash"), ("typexcript", "typosquat_close", 0.55, "typescript")]


@query("t7_first_layer_far", "SELECT pkg_id, rule, score::DOUBLE AS score, matched FROM " + values(FAR, "pkg_id, rule, score, matched"))
def t7_far(spark, sf):
    """The name rules of the scoring plan's first layer with full-width names and a distance of three."""
    packages = spark.createDataFrame([(x, x, "1.0.0") for x in (*(f[0] for f in FAR), "unlike", "lodash")], "pkg_id string, name string, version string").withColumn("created", F.lit("2020-01-01").cast("timestamp"))
    none = lambda schema: spark.createDataFrame([], schema)
    s = scoring.Snapshot(
        packages,
        none("pkg_id string, version string, ts timestamp"),
        none("pkg_id string, maintainer string"),
        none("pkg_id string, monthly long"),
        none("maintainer string, created timestamp"),
        none("name string, version string"),
        spark.createDataFrame([("lodash",), ("express",), ("typescript",)], "name string"),
        none("pkg_id string, path string, src string"),
    )
    found = scoring.first_layer(s, F.lit("2025-01-01").cast("timestamp"), load(env={}, layer1={"typosquat_warn_distance": 3}))
    return found.select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "matched")


@query("t11_advisory_veto", "SELECT DISTINCT doc_id::VARCHAR AS pkg_id, 'osv_known_vulnerability' AS rule, 0.0::DOUBLE AS score, true AS veto, 'CWE-1035' AS cwe, '' AS matched, '' AS detail FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def t11(spark, sf):
    packages = table(spark, sf, "documents").select(F.col("doc_id").alias("pkg_id"), F.col("doc_id").alias("name"), F.lit("1.0.0").alias("version"))
    known = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("name"), F.lit("1.0.0").alias("version"))
    return names.advisory_signals(packages, known).selectExpr(*SIGNAL_COLUMNS)
