"""Queries for metadata and version rules: customers stand for packages, their orders for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.config import load
from parapet.functions.semver import is_patch_bump, key, previous_of
from parapet.operators import metadata, versions
from parapet.queries.base import query, table, values

AS_OF = "1998-01-01 00:00:00"
CONFIG = {"metadata_new_package_days": 400, "metadata_low_downloads_threshold": 3, "metadata_popular_threshold": 12, "metadata_popular_stale_days": 200, "metadata_young_maintainer_days": 900}
VERSIONS = ["1.0.0", "1.0.1-rc.2", "1.0.1-rc.10", "1.0.1-rc1", "1.0.1", "2.0.0", "v1.2", "x", "1.0.1+b", "0.9"]


def config():
    return load(env={}, layer1=CONFIG)


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def publishes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("pkg_id"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def plain(signals: DataFrame) -> DataFrame:
    return signals.select("pkg_id", "rule", F.col("score").cast("double").alias("score"))


@query("m1_new_package", f"SELECT o_custkey::VARCHAR AS pkg_id, 'metadata_new_package' AS rule, 0.2::DOUBLE AS score FROM orders GROUP BY o_custkey HAVING min(o_orderdate) > TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY")
def m1(spark, sf):
    return plain(metadata.new_package(publishes(spark, sf).groupBy("pkg_id").agg(F.min("ts").alias("created")), as_of(), config()))


@query("m2_single_maintainer", "SELECT l_partkey::VARCHAR AS pkg_id, 'metadata_single_maintainer' AS rule, 0.05::DOUBLE AS score FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 48) GROUP BY l_partkey HAVING count(*) = 1")
def m2(spark, sf):
    held = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("pkg_id"), F.col("l_returnflag").alias("maintainer")).distinct()
    return plain(metadata.single_maintainer(held, config()))


@query("m3_m4_downloads", f"""WITH d AS (SELECT o_custkey, count(*) AS monthly, max(o_orderdate) AS latest FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS pkg_id, 'metadata_low_downloads' AS rule, 0.05::DOUBLE AS score FROM d WHERE monthly < 3
UNION ALL SELECT o_custkey::VARCHAR, 'metadata_popular_but_stale', 0.15::DOUBLE FROM d WHERE monthly >= 12 AND latest < TIMESTAMP '2001-06-01' - INTERVAL 200 DAY""")
def m3(spark, sf):
    p = publishes(spark, sf)
    return plain(metadata.download_signals(p.groupBy("pkg_id").agg(F.count("*").alias("monthly")), p, F.to_timestamp(F.lit("2001-06-01 00:00:00")), config()))


@query("m5_young_maintainers", f"""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), u AS (SELECT l_suppkey, min(l_shipdate) AS created FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 45 GROUP BY 1)
SELECT l_partkey::VARCHAR AS pkg_id, 'metadata_young_maintainer' AS rule, 0.25::DOUBLE AS score FROM m JOIN u USING (l_suppkey) WHERE created > TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY""")
def m5(spark, sf):
    items = table(spark, sf, "lineitem")
    held = items.select(F.col("l_partkey").alias("pkg_id"), F.col("l_suppkey").alias("maintainer")).distinct()
    users = items.filter("l_linenumber = 7 AND l_quantity > 45").groupBy(F.col("l_suppkey").alias("maintainer")).agg(F.min("l_shipdate").cast("timestamp").alias("created"))
    return plain(metadata.young_maintainers(held, users, as_of(), config()))


@query("m6_latest_publish", "SELECT o_custkey::VARCHAR AS pkg_id, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def m6(spark, sf):
    return metadata.latest_publish(publishes(spark, sf)).select("pkg_id", F.col("latest").cast("timestamp_ntz").alias("latest"))


@query("m7_version_spike", "SELECT user_id::VARCHAR AS pkg_id, 'anomaly_version_spike' AS rule, 0.2::DOUBLE AS score FROM events WHERE ts > TIMESTAMP '2024-01-29 23:00:00' - INTERVAL 1 DAY GROUP BY 1 HAVING count(*) > 5")
def m7(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("pkg_id"), F.col("event_id").cast("string").alias("version"), F.col("ts").cast("timestamp").alias("ts"))
    return plain(metadata.version_spike(e, F.to_timestamp(F.lit("2024-01-29 23:00:00")), config()))


@query("m7_burst_history", """SELECT user_id::VARCHAR AS pkg_id, event_id::VARCHAR AS version,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_day FROM events""")
def m7_history(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("pkg_id"), F.col("event_id").cast("string").alias("version"), F.col("ts").cast("timestamp").alias("ts"))
    return metadata.burst_history(e).select("pkg_id", "version", "in_day")


#: Orders of a customer as versions: 1.<year>.<place in the year>.
_HISTORY = """h AS (SELECT o_custkey::VARCHAR AS pkg_id, o_orderkey, o_orderpriority, o_orderstatus, '1.' || (year(o_orderdate) - 1995) || '.' || (row_number() OVER w - 1) AS version,
  year(o_orderdate) - 1995 AS y, row_number() OVER w - 1 AS p FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT *, lag(version) OVER l AS previous, lag(o_orderpriority) OVER l AS previous_license, lag(o_orderstatus) OVER l AS previous_status, lag(o_orderkey) OVER l AS previous_key,
  lag(y) OVER l = y AND lag(p) OVER l = p - 1 AS bump FROM h WINDOW l AS (PARTITION BY pkg_id ORDER BY y, p))"""


def order_history(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select(
        F.col("o_custkey").cast("string").alias("pkg_id"), "o_orderkey", F.concat(F.lit("1."), F.year("o_orderdate") - 1995, F.lit("."), nth).alias("version"), F.col("o_orderpriority").alias("license"), F.col("o_orderstatus").alias("status")
    )


@query("m8_license_change", f"WITH {_HISTORY} SELECT pkg_id, 'license_patch_change' AS rule, 0.15::DOUBLE AS score, previous_license || ' -> ' || o_orderpriority AS detail FROM b WHERE bump AND previous_license <> o_orderpriority")
def m8(spark, sf):
    found = metadata.license_change(versions.with_previous(order_history(spark, sf), "license"), config())
    return found.select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "detail")


@query("v1_patch_bump", "SELECT * FROM " + values([("1.0.0", "1.0.1", True), ("1.0", "v1.0.1", True), ("1.0.0", "1.1.0", False), ("1.0.1-rc1", "1.0.1", False), ("x", "1.0.1", False), ("1.0.0", "1.0.2", False), ("2.0.0", "1.0.1", False)], "a, b, bump"))
def v1(spark, sf):
    rows = spark.createDataFrame([("1.0.0", "1.0.1"), ("1.0", "v1.0.1"), ("1.0.0", "1.1.0"), ("1.0.1-rc1", "1.0.1"), ("x", "1.0.1"), ("1.0.0", "1.0.2"), ("2.0.0", "1.0.1")], "a string, b string")
    return rows.select("a", "b", is_patch_bump(F.col("a"), F.col("b")).alias("bump"))


@query("v2_previous_in_history", f"WITH {_HISTORY} SELECT pkg_id, version, previous FROM b")
def v2(spark, sf):
    return versions.with_previous(order_history(spark, sf)).select("pkg_id", "version", "previous")


@query("v2_previous_version", "SELECT * FROM " + values([("1.0.0", "0.9"), ("1.0.1-rc.2", "1.0.0"), ("1.0.1-rc.10", "1.0.1-rc.2"), ("1.0.1-rc1", "1.0.1-rc.10"), ("1.0.1", "1.0.1-rc1"), ("1.0.1+b", "1.0.1-rc1"), ("v1.2", "1.0.1+b"), ("2.0.0", "v1.2"), ("0.9", None), ("x", None)], "version, previous"))
def v2_inline(spark, sf):
    rows = spark.createDataFrame([(v, VERSIONS) for v in VERSIONS], "version string, every array<string>")
    return rows.select("version", previous_of(F.col("every"), F.col("version")).alias("previous"))


@query("v2_version_order", "SELECT version, place::BIGINT AS place FROM " + values([("0.9", 1), ("1.0.0", 2), ("1.0.1-rc.2", 3), ("1.0.1-rc.10", 4), ("1.0.1-rc1", 5), ("1.0.1", 6), ("1.0.1+b", 6), ("v1.2", 7), ("2.0.0", 8)], "version, place"))
def v2_order(spark, sf):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(v,) for v in VERSIONS], "version string").withColumn("k", key(F.col("version"))).filter("k IS NOT NULL")
    return rows.select("version", F.dense_rank().over(Window.orderBy("k")).cast("long").alias("place"))


@query("v3_resolve_version", "SELECT * FROM " + values([("/lodash/-/lodash-1.0.0.tgz", "1.0.0", "1.0.0"), ("/lodash/-/lodash-9.9.9.tgz", "2.0.0", "9.9.9"), ("/@a/b/-/b-1.0.0.tgz", "2.0.0", ""), ("/lodash", "2.0.0", "")], "path, resolved, requested"))
def v3(spark, sf):
    rows = spark.createDataFrame([(p,) for p in ("/lodash/-/lodash-1.0.0.tgz", "/lodash/-/lodash-9.9.9.tgz", "/@a/b/-/b-1.0.0.tgz", "/lodash")], "path string")
    r = versions.resolve_version(F.lit("lodash"), F.col("path"), F.array(F.lit("1.0.0"), F.lit("2.0.0")), F.lit("2.0.0"))
    return rows.withColumn("r", r).select("path", "r.resolved", "r.requested")


def with_scripts(spark: SparkSession, sf: str) -> DataFrame:
    h = order_history(spark, sf).withColumn("scripts", F.when(F.col("status") == "P", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("postinstall"), F.concat(F.lit(" "), F.col("status")))))
    return versions.with_previous(h, "scripts")


@query("v4_script_diff", f"""WITH {_HISTORY} SELECT pkg_id, CASE WHEN previous_status = 'P' THEN 'version_diff_new_script_postinstall' ELSE 'version_diff_changed_script_postinstall' END AS rule,
CASE WHEN previous_status = 'P' THEN 0.4 ELSE 0.25 END::DOUBLE AS score FROM b WHERE bump AND o_orderstatus <> 'P' AND o_orderstatus <> previous_status""")
def v4(spark, sf):
    return plain(versions.script_diff(with_scripts(spark, sf), config()))


_DEPS = """d AS (SELECT l_orderkey, list_distinct(list('d' || (l_partkey % 20))) AS deps, list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'exec' WHEN 'R' THEN 'net_access' ELSE 'env_read' END)) AS caps FROM lineitem GROUP BY 1),
x AS (SELECT b.*, coalesce(n.deps, []) AS deps, coalesce(o.deps, []) AS previous_deps, coalesce(n.caps, []) AS caps, coalesce(o.caps, []) AS previous_caps
  FROM b LEFT JOIN d n ON n.l_orderkey = b.o_orderkey LEFT JOIN d o ON o.l_orderkey = b.previous_key)"""


def with_lines(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.when(F.col("l_returnflag") == "A", F.lit("exec")).when(F.col("l_returnflag") == "R", F.lit("net_access")).otherwise(F.lit("env_read"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("d"), F.col("l_partkey") % 20)).alias("names"), F.collect_set(cap).alias("caps"))
    deps = F.map_from_arrays("names", F.transform("names", lambda x: F.lit("1")))
    h = order_history(spark, sf).withColumn("scripts", F.create_map(F.lit("install"), F.col("status"))).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    h = h.withColumn("deps", deps).withColumn("dev_deps", F.create_map().cast("map<string,string>")).withColumn("caps", F.coalesce("caps", F.array().cast("array<string>")))
    return versions.with_previous(h, "scripts", "deps", "dev_deps", "caps")


@query("v5_dependency_diff", f"""WITH {_HISTORY}, {_DEPS}, n AS (SELECT pkg_id, list_sort(list_filter(deps, lambda k: NOT list_contains(previous_deps, k))) AS fresh FROM x WHERE bump)
SELECT pkg_id, 'version_diff_new_dependency' AS rule, least(0.1 * len(fresh), 0.35)::DOUBLE AS score,
'new_deps=' || array_to_string(fresh[1:5], ',') || CASE WHEN len(fresh) > 5 THEN ' (+' || (len(fresh) - 5) || ' more)' ELSE '' END AS detail FROM n WHERE len(fresh) > 0""")
def v5(spark, sf):
    found = versions.dependency_diff(with_lines(spark, sf), config())
    return found.select("pkg_id", "rule", F.col("score").cast("double").alias("score"), "detail")


@query("v6_capability_diff", f"""WITH {_HISTORY}, {_DEPS}, c AS (SELECT * FROM x WHERE bump AND o_orderstatus <> previous_status)
SELECT pkg_id, 'version_diff_new_exec_in_patch' AS rule, 0.35::DOUBLE AS score FROM c WHERE list_contains(caps, 'exec') AND NOT list_contains(previous_caps, 'exec')
UNION ALL SELECT pkg_id, 'version_diff_new_net_in_patch', 0.25::DOUBLE FROM c WHERE list_contains(caps, 'net_access') AND NOT list_contains(previous_caps, 'net_access')""")
def v6(spark, sf):
    return plain(versions.capability_diff(with_lines(spark, sf), config()))
