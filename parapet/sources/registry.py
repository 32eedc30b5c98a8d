"""Registry documents, manifests and snapshots of remote services as relations."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = (
    "struct<name:string,version:string,description:string,scripts:map<string,string>,license:variant,"
    "dist:struct<shasum:string,integrity:string,tarball:string,unpackedSize:bigint>,"
    "dependencies:map<string,string>,devDependencies:map<string,string>,maintainers:array<struct<name:string,email:string>>>"
)
DOCUMENT = f"name string, time map<string,string>, `dist-tags` map<string,string>, maintainers array<struct<name:string,email:string>>, versions map<string,{VERSION}>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Registry documents of a folder of JSON files; a broken one fails the read."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def parsed(raw: DataFrame, column: str = "document") -> DataFrame:
    """S3 over a column of JSON; documents that do not parse have doc null."""
    return raw.withColumn("doc", F.from_json(column, DOCUMENT))


def version_documents(raw: DataFrame, column: str = "document") -> DataFrame:
    """Single-version documents."""
    return raw.withColumn("doc", F.from_json(column, VERSION))


def license_text(license: Column) -> Column:
    """A licence is a string, or an object with its type; '' otherwise."""
    return F.coalesce(F.try_variant_get(license, "$.type", "string"), F.when(F.schema_of_variant(license) == "STRING", F.try_variant_get(license, "$", "string")), F.lit(""))


def versions(docs: DataFrame) -> DataFrame:
    """One row a version: name, version, license, scripts, deps, dev_deps, shasum, integrity, tarball."""
    each = docs.select("name", F.explode("versions").alias("version", "v"))
    return each.select(
        "name", "version", license_text(F.col("v.license")).alias("license"), F.col("v.scripts").alias("scripts"), F.col("v.dependencies").alias("deps"), F.col("v.devDependencies").alias("dev_deps"), "v.dist.shasum", "v.dist.integrity", "v.dist.tarball"
    )


def publishes(docs: DataFrame) -> DataFrame:
    """pkg_id, version, ts: every parsable time of a document, created and modified among them."""
    each = docs.select(F.col("name").alias("pkg_id"), F.explode("time").alias("version", "at"))
    return each.select("pkg_id", "version", F.try_to_timestamp("at").alias("ts")).filter("ts IS NOT NULL")


def packages(docs: DataFrame) -> DataFrame:
    """pkg_id, name, latest, created."""
    return docs.select(F.col("name").alias("pkg_id"), "name", F.col("dist-tags")["latest"].alias("latest"), F.try_to_timestamp(F.col("time")["created"]).alias("created"))


def maintainers(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("name").alias("pkg_id"), F.explode("maintainers").alias("m")).select("pkg_id", F.col("m.name").alias("maintainer"))


def latest_tarballs(docs: DataFrame) -> DataFrame:
    """Name, version, tarball of the latest version."""
    latest = F.col("dist-tags")["latest"]
    return docs.select("name", latest.alias("version"), F.col("versions")[latest]["dist"]["tarball"].alias("tarball")).filter("tarball IS NOT NULL")


def user_created(users: DataFrame) -> DataFrame:
    """S8 over users (maintainer, profile JSON): created, or time.created; no row if neither parses."""
    at = F.coalesce(F.try_to_timestamp(F.get_json_object("profile", "$.created")), F.try_to_timestamp(F.get_json_object("profile", "$.time.created")))
    return users.select("maintainer", at.alias("created")).filter("created IS NOT NULL")


def monthly_downloads(points: DataFrame) -> DataFrame:
    """S7 over points (pkg_id, point JSON)."""
    return points.select("pkg_id", F.get_json_object("point", "$.downloads").try_cast("long").alias("monthly")).filter("monthly IS NOT NULL")


def manifests(files: DataFrame) -> DataFrame:
    """pkg_id, scripts of a package's manifest: package/package.json, else package.json, else the first path that ends so.

    A manifest in which any script is no string, or that is no JSON, is left out as a whole.
    """
    wanted = files.filter(F.col("path").endswith("package/package.json") | (F.col("path") == "package.json"))
    order = F.struct(F.when(F.col("path") == "package/package.json", 0).when(F.col("path") == "package.json", 1).otherwise(2), F.col("path"))
    one = wanted.groupBy("pkg_id").agg(F.min_by("src", order).alias("src"))
    v = F.try_parse_json("src")
    scripts = F.try_variant_get(v, "$.scripts", "map<string,variant>")
    kinds = F.map_values(scripts)
    sound = F.coalesce(F.forall(kinds, lambda x: x.isNull() | F.schema_of_variant(x).isin("STRING", "VOID")), F.lit(True))
    whole = F.schema_of_variant(v).startswith("OBJECT") & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.scripts", "variant")).startswith("OBJECT") | F.schema_of_variant(F.try_variant_get(v, "$.scripts", "variant")).isin("VOID"), F.lit(True))
    texts = F.transform_values(F.coalesce(scripts, F.create_map().cast("map<string,variant>")), lambda k, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    return one.withColumn("v", v).filter(F.col("v").isNotNull()).filter(whole & sound).select("pkg_id", texts.alias("scripts"))


def get(url: str, retries: int = 2, timeout: float = 30, limit: int = 10 << 20, wait: float = 0.5, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes:
    """A GET with retries after attempt² times `wait`; at most `limit` bytes are read. For loading snapshots, on the driver."""
    for attempt in range(retries + 1):
        if attempt:
            sleep(attempt * attempt * wait)
        try:
            with opener(url, timeout=timeout) as r:
                return r.read(limit)
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
    raise AssertionError


def search_hits(pages: DataFrame, per_seed: int = 2000) -> DataFrame:
    """S14 and S15 over snapshots of search pages (seed, page, objects array<struct<name, weekly>>): name, weekly in page order, the first per_seed of a seed."""
    each = pages.select("seed", "page", F.posexplode("objects").alias("at", "o")).select("seed", (F.col("page") * 250 + F.col("at")).alias("position"), F.col("o.name").alias("name"), F.col("o.weekly").alias("weekly"))
    return each.filter(F.col("position") < per_seed)
