"""Verdict cache, request outcomes and rechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.operators import policy

ROUTE = r"^/(@[^/]+/[^/]+|[^/]+)/-/([^/]+\.tgz)$"


def routed(requests: DataFrame) -> DataFrame:
    """Of requests (method, path, ...) whether each asks for an archive, and of which package; others pass through."""
    name = F.regexp_extract("path", ROUTE, 1)
    return requests.withColumn("is_archive", (F.col("method") == "GET") & (name != "")).withColumn("package_name", F.when(F.col("is_archive"), name))


def latest(entries: DataFrame, key: str = "sha256", at: str = "analyzed_at") -> DataFrame:
    """K5 and K6: an append-only table as a map: of each key the last entry. Equal times go to the greater row."""
    names = [c for c in entries.columns if c not in (key, at)]
    row = F.struct(F.col(at), *[F.col(c) for c in names])
    return entries.groupBy(key).agg(F.max(row).alias("row")).select(key, "row.*")


def put(entries: DataFrame, ttl_hours: float) -> DataFrame:
    """Entries with the time at which they end."""
    return entries.withColumn("expires_at", F.col("analyzed_at") + F.make_interval(secs=F.lit(float(ttl_hours * 3600)).cast("decimal(18,6)")))


def alive(entries: DataFrame, as_of: Column) -> DataFrame:
    return latest(entries).filter(F.col("expires_at") > as_of)


def lookup(archives: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """R2: archives (sha256, ...) with the cached verdict, null where there is none; names do not matter."""
    held = alive(entries, as_of).select("sha256", F.col("verdict").alias("cached_verdict"), F.col("score").alias("cached_score"), F.col("rules").alias("cached_rules"))
    return archives.join(held, "sha256", "left").withColumn("hit", F.col("cached_verdict").isNotNull())


def cached_events(hits: DataFrame) -> DataFrame:
    """The event of a cached answer: response code 200 whatever the verdict, and no CWEs."""
    return hits.filter("hit").select(
        F.lit("package_verdict").alias("event_type"), "sha256", F.col("cached_verdict").alias("verdict"), F.col("cached_score").alias("risk_score"), F.col("cached_rules").alias("triggered_rules"), F.lit(None).cast("string").alias("cwe_ids"), F.lit(200).alias("response_code")
    )


def list_verdicts(entries: DataFrame, as_of: Column, verdicts: list[str], most: int) -> DataFrame:
    """At most `most` live entries with one of the verdicts, the first by key."""
    return alive(entries, as_of).filter(F.col("verdict").isin(*verdicts)).orderBy("sha256").limit(most)


def due(entries: DataFrame, as_of: Column, verdicts: list[str], most: int, rechecked: DataFrame | None = None) -> DataFrame:
    """At most `most` live entries with one of the verdicts: those never rechecked first, then those whose last recheck (sha256, rechecked_at) is longest ago, by key within."""
    if rechecked is None:
        return list_verdicts(entries, as_of, verdicts, most)
    last = rechecked.groupBy("sha256").agg(F.max("rechecked_at").alias("last"))
    wanted = alive(entries, as_of).filter(F.col("verdict").isin(*verdicts)).join(last, "sha256", "left")
    return wanted.orderBy(F.col("last").asc_nulls_first(), "sha256").limit(most).drop("last")


def fresh_advisories(cached: DataFrame, as_of: Column) -> DataFrame:
    """Name, version, known: '1' vulnerable, '0' not; no row where nothing is known any more."""
    key = cached.withColumn("key", F.concat_ws("@", "name", "version"))
    return latest(key, "key", "checked_at").filter(F.col("expires_at") > as_of).select("name", "version", F.col("flag").alias("known"))


def recheck(entries: DataFrame, as_of: Column, advisories: DataFrame, name_signals: DataFrame, config, rechecked: DataFrame | None = None) -> DataFrame:
    """Cached warnings decided anew by advisories and names alone; only new blocks come out, with the union of rules.

    name_signals are of pkg_id = sha256. One call is one run of the loop; streaming.rechecks() repeats it.
    With a log of rechecks (to which a run adds what due() gives) every entry gets its turn.
    """
    from parapet.operators.names import advisory_signals

    wanted = ["warn"] if config.recheck.warn_only else ["warn", "allow"]
    batch = due(entries, as_of, wanted, config.recheck.batch_size, rechecked)
    packages = batch.select(F.col("sha256").alias("pkg_id"), "name", "version")
    own = name_signals.join(packages.select("pkg_id"), "pkg_id", "left_semi")
    now = policy.decide(packages, advisory_signals(packages, advisories).unionByName(own), config)
    up = now.filter("verdict = 'block'").select(F.col("pkg_id").alias("sha256"), F.col("score").alias("new_score"), F.col("rules").alias("new_rules"))
    both = F.array_union(F.filter(F.split("rules", ","), lambda x: x != ""), F.filter(F.split("new_rules", ","), lambda x: x != ""))
    return batch.join(up, "sha256").select("sha256", "name", "version", F.lit("block").alias("verdict"), F.col("new_score").alias("score"), F.array_join(both, ",").alias("rules"), as_of.alias("analyzed_at"))


def outcomes(requests: DataFrame) -> DataFrame:
    """One event a request, by its first failure: columns upstream_error, integrity_error, resource_error, timed_out, verdict, http_status.

    Failures of the upstream give 502; what cannot be verified, unpacked or finished is refused.
    """
    bad = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = (
        F.when(bad("upstream_error"), F.lit("upstream_down"))
        .when(bad("integrity_error"), F.lit("integrity_mismatch"))
        .when(bad("resource_error"), F.lit("resource_limit"))
        .when(F.coalesce("timed_out", F.lit(False)), F.lit("analysis_timeout"))
        .otherwise(F.lit("package_verdict"))
    )
    return requests.withColumn("event_type", kind).withColumn(
        "response_code", F.when(F.col("event_type") == "upstream_down", F.lit(502)).when(F.col("event_type") != "package_verdict", F.lit(403)).otherwise(F.col("http_status"))
    )
