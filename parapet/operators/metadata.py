"""Layer 1, metadata: age, maintainers, downloads, release bursts, licences (M1 to M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.semver import is_patch_bump
from parapet.schema import fired, signal, union


def younger(ts: Column, as_of: Column, days: float) -> Column:
    """Whether ts is less than so many days before as_of; the future is younger too."""
    return ts > as_of - F.make_interval(days=F.lit(int(days)))


def new_package(packages: DataFrame, as_of: Column, config) -> DataFrame:
    """M1 over packages (pkg_id, created timestamp)."""
    one = config.layer1
    return fired(packages, (younger(F.col("created"), as_of, one.metadata_new_package_days), signal("metadata_new_package", one.metadata_new_package_score)))


def single_maintainer(maintainers: DataFrame, config) -> DataFrame:
    """M2 over maintainers (pkg_id, maintainer)."""
    n = maintainers.groupBy("pkg_id").agg(F.count("*").alias("n"))
    return fired(n, (F.col("n") == 1, signal("metadata_single_maintainer", config.layer1.metadata_single_maintainer_score)))


def latest_publish(publishes: DataFrame) -> DataFrame:
    """M6: the latest time of publishes (pkg_id, version, ts); the entries created and modified are no versions."""
    return publishes.filter(~F.col("version").isin("created", "modified") & F.col("ts").isNotNull()).groupBy("pkg_id").agg(F.max("ts").alias("latest"))


def download_signals(downloads: DataFrame, publishes: DataFrame, as_of: Column, config) -> DataFrame:
    """M3 and M4 over downloads (pkg_id, monthly)."""
    one = config.layer1
    known = downloads.join(latest_publish(publishes), "pkg_id", "left")
    low = F.lit(one.metadata_low_downloads_threshold > 0) & (F.col("monthly") < one.metadata_low_downloads_threshold)
    stale = (F.col("monthly") >= one.metadata_popular_threshold) & (F.col("latest") < as_of - F.make_interval(days=F.lit(one.metadata_popular_stale_days)))
    return fired(known, (low, signal("metadata_low_downloads", one.metadata_low_downloads_score)), (stale, signal("metadata_popular_but_stale", one.metadata_popular_stale_score)))


def young_maintainers(maintainers: DataFrame, users: DataFrame, as_of: Column, config) -> DataFrame:
    """M5: one signal for each maintainer whose account (users: maintainer, created) is young."""
    one = config.layer1
    return fired(
        maintainers.join(users, "maintainer"),
        (younger(F.col("created"), as_of, one.metadata_young_maintainer_days), signal("metadata_young_maintainer", one.metadata_young_maintainer_score, detail=F.col("maintainer").cast("string"))),
    )


def version_spike(publishes: DataFrame, as_of: Column, config) -> DataFrame:
    """M7: more than the allowed number of versions in the 24 hours before as_of."""
    one = config.layer1
    recent = publishes.filter(~F.col("version").isin("created", "modified") & younger(F.col("ts"), as_of, 1)).groupBy("pkg_id").agg(F.count("*").alias("n"))
    return fired(recent, (F.col("n") > one.anomaly_max_versions_per_day, signal("anomaly_version_spike", one.anomaly_version_spike_score, detail=F.concat(F.lit("versions="), F.col("n")))))


def burst_history(publishes: DataFrame) -> DataFrame:
    """M7 at every publish: pkg_id, version, ts, in_day, the versions of the 24 hours up to it."""
    day = Window.partitionBy("pkg_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_399_999_999, 0)
    return publishes.select("pkg_id", "version", "ts", F.count("*").over(day).alias("in_day"))


def license_change(pairs: DataFrame, config) -> DataFrame:
    """M8 over (pkg_id, version, license, previous, previous_license): another licence in a patch release."""
    changed = (F.coalesce("license", F.lit("")) != "") & (F.coalesce("previous_license", F.lit("")) != "") & (F.col("license") != F.col("previous_license"))
    return fired(
        pairs,
        (
            changed & is_patch_bump(F.col("previous"), F.col("version")),
            signal("license_patch_change", config.layer1.license_patch_change_score, detail=F.concat(F.col("previous_license"), F.lit(" -> "), F.col("license"))),
        ),
    )


def metadata_signals(packages: DataFrame, publishes: DataFrame, maintainers: DataFrame, downloads: DataFrame, users: DataFrame, as_of: Column, config) -> DataFrame:
    return union(
        new_package(packages, as_of, config),
        single_maintainer(maintainers, config),
        download_signals(downloads, publishes, as_of, config),
        young_maintainers(maintainers, users, as_of, config),
        version_spike(publishes, as_of, config),
    )
