"""Differences between a version and the one before it (V1 to V6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.semver import is_patch_bump, key
from parapet.operators.manifest import HOOKS
from parapet.schema import fired, signal


def with_previous(versions: DataFrame, *carried: str) -> DataFrame:
    """V2 over a history (pkg_id, version, ...): each row with the greatest version strictly below, as previous, and its carried columns as previous_<name>.

    Versions of equal precedence share a predecessor: the order is that of distinct keys. Of equal
    ones the last by text stands for them.
    """
    keyed = versions.withColumn("k", key(F.col("version"))).filter("k IS NOT NULL")
    row = F.struct(F.col("version"), *[F.col(c) for c in carried])
    steps = keyed.groupBy("pkg_id", "k").agg(F.max_by(row, "version").alias("row"))
    before = steps.withColumn("before", F.lag("row").over(Window.partitionBy("pkg_id").orderBy("k"))).select("pkg_id", "k", "before")
    out = keyed.join(before, ["pkg_id", "k"]).drop("k")
    return out.select("*", F.col("before.version").alias("previous"), *[F.col(f"before.{c}").alias(f"previous_{c}") for c in carried]).drop("before")


def resolve_version(name: Column, path: Column, versions: Column, latest: Column) -> Column:
    """V3: struct(resolved, requested): the version of a tarball path if published, else the latest, else unknown."""
    file = F.regexp_extract(path, r"^/(@[^/]+/[^/]+|[^/]+)/-/([^/]+\.tgz)$", 2)
    base = F.concat(F.regexp_replace(name, "^.*/", ""), F.lit("-"))
    stem = F.regexp_replace(file, r"\.tgz$", "")
    requested = F.when(stem.startswith(base), F.substring(stem, F.length(base) + 1, F.length(stem))).otherwise(F.lit(""))
    published = F.coalesce(F.array_contains(versions, requested), F.lit(False)) & (requested != "")
    return F.struct(F.when(published, requested).otherwise(F.coalesce(latest, F.lit("unknown"))).alias("resolved"), requested.alias("requested"))


def _trimmed(scripts: Column, hook: str) -> Column:
    return F.regexp_replace(F.coalesce(scripts[hook], F.lit("")), r"^\s+|\s+$", "")


def script_changes(pairs: DataFrame) -> DataFrame:
    """Patch releases (pkg_id, version, previous, scripts, previous_scripts) whose lifecycle scripts differ in any way."""
    changed = F.lit(False)
    for h in HOOKS:
        changed = changed | (_trimmed(F.col("scripts"), h) != _trimmed(F.col("previous_scripts"), h))
    return pairs.filter(is_patch_bump(F.col("previous"), F.col("version")) & changed)


def script_diff(pairs: DataFrame, config) -> DataFrame:
    """V4: lifecycle scripts added or changed in a patch release. Removal gives no signal, but see script_changes()."""
    three = config.layer3
    now = {h: _trimmed(F.col("scripts"), h) for h in HOOKS}
    was = {h: _trimmed(F.col("previous_scripts"), h) for h in HOOKS}
    added = [((was[h] == "") & (now[h] != ""), signal(f"version_diff_new_script_{h}", three.version_diff_script_added_score, "CWE-506")) for h in HOOKS]
    edited = [((was[h] != "") & (now[h] != "") & (was[h] != now[h]), signal(f"version_diff_changed_script_{h}", three.version_diff_script_changed_score)) for h in HOOKS]
    return fired(script_changes(pairs), *added, *edited)


def dependency_diff(pairs: DataFrame, config) -> DataFrame:
    """V5 over pairs with maps deps, dev_deps and previous_*: new names in a patch release; a name new in both counts twice."""
    three = config.layer3
    empty = F.array().cast("array<string>")
    keys = lambda c: F.coalesce(F.map_keys(c), empty)
    fresh = F.array_sort(F.concat(F.array_except(keys("deps"), keys("previous_deps")), F.array_except(keys("dev_deps"), keys("previous_dev_deps"))))
    bumps = pairs.filter(is_patch_bump(F.col("previous"), F.col("version"))).withColumn("fresh", fresh)
    n = F.size("fresh")
    shown = F.concat(F.lit("new_deps="), F.array_join(F.slice("fresh", 1, 5), ","), F.when(n > 5, F.format_string(" (+%d more)", n - 5)).otherwise(F.lit("")))
    score = F.least(n.cast("decimal(18,9)") * F.lit(str(three.version_diff_new_dep_score)).cast("decimal(18,9)"), F.lit(str(three.version_diff_new_dep_cap)).cast("decimal(18,9)"))
    return fired(bumps, (n > 0, signal("version_diff_new_dependency", score, detail=shown)))


def capability_diff(pairs: DataFrame, config, deep: str = "on_demand") -> DataFrame:
    """V6 over pairs with arrays caps and previous_caps: exec or network new in a patch release.

    on_demand compares only where lifecycle scripts differ, as a scan of both versions is dear;
    always compares all.
    """
    three = config.layer3
    chosen = script_changes(pairs) if deep == "on_demand" else pairs.filter(is_patch_bump(F.col("previous"), F.col("version")))
    fresh = F.array_except("caps", "previous_caps")
    return fired(
        chosen,
        (F.array_contains(fresh, "exec"), signal("version_diff_new_exec_in_patch", three.version_diff_cap_exec_score, "CWE-78")),
        (F.array_contains(fresh, "net_access"), signal("version_diff_new_net_in_patch", three.version_diff_cap_net_score, "CWE-918")),
    )
