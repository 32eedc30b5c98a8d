"""Semantic versions as sortable structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"


def key(version: Column) -> Column:
    """Precedence of a version as a struct that sorts: numbers, then no prerelease after any, then its identifiers.

    Missing minor and patch count as 0; build metadata does not count; null if it is no version.
    """
    part = lambda k: F.regexp_extract(version, PATTERN, k)
    number = lambda k: F.coalesce(part(k).try_cast("long"), F.lit(0).cast("long"))
    pieces = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), r"\."))
    ranked = F.transform(
        pieces,
        lambda p: F.struct(
            (~p.rlike("^[0-9]+$")).alias("alpha"),
            F.when(p.rlike("^[0-9]+$"), p.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"),
            F.when(p.rlike("^[0-9]+$"), F.lit("")).otherwise(p).alias("str"),
        ),
    )
    return F.when(
        version.rlike(PATTERN),
        F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").alias("stable"), ranked.alias("pre")),
    )


def is_patch_bump(previous: Column, current: Column) -> Column:
    """V1: same major and minor, patch one higher; a prerelease does not count; no version is no bump."""
    p, c = key(previous), key(current)
    return F.coalesce((p["major"] == c["major"]) & (p["minor"] == c["minor"]) & (c["patch"] == p["patch"] + 1), F.lit(False))


def previous_of(versions: Column, current: Column) -> Column:
    """V2: of an array of versions the greatest strictly below current, as it was written; of equals the last by text."""
    mine = key(current)
    pairs = F.transform(versions, lambda v: F.struct(key(v).alias("key"), v.alias("version")))
    return F.array_max(F.filter(pairs, lambda x: x["key"].isNotNull() & (x["key"] < mine)))["version"]
