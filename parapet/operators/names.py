"""Layer 1, names: look-alikes of popular packages and scopes, and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions.strings import deletions, normalise, osa, osa_within_two, scope_of, strip_scope, unmask, within
from parapet.schema import fired, signal
from parapet.shared import bitmap, flagged


def reference(lines: DataFrame) -> DataFrame:
    """Distinct bare names of a popularity list (column name)."""
    return lines.select(strip_scope(normalise(F.col("name"))).alias("popular")).filter("popular <> ''").distinct()


def popular_scopes(lines: DataFrame, least: int = 3) -> DataFrame:
    """Scopes with `least` lines or more, repeats counted."""
    return lines.select(scope_of(normalise(F.col("name"))).alias("scope")).filter("scope IS NOT NULL").groupBy("scope").count().filter(F.col("count") >= least).select("scope")


def named(packages: DataFrame) -> DataFrame:
    """pkg_id, full and bare name of packages (pkg_id, name)."""
    return packages.select(F.col("pkg_id").cast("string").alias("pkg_id"), normalise(F.col("name")).alias("full")).withColumn("bare", strip_scope(F.col("full")))


def not_popular(names: DataFrame, popular: DataFrame) -> DataFrame:
    """T4: names that are popular themselves get no further name rule."""
    return names.join(popular, F.col("bare") == F.col("popular"), "left_anti")


def homoglyphs(names: DataFrame, popular: DataFrame) -> DataFrame:
    """T5: names that become a popular one when look-alike characters are read as meant: pkg_id, bare, matched."""
    return names.withColumn("matched", unmask(F.col("bare"))).filter("matched <> bare").join(popular, F.col("matched") == F.col("popular")).select("pkg_id", "bare", "matched")


def combosquats(names: DataFrame, popular: DataFrame, least: int = 4) -> DataFrame:
    """Of names of two or more segments the first segment of `least` bytes that is popular: pkg_id, bare, matched."""
    parts = names.withColumn("parts", F.filter(F.split("bare", "[-_.]"), lambda x: x != "")).filter(F.size("parts") >= 2)
    each = parts.select("pkg_id", "bare", F.posexplode("parts").alias("at", "part")).filter(F.octet_length("part") >= least)
    return each.join(popular, F.col("part") == F.col("popular")).groupBy("pkg_id", "bare").agg(F.min_by("part", "at").alias("matched"))


#: Places of the bitmap of what is left of popular names.
BITS = 1 << 24


def _left_alike(probes: DataFrame, known: DataFrame, own: str, most: int) -> DataFrame:
    """Pairs (own, popular), some more than once, that share a string left when up to `most` characters of each are deleted.

    An equi-join of these strings, which partitions by hash whatever the size of either side. A bitmap
    of those of popular names, of a fixed size, leaves out most others where they are made.
    """
    right = known.withColumn("left", F.explode(deletions(F.col("popular"), most)))
    left = flagged(probes.withColumn("left", F.explode(deletions(F.col(own), most))), F.col("left"), bitmap(right, "left", BITS), BITS, "may").filter("may").drop("may")
    return left.join(right, "left").select(own, "popular")


def neighbours(names: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """The nearest popular name within edit distance `most`: pkg_id, bare, d, matched. d is the optimal string alignment distance; ties go to the first name."""
    pairs = _left_alike(names.select("bare").distinct(), popular.select("popular"), "bare", most)
    d = osa_within_two(F.col("bare"), F.col("popular")) if most <= 2 else F.expr(osa("bare", "popular"))
    near = pairs.filter((F.col("bare") != F.col("popular")) & within(F.col("bare"), F.col("popular"), most)).withColumn("d", d)
    best = near.groupBy("bare").agg(F.min(F.struct("d", "popular")).alias("best")).select("bare", F.col("best.d").alias("d"), F.col("best.popular").alias("matched"))
    return names.select("pkg_id", "bare").join(best, "bare").select("pkg_id", "bare", "d", "matched")


def near_scopes(names: DataFrame, scopes: DataFrame, most: int = 2) -> DataFrame:
    """The nearest popular scope by optimal string alignment: pkg_id, scope, d, matched. A swap of neighbours, too, leaves the same string when one of them is deleted."""
    own = names.withColumn("scope", scope_of(F.col("full"))).filter("length(scope) >= 3")
    probes = own.select("scope").distinct().join(scopes, "scope", "left_anti")
    pairs = _left_alike(probes, scopes.select(F.col("scope").alias("popular")), "scope", most)
    band = F.abs(F.octet_length("scope") - F.octet_length("popular")) <= most
    near = pairs.filter(band).withColumn("d", F.expr(osa("scope", "popular"))).filter(F.col("d") <= most)
    best = near.groupBy("scope").agg(F.min(F.struct("d", "popular")).alias("best")).select("scope", F.col("best.d").alias("d"), F.col("best.popular").alias("matched"))
    return own.select("pkg_id", "scope").join(best, "scope").select("pkg_id", "scope", "d", "matched")


def name_signals(packages: DataFrame, lines: DataFrame, config) -> DataFrame:
    """All name rules. A homoglyph ends the search; combosquat and distance may both fire; scopes are apart."""
    one = config.layer1
    names = named(packages)
    popular = reference(lines)
    rest = not_popular(names, popular)
    masked = homoglyphs(rest, popular)
    plain = rest.join(masked.select("pkg_id"), "pkg_id", "left_anti")
    parts = [fired(masked, (F.lit(True), signal("typosquat_ascii_homoglyph", one.typosquat_ascii_homoglyph_score, matched=F.col("matched"))))]
    if one.typosquat_combosquat_score > 0:
        parts.append(fired(combosquats(plain, popular, one.typosquat_combosquat_min_len), (F.lit(True), signal("typosquat_combosquat", one.typosquat_combosquat_score, matched=F.col("matched")))))
    close = F.col("d") <= one.typosquat_close_distance
    detail = F.concat(F.lit("distance="), F.col("d"))
    parts.append(
        fired(
            neighbours(plain, popular, one.typosquat_warn_distance),
            (close, signal("typosquat_close", one.typosquat_close_score, matched=F.col("matched"), detail=detail)),
            (~close, signal("typosquat_warn", one.typosquat_warn_score, matched=F.col("matched"), detail=detail)),
        )
    )
    parts.append(
        fired(
            near_scopes(names, popular_scopes(lines, one.typosquat_scope_min_packages), one.typosquat_warn_distance),
            (close & F.lit(one.typosquat_scope_close_score > 0), signal("typosquat_scope_close", one.typosquat_scope_close_score, matched=F.col("matched"), detail=detail)),
            (~close & F.lit(one.typosquat_scope_warn_score > 0), signal("typosquat_scope_warn", one.typosquat_scope_warn_score, matched=F.col("matched"), detail=detail)),
        )
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advisory_signals(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """A veto for packages (pkg_id, name, version) with an advisory (name, version)."""
    hit = packages.join(advisories.select("name", "version"), ["name", "version"], "left_semi")
    return fired(hit, (F.lit(True), signal("osv_known_vulnerability", cwe="CWE-1035", veto=True)))
