"""Combining signals: cross-layer rules, aggregates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import rules
from parapet.schema import SCORE, signal



def flags(rule: Column) -> dict[str, Column]:
    """What a rule says of its package, by its name."""
    return {
        "typosquat": rule.startswith("typosquat_"),
        "install": rule.startswith("install_script_"),
        "exec": rule.isin("capability_exec", "cap_exec") | rule.startswith("install_script_child_process_") | rule.startswith("install_script_node_eval_"),
        "network": rule.startswith("install_script_external_url_"),
        "obfuscation": rule.isin("obfuscation_high_entropy", "entropy_obfuscation", "sink_with_obfuscation"),
    }


def combo_signals(signals: DataFrame, config) -> DataFrame:
    """Signals for pairs of findings; none where its score is 0, or where the package has it already."""
    combo = config.combo
    seen = signals.groupBy("pkg_id").agg(*[F.bool_or(c).alias(n) for n, c in flags(F.col("rule")).items()], *[F.bool_or(F.col("rule") == r).alias(f"has_{r}") for r in rules.COMBOS])
    needs = {
        "typosquat_with_install_script": F.col("typosquat") & F.col("install"),
        "install_script_with_exec": F.col("install") & F.col("exec"),
        "install_script_with_network": F.col("install") & F.col("network"),
        "install_script_with_obfuscation": F.col("install") & F.col("obfuscation"),
    }
    found = F.filter(
        F.array(
            *[
                F.when(needs[r] & ~F.col(f"has_{r}") & F.lit(getattr(combo, r + "_score") > 0), signal(r, getattr(combo, r + "_score"), "CWE-506"))
                for r in rules.COMBOS
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return seen.select("pkg_id", F.explode(found).alias("s")).select("pkg_id", "s.*")


def with_combos(signals: DataFrame, config) -> DataFrame:
    return signals.unionByName(combo_signals(signals, config))


def aggregates(signals: DataFrame) -> DataFrame:
    """Of each package veto, score (capped at 1), rules, CWEs, categories, the first vetoing rule."""
    return signals.groupBy("pkg_id").agg(
        F.bool_or("veto").alias("veto"),
        F.least(F.lit("1").cast(SCORE), F.sum("score").cast(SCORE)).alias("score"),
        F.array_sort(F.collect_list("rule")).alias("rules"),
        F.array_sort(F.collect_set(F.when(F.col("cwe") != "", F.col("cwe")))).alias("cwes"),
        F.count_distinct(rules.category(F.col("rule"))).alias("categories"),
        F.min(F.when(F.col("veto"), F.col("rule"))).alias("veto_rule"),
    )


def verdict(veto: Column, score: Column, categories: Column, allow: Column, block: Column, least: Column) -> Column:
    """P10: vetoes and scores from block on are blocked; scores from allow on warn if enough categories agree."""
    return (
        F.when(veto, F.lit("block"))
        .when(score >= block, F.lit("block"))
        .when(score < allow, F.lit("allow"))
        .when((least > 1) & (categories < least), F.lit("allow"))
        .otherwise(F.lit("warn"))
    )


def decide(packages: DataFrame, signals: DataFrame, config) -> DataFrame:
    """P10 for every package (pkg_id), also those without signals."""
    p = config.policy
    limit = lambda x: F.lit(str(x)).cast(SCORE)
    empty = F.array().cast("array<string>")
    agg = packages.select(F.col("pkg_id").cast("string").alias("pkg_id")).distinct().join(aggregates(signals), "pkg_id", "left")
    agg = agg.select(
        "pkg_id",
        F.coalesce("veto", F.lit(False)).alias("veto"),
        F.coalesce("score", limit(0)).alias("score"),
        F.coalesce("rules", empty).alias("rules"),
        F.coalesce("cwes", empty).alias("cwes"),
        F.coalesce("categories", F.lit(0).cast("long")).alias("categories"),
        F.coalesce("veto_rule", F.lit("")).alias("veto_rule"),
    )
    out = agg.withColumn("verdict", verdict(F.col("veto"), F.col("score"), F.col("categories"), limit(p.allow_threshold), limit(p.block_threshold), F.lit(p.min_categories)))
    score = F.when(F.col("veto"), limit(1)).otherwise(F.col("score"))
    header = F.when(F.size("rules") == 0, F.format_string("score=%.2f", score.cast("double"))).otherwise(F.format_string("score=%.2f rules=[%s]", score.cast("double"), F.array_join("rules", " ")))
    return out.select(
        "pkg_id",
        "verdict",
        score.alias("score"),
        F.array_join("rules", ",").alias("rules"),
        F.array_join("cwes", ",").alias("cwes"),
        "categories",
        "veto_rule",
        F.when(F.col("verdict") == "block", F.lit(403)).otherwise(F.lit(200)).alias("http_status"),
        F.when(F.col("verdict") == "warn", header).otherwise(F.lit("")).alias("warning_header"),
    )


def not_blocked(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of df (pkg_id) of packages that a first decision did not block; only these are downloaded."""
    return df.join(decisions.filter("verdict = 'block'").select("pkg_id"), "pkg_id", "left_anti")
