"""The signals relation, and how rules make rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE = "decimal(18,9)"
SIGNALS = f"pkg_id string, rule string, score {SCORE}, veto boolean, cwe string, matched string, detail string"


def text(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def signal(rule, score=0.0, cwe="", veto=False, matched="", detail="") -> Column:
    """One row of signals as a struct. Scores are decimals, so that sums do not depend on their order."""
    value = score if isinstance(score, Column) else F.lit(str(score))
    return F.struct(
        text(rule).alias("rule"),
        value.cast(SCORE).alias("score"),
        F.lit(veto).alias("veto"),
        text(cwe).alias("cwe"),
        F.coalesce(text(matched), F.lit("")).alias("matched"),
        F.coalesce(text(detail), F.lit("")).alias("detail"),
    )


def fired(df: DataFrame, *rules: tuple[Column, Column], key: str = "pkg_id") -> DataFrame:
    """Signals of all (condition, signal) pairs that hold, in one pass over df."""
    found = F.filter(F.array(*[F.when(when, what) for when, what in rules]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("pkg_id"), F.explode(found).alias("s")).select("pkg_id", "s.*")


def union(*parts: DataFrame) -> DataFrame:
    """The layers' signals as one bag."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def no_signals(spark) -> DataFrame:
    return spark.createDataFrame([], SIGNALS)
