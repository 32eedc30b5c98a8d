"""Line lists and labelled corpora (S10 to S12), and what is written of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.shared import exists, write_lines

LABELS = "name string, version string, prev_version string, tarball string, meta string, osv_vulnerable boolean, source string, category string"
SPLITS = ("benign", "malicious")


def cleaned(lines: DataFrame) -> DataFrame:
    """S10 over lines (position, value): position, name; trimmed, without blank lines and comments."""
    return lines.select("position", F.regexp_replace("value", r"^\s+|\s+$", "").alias("name")).filter("name <> '' AND NOT startswith(name, '#')")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines with a number that grows with their place."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), "value")


def package_list(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct names in the order of the file."""
    return cleaned(lines).groupBy("name").agg(F.min("position").alias("position")).orderBy("position").limit(most)


def corpus(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Labels.jsonl of each split that is there, with the split's name as label.

    A row without name, version or archive, or a corpus without rows, is an error.
    """
    parts = []
    for split in splits:
        path = f"{root.rstrip('/')}/{split}/labels.jsonl"
        if exists(spark, path):
            parts.append(spark.read.schema(LABELS).option("mode", "FAILFAST").json(path).withColumn("label", F.lit(split)))
    if not parts:
        raise ValueError(f"no split in {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    missing = F.coalesce("name", F.lit("")) == ""
    for c in ("version", "tarball"):
        missing = missing | (F.coalesce(c, F.lit("")) == "")
    counts = out.agg(F.count("*").alias("n"), F.count_if(missing).alias("bad")).first()
    if counts["bad"] or not counts["n"]:
        raise ValueError(f"{counts['bad']} of {counts['n']} rows of {root} lack a name, version or tarball")
    return out


def append_labels(rows: DataFrame, path: str) -> None:
    """K10."""
    rows.write.mode("append").json(path)


def write_names(names: DataFrame, path: str, header: list[str]) -> None:
    """K9: a list of names below comment lines, in one file: a list is for people to read."""
    write_lines(names.sparkSession, path, chain((f"# {h}" for h in header), (r["name"] for r in names.select("name").toLocalIterator())))
