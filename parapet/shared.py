"""Tables in the folder that a cluster shares, bitmaps of keys, and joins of uneven keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.ship import ship

#: Keys that a join takes as frequent, at most; each has more than one in so many of all rows.
HOT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent and the master is local[...], a temporary folder is set; on a
    cluster without the setting this raises, as a machine-local folder would lose data there.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = held.get() if held.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="parapet-")
        spark.sparkContext.setCheckpointDir(there)
    return there if "://" in there or there.startswith("file:") else f"file://{there}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with what is in it, where it is there."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One text file, by the driver, in any file system that the session knows."""
    files, place = _file_system(spark, path)
    out = files.create(place, True)
    try:
        for part in batched(lines, 1000):
            out.write(bytearray("".join(f"{x}\n" for x in part).encode()))
    finally:
        out.close()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe if executors go."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap_bits(keys: int) -> int:
    """Places of a bitmap for so many keys: 16 a key, a power of 2 from 2 ** 16 to 2 ** 24 (262,144 words of 64 places)."""
    return 1 << min(24, max(16, (16 * keys).bit_length()))


def _place(key: str | Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """word, places: a bitmap with the places of all keys set, of at most bits / 64 rows."""
    at = keys.select(_place(key, bits).alias("at"))
    return at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("places"))


def flagged(df: DataFrame, key: Column, marks: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a column: whether the key's place in a bitmap is set. False is certain; true may be another key's place.

    The bitmap is broadcast: its size is bounded by that of bitmap_bits().
    """
    held = marks.select(F.col("word").alias("__word"), F.col("places").alias("__places"))
    out = df.withColumn("__at", _place(key, bits)).join(F.broadcast(held), F.shiftright(F.col("__at"), 6) == F.col("__word"), "left")
    is_set = F.getbit(F.col("__places"), (F.col("__at") % 64).cast("int")) == 1
    return out.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("__word", "__places", "__at")


def rounded(total: int) -> int:
    """The next power of 2: plans with it have the same compiled code for many totals."""
    return 1 << int(total).bit_length()


def met(big: DataFrame, small: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """The inner join of big with small on key, whatever share of big's rows a key has.

    small has one row a key, with the number of big's rows that have the key in column `count`; total
    is the sum of these, or more. Keys with over one in HOT of all rows (there are at most HOT) are
    broadcast, so that their rows of big stay where they are; the rows of others are dealt by key.
    """
    total = rounded(total)
    hot = small.filter(F.col(count) * HOT > total)
    frequent = big.join(F.broadcast(hot), key)
    others = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.filter(F.col(count) * HOT <= total), key)
    return frequent.unionByName(others)
