"""Session helpers of the training-data operators: tables, sources and Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import shared
from parapet.shared import HOT, bitmap, bitmap_bits, flagged, met, new_path, rounded, shared_dir  # noqa: F401
from parapet.ship import mapped, ship  # noqa: F401

#: Bytes of an Arrow batch between the JVM and Python, at most: whole batches are held on both sides.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """Bounds Arrow batches by their size (the engine's own bound is by far larger), and sends the sources to executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe if executors go."""
    prepared(df.sparkSession)
    return shared.written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(-1))
