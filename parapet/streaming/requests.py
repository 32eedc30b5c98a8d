"""The online side as Structured Streaming: request events in, verdict events out, rechecks by trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parapet.operators import cache
from parapet.plans import scoring
from parapet.shared import exists, remove
from parapet.sources import archives

REQUESTS = "method string, path string, sha256 string, source_ip string, at timestamp"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of request rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(REQUESTS).json(path)


def looked_up(asked: DataFrame, entries: DataFrame, ttl_hours: float) -> DataFrame:
    """R2 on a stream: requests (sha256, at, ...) with the last entry of their archive, null where it ended before the request.

    Only entries of archives that are asked for are looked through.
    """
    wanted = entries.join(asked.select("sha256").distinct(), "sha256", "left_semi")
    held = cache.put(cache.latest(wanted), ttl_hours).drop("analyzed_at").withColumnRenamed("sha256", "held_sha256")
    meets = (F.col("sha256") == F.col("held_sha256")) & (F.col("expires_at") > F.col("at"))
    return asked.join(held, meets, "left").drop("held_sha256", "expires_at")


def archive_scorer(fetch: Callable[[DataFrame], DataFrame], config, first: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer for serve(): archives (pkg_id = sha256, content) that `fetch` finds for requests, unpacked and decided.

    first: signals of names and metadata (pkg_id = sha256) of the same requests. An archive that cannot be
    unpacked gets no verdict, which serve() refuses.
    """

    def score(missed: DataFrame) -> DataFrame:
        sound = archives.files(fetch(missed), config.extractor).filter("error IS NULL")
        _, decisions = scoring.score_files(scoring.settled(sound), config, first=first(missed) if first else None)
        return decisions.select(F.col("pkg_id").alias("sha256"), "verdict", F.col("score").cast("double").alias("score"), "rules")

    return score


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df as a table that a batch that is run again finds as it was."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def serve(
    stream: DataFrame,
    verdicts: Callable[[SparkSession], DataFrame],
    emit: Callable[[DataFrame], None],
    checkpoint: str,
    ttl_hours: float = 24,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    store: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """For each micro-batch: archive requests, looked up in the verdict table as it is now, as events.

    The table is read anew each time, so what other writers append is seen; requests that are not
    for an archive pass through without an event. scorer: of archives that have no live entry (one row
    each, with the last request) to (sha256, verdict, score, rules); the verdicts are appended to the
    table (store) and answered: 200, or 403 for a block and for what got no verdict. Without a scorer
    such requests come out without a verdict. A batch that is run again answers as it did at first; its
    entries may then be in the table twice, of which lookups take one. interval: go on for ever, with a
    batch each such time, instead of ending with what is there.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        entries = verdicts(spark)
        asked = looked_up(cache.routed(df).filter("is_archive"), entries, ttl_hours)
        code = F.when(F.col("verdict").isNotNull(), F.lit(200))
        if scorer is None:
            emit(asked.withColumn("response_code", code))
            return
        # what was found is fixed before the table changes
        asked = _kept(asked, f"{checkpoint}-answers/{n}/asked")
        missed = asked.filter("verdict IS NULL")
        own = [c for c in asked.columns if c not in entries.columns or c == "sha256"]
        last = F.max_by(F.struct(*[c for c in own if c != "sha256"]), "at").alias("r")
        each = missed.groupBy("sha256").agg(last).select("sha256", "r.*")
        fresh = scorer(each).join(each.select("sha256", F.col("at").alias("analyzed_at")), "sha256")
        kinds = dict(entries.dtypes)
        fresh = _kept(fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in entries.columns]), f"{checkpoint}-answers/{n}/fresh")
        fresh.write.mode("append").parquet(store)
        answered = missed.select(*own).join(fresh.drop("analyzed_at"), "sha256", "left")
        refused = F.coalesce(F.col("verdict") == "block", F.lit(True))
        hits = asked.filter("verdict IS NOT NULL").withColumn("response_code", code)
        emit(hits.unionByName(answered.withColumn("response_code", F.when(refused, 403).otherwise(200)), allowMissingColumns=True))
        remove(spark, f"{checkpoint}-answers/{n - 1}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def bursts(publishes: DataFrame, most: int, late: str = "1 hour") -> DataFrame:
    """M7 as a stream of publishes (pkg_id, version, ts): sliding days with more than `most` versions."""
    days = publishes.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour").alias("day"), "pkg_id").agg(F.count("*").alias("versions"))
    return days.filter(F.col("versions") > most).select("pkg_id", F.col("day.start").alias("day_start"), "versions")


def rechecks(ticks: DataFrame, recheck: Callable[[SparkSession], DataFrame], store: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """At every tick (or interval) a recheck, whose upgrades are appended to the verdict table."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            recheck(df.sparkSession).write.mode("append").parquet(store)

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
