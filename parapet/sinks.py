"""Events and reports (K1 to K4, K7, K8)."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.hashes import hmac_sha256
from parapet.operators.calibrate import COUNTS

EVENT_FIELDS = ("event_type", "timestamp", "package_name", "package_version", "sha256", "verdict", "risk_score", "triggered_rules", "cwe_ids", "response_code", "analysis_duration_ms", "source_ip")


def event_json(events: DataFrame) -> Column:
    """An event as JSON; fields that are null, empty or 0 are left out, but for the first four."""
    shown = []
    for name in EVENT_FIELDS:
        if name not in events.columns:
            continue
        c = F.col(name)
        kind = dict(events.dtypes)[name]
        if name in EVENT_FIELDS[:4]:
            shown.append(c.alias(name))
        elif kind.startswith("array"):
            shown.append(F.when(F.size(c) > 0, c).alias(name))
        elif kind == "string":
            shown.append(F.when(c != "", c).alias(name))
        else:
            shown.append(F.when(c != 0, c).alias(name))
    return F.to_json(F.struct(*shown))


def syslog_lines(events: DataFrame) -> DataFrame:
    """K2: one line an event, priority daemon.warning."""
    return events.select(F.concat(F.lit("<28>"), event_json(events)).alias("value"))


def signed_posts(events: DataFrame, secret: str) -> DataFrame:
    """K3: body and signature header of a webhook call."""
    body = event_json(events)
    return events.select(body.alias("body")).withColumn("signature", F.lit("") if not secret else hmac_sha256(F.col("body"), secret))


def post(url: str, opener: Callable = urllib.request.urlopen, timeout: float = 10) -> Callable[[Iterator], None]:
    """For foreachPartition over signed_posts(): one call a row; a failure fails the task, which is tried again."""

    def send(rows: Iterator) -> None:
        for r in rows:
            head = {"Content-Type": "application/json"} | ({"X-Signature-256": "sha256=" + r["signature"]} if r["signature"] else {})
            opener(urllib.request.Request(url, r["body"].encode(), head), timeout=timeout)

    return send


def fan_out(events: DataFrame, emitters: list[Callable[[DataFrame], None]]) -> None:
    """K1: every emitter gets all events of a batch; none is dropped. K4 (the log) where there is none."""
    held = events.persist()
    try:
        for emit in emitters or [log]:
            emit(held)
    finally:
        held.unpersist()


def log(events: DataFrame) -> None:
    """K4: events as JSON lines on the executors' standard output."""

    def write(rows: Iterator) -> None:
        for r in rows:
            print(r["value"], flush=True)

    log_lines(events).foreachPartition(write)


def log_lines(events: DataFrame) -> DataFrame:
    return events.select(event_json(events).alias("value"))


def trial_table(rated: DataFrame) -> DataFrame:
    """K7: trials (with worth, weights and rates) as text columns: 18 fixed ones, then the weights by name."""
    keys = sorted(r[0] for r in rated.select(F.explode(F.map_keys("weights"))).distinct().collect())  # a search's keys
    four = lambda c: F.format_string("%.4f", F.col(c))
    return rated.select(
        "trial",
        four("worth").alias("score"),
        *[F.format_string("%.3f", F.col(c).cast("double")).alias(c) for c in ("allow", "block")],
        "min_categories",
        *[four(c).alias("val_" + c) for c in ("catch", "block_recall", "block_precision", "hard_fp", "warn_recall", "warn_precision", "soft_fp")],
        *COUNTS,
        *[F.format_string("%.4f", F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(k) for k in keys],
    )


def write_trials(rated: DataFrame, path: str) -> None:
    trial_table(rated).orderBy("trial").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_config(config, weights: dict[str, float], path: str) -> None:
    """K8: the configuration with calibrated weights, as YAML."""
    from parapet.config import dump
    from parapet.rules import apply_weights

    dump(apply_weights(config, weights), path)
