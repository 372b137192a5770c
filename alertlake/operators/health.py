"""Connection status to health alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.text import non_blank, trim_space
from alertlake.plans.slices import SLICE, KeyWindow
from alertlake.schema import BATCH_FIELDS

# Fixed values.
HEALTH_PREFIX = "monitor.health."
DEGRADED_AT = 3


def failure_runs(status: DataFrame) -> DataFrame:
    """Status rows with ``failures``: how many failures in a row end here or, at a success, ended just before."""
    window = KeyWindow(["host", "component"], ["ts", "seq"])
    failed = F.when(F.col("ok"), 0).otherwise(1)
    counted = window.sum(status, failed, "_failed")
    # The count of failures never falls, so its greatest value at a success is the one at the last success.
    based = window.max(counted, F.when(F.col("ok"), F.col("_failed")), "_base", including=False)
    runs = window.sum(based, F.when(F.col("ok"), 1).otherwise(0), "run_id")
    return runs.withColumn("failures", F.col("_failed") - F.coalesce("_base", F.lit(0))).drop("_failed", "_base", SLICE)


def health_transitions(status: DataFrame) -> DataFrame:
    """ERROR at the third failure in a row, INFO at the first success after three or more."""
    degraded = ~F.col("ok") & (F.col("failures") == DEGRADED_AT)
    recovered = F.col("ok") & (F.col("failures") >= DEGRADED_AT)
    level = F.when(degraded, "ERROR").when(recovered, "INFO")
    return failure_runs(status).withColumn("level", level).where(F.col("level").isNotNull())


def health_batch(at: Column, component: Column, level: Column, message: Column, raw: Column, first_seen: Column | None = None):
    """Columns of a batch that holds one event of the monitor itself."""
    log_id, container = F.concat(F.lit(HEALTH_PREFIX), component), F.concat(F.col("host"), F.lit("/monitor"))
    event = F.struct(
        at.alias("timestamp"),
        F.struct(F.lit(None).cast("string").alias("id"), container.alias("name")).alias("container"),
        F.lit("system").alias("stream"),
        F.upper(trim_space(level)).alias("level"),
        log_id.alias("log_id"),
        F.lit(True).alias("alert_matched"),
        message.alias("message"),
        raw.alias("raw"),
        F.lit(False).alias("parsed_from_json"),
    )
    return [
        F.col("host"),
        log_id.alias("log_id"),
        (at if first_seen is None else first_seen).alias("first_seen"),
        at.alias("last_seen"),
        F.lit(1).alias("count"),
        F.array(container).alias("containers"),
        F.array(event).alias("events"),
        at.alias("flushed_at"),
        F.lit(False).alias("suppress_alert_sinks"),
    ]


def health_batches(transitions: DataFrame) -> DataFrame:
    """One batch per transition."""
    label = F.replace(F.regexp_replace("component", r"\Adocker\.", "docker "), F.lit("_"), F.lit(" "))
    state = F.when(F.col("level") == "ERROR", " entered degraded state").otherwise(" recovered")
    message = F.concat(label, state)
    cause = F.when(F.col("level") == "ERROR", F.concat(F.lit(": "), non_blank(F.col("error"))))
    failures = F.format_string("\nconsecutive_failures=%d", "failures")
    raw = F.concat(message, F.coalesce(cause, F.lit("")), failures)
    return transitions.select(*health_batch(F.col("ts"), F.col("component"), F.col("level"), message, raw)).select(
        *BATCH_FIELDS
    )
