"""Replay windows: after a long gap a stream delivers old lines, and their alerts must not notify anyone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.times import duration_text
from alertlake.operators.health import health_batch
from alertlake.plans.slices import SLICE, KeyWindow, checkpointed, time_slice
from alertlake.schema import BATCH_FIELDS

# Fixed values.
REALTIME_SLACK = 30
CAUGHT_UP = "log stream caught up to realtime"
TIMED_OUT = "backfill max duration reached"
STOPPED = "watcher stream stopped"
BUCKET_SECONDS = 3600


def _micros(seconds: float | Column) -> Column:
    return (seconds * 1_000_000).cast("bigint") if isinstance(seconds, Column) else F.lit(int(seconds * 1_000_000))


def _after(ts, seconds: float | Column):
    return F.timestamp_micros(F.unix_micros(ts) + _micros(seconds))


def _bucket(ts: Column, width: Column) -> Column:
    return F.floor(F.unix_micros(ts) / _micros(width)).cast("bigint")


def backfill_windows(raw: DataFrame, threshold: float | Column, max_duration: float | Column) -> DataFrame:
    """Replay windows of each container stream.

    Both limits are seconds, as numbers or as expressions that depend on ``host``; 0 is no window, or no longest duration.


    A window opens when a stream that was silent for ``threshold`` seconds delivers again and begins with an old line, one
    written more than 30 s before it arrives; a container that had nothing to say opens none. The window ends with the
    first line written no more than 30 s before its start, or ``max_duration`` later, or with the input.
    """
    stream = ["host", "container"]
    lines = raw.select("host", F.col("container.name").alias("container"), "timestamp", "ingest_ts")
    threshold, max_duration = (limit if isinstance(limit, Column) else F.lit(float(limit)) for limit in (threshold, max_duration))
    lines = lines.withColumn("width", F.when(threshold > 0, threshold).otherwise(1.0))
    lines = lines.withColumn("bucket", _bucket(F.col("ingest_ts"), F.col("width")))
    # Rows less than a threshold apart share a bucket or lie in adjoining ones, so first and last row of each bucket
    # show every gap: no window needs the rows themselves.
    buckets = lines.groupBy(*stream, "width", "bucket").agg(
        F.min("ingest_ts").alias("first_row"),
        F.max("ingest_ts").alias("last_row"),
        F.min_by("timestamp", F.struct("ingest_ts", "timestamp")).alias("first_written"),
    )
    buckets = checkpointed(buckets)
    in_order = Window.partitionBy(*stream).orderBy("bucket")
    gap = (F.unix_micros("first_row") - F.unix_micros(F.lag("last_row").over(in_order))) / 1e6
    late = F.col("first_written") < _after("first_row", -REALTIME_SLACK)
    opened = buckets.withColumn("disconnected_for", gap).where(late & (F.col("disconnected_for") >= threshold) & (threshold > 0))
    input_end = buckets.groupBy("host").agg(F.max("last_row").alias("input_end"))
    timer = F.when(max_duration > 0, _after("first_row", max_duration))
    windows = (
        opened.withColumn("next_start", F.lead("first_row").over(in_order))
        .join(input_end, "host")
        .withColumns({"start_ts": F.col("first_row"), "timer": timer})
        .withColumn("limit", F.least("timer", "input_end"))
        .drop("bucket", "first_row", "last_row", "first_written")
    )

    watched = F.least("limit", "next_start")
    spans = windows.select(
        *stream,
        "start_ts",
        "next_start",
        F.explode(F.sequence(_bucket(F.col("start_ts"), F.col("width")), _bucket(watched, F.col("width")))).alias("bucket"),
    )
    fresh = (F.col("timestamp") >= _after("start_ts", -REALTIME_SLACK)) & (F.col("ingest_ts") >= F.col("start_ts"))
    mine = F.col("next_start").isNull() | (F.col("ingest_ts") < F.col("next_start"))
    caught = (
        lines.join(spans, [*stream, "bucket"])
        .where(fresh & mine)
        .groupBy(*stream, "start_ts")
        .agg(F.min("ingest_ts").alias("caught_up"))
    )
    in_time = F.col("caught_up") <= F.col("limit")
    return windows.join(caught, [*stream, "start_ts"], "left").select(
        *stream,
        "start_ts",
        F.when(in_time, F.col("caught_up")).otherwise(F.col("limit")).alias("end_ts"),
        "disconnected_for",
        F.when(in_time, CAUGHT_UP)
        .when(F.col("timer") <= F.col("input_end"), TIMED_OUT)
        .otherwise(STOPPED)
        .alias("reason"),
    )


def merge_windows(windows: DataFrame) -> DataFrame:
    """Windows of a host: it is in replay while any of its streams is."""
    by_host = KeyWindow(["host"], ["start_ts", "container"])
    reached = by_host.max(windows, F.col("end_ts"), "reached", including=False)
    fresh = F.when(F.col("reached").isNull() | (F.col("start_ts") >= F.col("reached")), 1).otherwise(0)
    islands = by_host.sum(reached, fresh, "island")
    return (
        islands.groupBy("host", "island")
        .agg(
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
            F.max("disconnected_for").alias("disconnected_for"),
            F.max_by("reason", F.struct("end_ts", "start_ts", "container")).alias("reason"),
        )
        .drop("island")
    )


def _bucketed(merged: DataFrame) -> DataFrame:
    first, last = (time_slice(F.col(name), BUCKET_SECONDS) for name in ("start_ts", "end_ts"))
    return merged.withColumn("bucket", F.explode(F.sequence(first, last)))


def mark_suppressed(batches: DataFrame, merged: DataFrame) -> DataFrame:
    """Set ``suppress_alert_sinks`` on batches emitted while their host is in replay."""
    lasting = merged.where("start_ts < end_ts")
    spans = _bucketed(lasting).groupBy("host", "bucket").agg(F.collect_list(F.struct("start_ts", "end_ts")).alias("spans"))
    emitted = F.col("flushed_at")
    inside = F.exists("spans", lambda span: (emitted >= span["start_ts"]) & (emitted < span["end_ts"]))
    placed = batches.withColumn("bucket", time_slice(emitted, BUCKET_SECONDS))
    return (
        placed.join(spans, ["host", "bucket"], "left")
        .withColumn("suppress_alert_sinks", F.col("suppress_alert_sinks") | F.coalesce(inside, F.lit(False)))
        .select(*batches.columns)
    )


def replayed_alerts(events: DataFrame, merged: DataFrame) -> DataFrame:
    """Windows with ``alerts``: how many alert events arrived in each."""
    alerts = events.where("alert_matched").select(
        "host", "ingest_ts", time_slice(F.col("ingest_ts"), BUCKET_SECONDS).alias("bucket")
    )
    arrived = (F.col("ingest_ts") >= F.col("start_ts")) & (F.col("ingest_ts") < F.col("end_ts"))
    counts = (
        alerts.join(_bucketed(merged), ["host", "bucket"])
        .where(arrived)
        .groupBy("host", "start_ts", "end_ts")
        .agg(F.count("*").alias("alerts"))
    )
    return merged.join(counts, ["host", "start_ts", "end_ts"], "left").fillna(0, ["alerts"])


def backfill_summary(events: DataFrame, merged: DataFrame) -> DataFrame:
    """One warning batch per window that lasts: how long the host was offline and how much was replayed."""
    stamp = "yyyy-MM-dd'T'HH:mm:ssXXX"
    offline = duration_text(F.round("disconnected_for").cast("bigint"))
    message = F.concat(
        F.lit("docker log backfill completed: previously offline for "),
        offline,
        F.lit(", replayed "),
        F.col("alerts").cast("string"),
        F.lit(" matching events (see persisted log file)"),
    )
    raw = F.concat_ws(
        "\n",
        message,
        F.concat(F.lit("backfill_started_at="), F.date_format("start_ts", stamp)),
        F.concat(F.lit("backfill_ended_at="), F.date_format("end_ts", stamp)),
        F.concat(F.lit("offline_duration="), offline),
        F.concat(F.lit("replayed_alert_count="), F.col("alerts").cast("string")),
        F.concat(F.lit("end_reason="), F.col("reason")),
    )
    rows = replayed_alerts(events, merged.where("start_ts < end_ts"))
    columns = health_batch(F.col("end_ts"), F.lit("docker.log_backfill"), F.lit("WARN"), message, raw, F.col("start_ts"))
    return rows.select(*columns).select(*BATCH_FIELDS)
