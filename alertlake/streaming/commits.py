"""Grouping of a stream commit by commit, for keys of any size.

Keyed state hands all rows of a key to one task. Where a single key may hold much of a commit, the commit can be grouped
as a table instead: the open groups of the last commit are put in front of the new rows and the sliced scan does the
rest. The groups of each commit are stored below the state folder; a commit that is tried again starts from the one
before it and replaces its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.batches import (
    KEYS,
    as_batches,
    group_facts,
    grouped_events,
    is_full,
    mark_batches,
    single_event_batches,
    tick_at,
    with_limits,
)
from alertlake.plans.batch_scan import BUFFER_FACTOR
from alertlake.schema import BATCH_FIELDS
from alertlake.sources.sinks import Sink

# Rows carried over come before the new ones.
ORDER = ["fresh", "ingest_ts", "seq"]
CARRIED = {"dropped": "bigint", "past_containers": "array<string>", "past_last": "timestamp"}


def _commit_path(state: str, commit: int) -> str:
    return f"{state}/commit={commit}"


def _groups_of(spark: SparkSession, state: str, commit: int) -> DataFrame:
    return spark.read.parquet(_commit_path(state, commit))


def last_commit(spark: SparkSession, state: str) -> int:
    """Number of the newest commit of a state folder, -1 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(name[7:]) for name in names if re.fullmatch(r"commit=\d+", name)), default=-1)


def has_ended(spark: SparkSession, state: str, commit: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/ended={commit}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _reopened(groups: DataFrame) -> DataFrame:
    """Rows that the open groups still hold; what is known of the rows they have dropped goes with the first."""
    waiting = groups.where(~F.col("done"))
    rows = waiting.select(*KEYS, "total", "containers", "last_seen", "flush_size", "interval_us", F.posexplode(F.sort_array("buffer")).alias("place", "row"))
    first, room = F.col("place") == 0, F.col("flush_size") * BUFFER_FACTOR
    event, row = F.col("row.event"), F.col("row")
    fields = [event[name].alias(name) for name in ("timestamp", "container", "stream", "level", "alert_matched", "message", "raw", "parsed_from_json")]
    return rows.select(
        *KEYS,
        *fields,
        row["ingest_ts"].alias("ingest_ts"),
        row["seq"].alias("seq"),
        "flush_size",
        "interval_us",
        F.lit(0).alias("fresh"),
        F.when(first, F.greatest(F.col("total") - room, F.lit(0))).otherwise(0).cast("bigint").alias("dropped"),
        F.when(first, F.col("containers")).alias("past_containers"),
        F.when(first, F.col("last_seen")).alias("past_last"),
    )


def group_commit(
    events: DataFrame, commit: int, state: str, flush_size: int | Column, interval: float | Column, heartbeat: int | None = None
) -> DataFrame:
    """Batches that this commit completes. Its open groups stay in the state folder.

    A group with an alert is complete when it is full, or when rows of a later tick have arrived anywhere; ``heartbeat`` says that the
    clock of arrivals has reached this time, in microseconds, without a row. Commits are numbered from 0, as ``foreachBatch`` does; a missing
    predecessor is an error, for its open groups would be lost.
    """
    spark = events.sparkSession
    nothing = {name: F.lit(None).cast(kind) for name, kind in CARRIED.items()} | {"dropped": F.lit(0).cast("bigint")}
    fresh = with_limits(grouped_events(events), flush_size, interval).drop("unknown_log_id")
    rows = fresh.withColumns({"fresh": F.lit(1), **nothing})
    if commit > 0:
        open_ = _groups_of(spark, state, commit - 1)
        if has_ended(spark, state, commit - 1):
            open_ = open_.where("NOT has_alert")
        rows = rows.unionByName(_reopened(open_), allowMissingColumns=True)
    marked = mark_batches(rows, order=ORDER)

    facts = marked.groupBy(*KEYS, "batch_id").agg(
        *group_facts(ORDER),
        F.sum("dropped").alias("dropped"),
        F.any_value("past_containers", True).alias("past_containers"),
        F.max("past_last").alias("past_last"),
    )
    known = F.coalesce("past_containers", F.array().cast("array<string>"))
    groups = facts.withColumns(
        {
            "total": F.col("total") + F.col("dropped"),
            "containers": F.array_sort(F.array_union("containers", known)),
            "last_seen": F.greatest("last_seen", "past_last"),
            # The buffer in order of arrival; ``kept`` sorts by the time of the event.
            "buffer": F.transform("kept", lambda row: F.struct(row["fresh"], row["ingest_ts"], row["seq"], row["event"].alias("event"))),
        }
    )
    # One row: how far the clock of arrivals has come.
    newest = rows.agg(F.unix_micros(F.max("ingest_ts"))).first()[0]
    reached = max((micros for micros in (newest, heartbeat) if micros is not None), default=None)
    later = F.lit(False) if reached is None else F.col("tick") < tick_at(F.timestamp_micros(F.lit(reached)))
    done = is_full() | (F.col("has_alert") & later)
    groups.withColumn("done", done).drop(*CARRIED).write.mode("overwrite").parquet(_commit_path(state, commit))

    stored = _groups_of(spark, state, commit).where("done")
    return as_batches(stored).select(*BATCH_FIELDS, "cause").unionByName(single_event_batches(events))


def final_flush(spark: SparkSession, commit: int, state: str) -> DataFrame:
    """Batches of the groups that hold an alert when the job is shut down after a commit; none if it has ended before."""
    groups = _groups_of(spark, state, commit).where("NOT done AND has_alert")
    if has_ended(spark, state, commit):
        groups = groups.where(F.lit(False))
    return as_batches(groups).select(*BATCH_FIELDS, "cause")


def note_end(spark: SparkSession, commit: int, state: str) -> None:
    """Note that the open groups with an alert have left; a later commit starts without them.

    To be called when the sinks hold what ``final_flush`` returned: a run that fails in between ends once more, and its files
    replace those of the first try.
    """
    spark.range(1).write.mode("overwrite").parquet(f"{state}/ended={commit}")


def grouping_sink(state: str, flush_size: int | Column, interval: float | Column, sink: Sink) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of events: group each commit and hand its batches to a sink.

    Rows whose ``heartbeat`` is true, a column of its own and optional, are no events; their arrival moves the clock.
    """

    def write(events: DataFrame, commit: int) -> None:
        events.persist()
        try:
            beat, lines = None, events
            if "heartbeat" in events.columns:
                beat = events.where("heartbeat").agg(F.unix_micros(F.max("ingest_ts"))).first()[0]
                lines = events.where("NOT heartbeat").drop("heartbeat")
            sink(group_commit(lines, commit, state, flush_size, interval, beat).drop("cause"), commit)
        finally:
            events.unpersist()

    return write
