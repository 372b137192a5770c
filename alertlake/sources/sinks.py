"""Sinks: stored batches, the outbox of notifications, and how they combine in a stream."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.notify import is_health, notifications, rejected, send_schedule
from alertlake.plans.slices import checkpointed
from alertlake.schema import BATCH_FIELDS
from alertlake.settings import HostSettings
from alertlake.sources.commits import MERGED, NOTES, commit_of, commit_place, drop_hidden, merged_up_to, names_in, note_commit
from alertlake.sources.readers import read_stored_batches

log = logging.getLogger("alertlake")

TIME_FORM = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# A sink takes the batches of one commit and its number.
Sink = Callable[[DataFrame, int], None]


def with_day(batches: DataFrame) -> DataFrame:
    """Where a batch is filed: month and day in UTC of its last event or else its end, health batches apart."""
    known = [name for name in ("last_seen", "flushed_at") if name in batches.columns]
    at = F.coalesce(*known, F.current_timestamp())
    utc = F.convert_timezone(None, F.lit("UTC"), at)
    return batches.withColumns(
        {
            "month": F.date_format(utc, "yyyy-MM"),
            "day": F.date_format(utc, "yyyy-MM-dd"),
            "kind": F.when(is_health(F.col("log_id")), "health").otherwise("alert"),
        }
    )


def _stored(rows: DataFrame, commit: int | None):
    """A writer that replaces what an earlier try of the same commit has left, or without a commit adds to what is there."""
    named = rows.withColumn("commit", F.lit(-1 if commit is None else commit))
    writer = named.write.mode("append" if commit is None else "overwrite")
    return writer if commit is None else writer.option("partitionOverwriteMode", "dynamic")


def write_batches(batches: DataFrame, path: str, commit: int | None = None) -> None:
    """Store batches as JSON lines under month, day and kind.

    Files of a numbered commit replace what an earlier try of that commit has left, and nothing else; the commit is noted
    when they are whole, and readers pass over it before that. Without a number the batches are added. Rebalancing brings
    the rows of a folder together, so that there are few files, and splits a busy day among several tasks.
    """
    stored_files(batches, path, commit)
    if commit is not None:
        note_commit(batches.sparkSession, path, f"commit={commit}")


def stored_files(batches: DataFrame, path: str, commit: int | None = None) -> None:
    """The files of a commit, which readers do not see before it is noted."""
    filed = with_day(batches.select(*[c for c in BATCH_FIELDS if c in batches.columns]))
    muted = F.when(F.col("suppress_alert_sinks"), True)
    placed = filed.withColumn("suppress_alert_sinks", muted).hint("rebalance", "month", "day", "kind")
    _stored(placed, commit).option("timestampFormat", TIME_FORM).partitionBy("month", "day", "kind", "commit").json(path)


def merge_commits(spark: SparkSession, path: str, upto: int) -> int:
    """Merge the stored batches of all commits up to a number into one, to be run when none of them is tried again.

    Returns the number of folders that are no longer needed and were deleted.
    """
    before = merged_up_to(names_in(spark, f"{path.rstrip('/')}/{NOTES}"))
    if before is None or before < upto:
        commit = commit_of(F.col("file"))
        old = read_stored_batches(spark, path).where((commit >= MERGED) | ((commit != -1) & (place_of(commit) <= 2 * upto + 1)))
        write_batches(checkpointed(old), path, MERGED + upto)
        note_commit(spark, path, f"merged={upto}")
    return drop_hidden(spark, path, upto)


def place_of(commit: Column) -> Column:
    """``commit_place`` of a column."""
    return F.when(commit >= 0, 2 * commit).otherwise(2 * (-2 - commit) + 1)


def file_sink(path: str, hosts: list[str] | None = None) -> Sink:
    """Stored batches of all hosts, or of some."""

    def write(batches: DataFrame, commit: int | None = None) -> None:
        write_batches(batches if hosts is None else batches.where(F.col("host").isin(hosts)), path, commit)

    return write


def last_slots(spark: SparkSession, path: str, place: int) -> DataFrame | None:
    """(webhook, send_at) of the newest message of every queue before a place, None at the first one."""
    names = names_in(spark, path)
    earlier = [int(name[6:]) for name in names if re.fullmatch(r"place=\d+", name) and int(name[6:]) < place]
    return spark.read.parquet(f"{path}/place={max(earlier)}") if earlier else None


def outbox_sink(path: str, settings: HostSettings, zone: str | None = None) -> Sink:
    """Notification rows of each commit with their ``send_at``, for a sender outside of Spark.

    A queue goes on over commits: the last slot of every webhook is kept beside the outbox, and the messages of the next commit take
    the slots after it. A commit that is tried again goes on from the same slots. Messages that do not fit go to
    ``rejected`` beside the outbox and take no slot.
    """
    slots, refused = f"{path.rstrip('/')}-slots", f"{path.rstrip('/')}-rejected"

    def write(batches: DataFrame, commit: int | None = None) -> None:
        messages = checkpointed(notifications(batches, settings, zone))
        _stored(rejected(messages), commit).partitionBy("commit").parquet(refused)
        queue = messages.where("payload IS NOT NULL").withColumn("carried", F.lit(False))
        before = None if commit is None else last_slots(batches.sparkSession, slots, commit_place(commit))
        if before is not None:
            # The slot taken last, as a message that has arrived then.
            first = before.select("webhook", F.col("send_at").alias("after"), F.lit(True).alias("carried"))
            queue = queue.withColumn("after", F.lit(None).cast("timestamp")).unionByName(first, allowMissingColumns=True)
            queue = queue.withColumn("asked", F.coalesce("after", "arrival")).drop("after")
        else:
            queue = queue.withColumn("asked", F.col("arrival"))
        order = ["ahead", "asked", "host", "log_id", "first_seen", "part"]
        placed = checkpointed(send_schedule(queue.withColumn("ahead", F.when(F.col("carried"), 0).otherwise(1)), ["webhook"], order, arrival="asked"))
        sent = placed.where("NOT carried").drop("carried", "asked", "ahead", "place")
        _stored(sent, commit).partitionBy("commit").parquet(path)
        if commit is not None:
            newest = placed.groupBy("webhook").agg(F.max("send_at").alias("send_at"))
            newest.write.mode("overwrite").parquet(f"{slots}/place={commit_place(commit)}")

    return write


def best_effort(name: str, sink: Sink) -> Sink:
    """A sink that can fail without harm: the failure is logged and goes no further."""

    def write(batches: DataFrame, commit: int) -> None:
        try:
            sink(batches, commit)
        except Exception as error:
            log.warning("best effort sink failed: sink=%s commit=%s error=%s", name, commit, error)

    return write


class SinkErrors(RuntimeError):
    """Failures of several sinks, joined."""


def fan_out(*sinks: Sink | None) -> Sink:
    """Give each batch to every sink; one that fails does not stop the others."""

    def write(batches: DataFrame, commit: int) -> None:
        errors = []
        batches.persist()
        try:
            for sink in sinks:
                if sink is None:
                    continue
                try:
                    sink(batches, commit)
                except Exception as error:
                    errors.append(error)
        finally:
            batches.unpersist()
        if errors:
            raise SinkErrors("; ".join(str(error) for error in errors)) from errors[0]

    return write
