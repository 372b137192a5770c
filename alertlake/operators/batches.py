"""Events to alert batches: by size, by interval, with context lines.

Rules per ``(host, log_id)``, rows taken in order of arrival:

* an event joins the open group of its key;
* a group with an alert that reaches ``flush_size`` events is emitted at once;
* at every tick of ``interval`` seconds all groups with an alert are emitted;
* a group without an alert waits, and keeps only its newest ``10 * flush_size`` events;
* an alert without a known id is a batch of its own.

Size and interval may differ from host to host: both can be given as columns.

Where a batch ends depends only on where it starts, so the scan of a run of rows needs to know no more than the
group that is open before it. ``assign_batches`` sorts the keys, times and alert marks of the rows into slices of equal
size, notes in a first pass what each slice makes of any open group, composes these notes in levels, and marks the batch of
every row in a second pass. Messages and raw lines stay out of the sort and of both passes; the marks are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.plans.batch_scan import BUFFER_FACTOR, MARKS, NOTE, chain, mark, summarise
from alertlake.plans.slices import SLICE, landed, range_slices, slice_count
from alertlake.schema import BATCH_FIELDS, EVENT_FIELDS

KEYS = ["host", "log_id"]
ORDER = ["ingest_ts", "seq"]


def event_struct() -> Column:
    return F.struct(*EVENT_FIELDS)


def tick_of(ts: Column, interval: float, origin: float = 0.0) -> Column:
    """Number of the tick that ends the interval in which the row arrived."""
    return F.floor((F.unix_micros(ts) - int(origin * 1_000_000)) / F.lit(int(interval * 1_000_000))).cast("bigint")


def tick_end(tick: Column, interval: float, origin: float = 0.0) -> Column:
    return F.timestamp_micros((tick + 1) * int(interval * 1_000_000) + int(origin * 1_000_000))


def is_single(unknown: Column | None = None) -> Column:
    """Alerts without a known id are never grouped: together they would be the largest key of all."""
    return F.col("alert_matched") & (F.col("log_id") == (F.col("unknown_log_id") if unknown is None else unknown))


def single_event_batches(events: DataFrame) -> DataFrame:
    one = events.where(is_single())
    return one.select(
        "host",
        "log_id",
        F.col("timestamp").alias("first_seen"),
        F.col("timestamp").alias("last_seen"),
        F.lit(1).alias("count"),
        F.array("container.name").alias("containers"),
        F.array(event_struct()).alias("events"),
        F.col("ingest_ts").alias("flushed_at"),
        F.lit(False).alias("suppress_alert_sinks"),
        F.lit("single").alias("cause"),
    )


def grouped_events(events: DataFrame) -> DataFrame:
    return events.where(~is_single())


# ---- ticks only -----------------------------------------------------------------------------------------------


def tick_groups(events: DataFrame, interval: float, origin: float = 0.0) -> DataFrame:
    """One row per key and tick, with the tick that emits it in ``batch_tick``, NULL while none does.

    Events of a tick leave together, so the rows are reduced to key and tick before any window. What is left of a
    key is one row per tick, however many events it has.
    """
    tick = tick_of(F.col("ingest_ts"), interval, origin)
    ticks = (
        grouped_events(events)
        .groupBy(*KEYS, tick.alias("tick"))
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.count("*").alias("count"),
            F.collect_set("container.name").alias("containers"),
            F.bool_or("alert_matched").alias("has_alert"),
        )
    )
    # From the last tick backwards the frame grows row by row; forwards it would be computed anew for each.
    later = Window.partitionBy(*KEYS).orderBy(F.desc("tick")).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("batch_tick", F.min(F.when(F.col("has_alert"), F.col("tick"))).over(later))


def flush_by_interval(events: DataFrame, interval: float, origin: float = 0.0) -> DataFrame:
    """Batches cut by ticks alone, as summaries: without a size limit a batch may hold any number of events."""
    emitted = tick_groups(events, interval, origin).where(F.col("batch_tick").isNotNull())
    # Names one by one, so that the set is made distinct in the map tasks; the count goes with the first name only.
    named = emitted.select(
        *KEYS, "batch_tick", "first_seen", "last_seen", "count", F.posexplode_outer("containers").alias("place", "container")
    )
    merged = named.groupBy(*KEYS, "batch_tick").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, F.col("count"))).alias("count"),
        F.sort_array(F.collect_set("container")).alias("containers"),
    )
    return merged.withColumn("flushed_at", tick_end(F.col("batch_tick"), interval, origin))


def assign_ticks(events: DataFrame, interval: float, origin: float = 0.0) -> DataFrame:
    """Every grouped event with the tick that emits it; NULL for events of pending groups."""
    rows = grouped_events(events).withColumn("tick", tick_of(F.col("ingest_ts"), interval, origin))
    ticks = tick_groups(events, interval, origin).select(*KEYS, "tick", "batch_tick")
    return rows.join(ticks, [*KEYS, "tick"])


def pending_groups(events: DataFrame, interval: float, origin: float = 0.0) -> DataFrame:
    """Groups that wait for an alert at the end of the input, as summaries."""
    waiting = tick_groups(events, interval, origin).where(F.col("batch_tick").isNull())
    return waiting.groupBy(*KEYS).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count")
    )


def keep_last(events: DataFrame, flush_size: int) -> DataFrame:
    """The newest events of each key that has no alert, as many as its buffer holds.

    The rank limit runs before the shuffle as well, so a task sends at most one buffer per key.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("ingest_ts"), F.desc("seq"))
    ranked = grouped_events(events).withColumn("rank", F.row_number().over(newest))
    buffered = ranked.where(F.col("rank") <= max(flush_size, 1) * BUFFER_FACTOR).drop("rank")
    alerted = grouped_events(events).where("alert_matched").select(*KEYS).distinct()
    return buffered.join(alerted, KEYS, "left_anti")


# ---- size and ticks -------------------------------------------------------------------------------------------


def with_limits(events: DataFrame, flush_size: int | Column, interval: float | Column | None) -> DataFrame:
    """Rows with the size and the interval that hold for them, as ``flush_size`` and ``interval_us``; NULL is no interval."""
    size = flush_size if isinstance(flush_size, Column) else F.lit(flush_size)
    seconds = interval if isinstance(interval, Column) else F.lit(interval)
    micros = F.floor(seconds.cast("double") * 1_000_000).cast("bigint")
    return events.withColumns({"flush_size": F.greatest(size, F.lit(1)).cast("int"), "interval_us": micros})


def tick_at(ts: Column, origin: float = 0.0) -> Column:
    """``tick_of`` by the interval of the row; 0 without one."""
    return F.coalesce(F.floor((F.unix_micros(ts) - int(origin * 1_000_000)) / F.col("interval_us")), F.lit(0)).cast("bigint")


def flush_batches(
    events: DataFrame,
    flush_size: int | Column,
    interval: float | Column | None = None,
    origin: float = 0.0,
    final: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Batches cut by size and, if given, by interval, plus the single-event ones.

    ``flush_size`` and ``interval`` (seconds) are numbers, or columns of the events that depend on the host. ``final`` emits
    what is left with an alert at the end of the input, as a shutdown does; with an interval the last tick does that anyway.
    """
    groups = batch_groups(events, flush_size, interval, origin, slices)
    emitted = groups.where(F.col("has_alert"))
    if not final and interval is None:
        emitted = emitted.where(F.col("cause") == "size")
    return emitted.select(*BATCH_FIELDS, "cause").unionByName(single_event_batches(events))


def batch_groups(
    events: DataFrame, flush_size: int | Column, interval: float | Column | None, origin: float = 0.0, slices: int | None = None
) -> DataFrame:
    """Every group of the input, emitted or still waiting, one row each."""
    marked = assign_batches(events, flush_size, interval, origin, slices)
    return as_batches(marked.groupBy(*KEYS, "batch_id").agg(*group_facts(ORDER)), origin)


def group_facts(order: list[str]) -> list[Column]:
    """What is collected of each group of marked events."""
    kept = F.struct("timestamp", *order, event_struct().alias("event"))
    return [
        F.count("*").alias("total"),
        F.bool_or("alert_matched").alias("has_alert"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("last_seen"),
        F.min_by("timestamp", F.when(F.col("keep"), F.struct(*order))).alias("oldest_kept"),
        F.sort_array(F.collect_set("container.name")).alias("containers"),
        F.max("tick").alias("tick"),
        F.max("ingest_ts").alias("last_arrival"),
        F.max("flush_size").alias("flush_size"),
        F.max("interval_us").alias("interval_us"),
        # At most one buffer per batch: the scan has marked the rows that the buffer still holds at the end.
        F.collect_list(F.when(F.col("keep"), kept)).alias("kept"),
    ]


def is_full() -> Column:
    return F.col("has_alert") & (F.col("total") >= F.col("flush_size"))


def as_batches(groups: DataFrame, origin: float = 0.0) -> DataFrame:
    room, full = F.col("flush_size") * BUFFER_FACTOR, is_full()
    ended = F.timestamp_micros((F.col("tick") + 1) * F.col("interval_us") + int(origin * 1_000_000))
    return groups.select(
        *KEYS,
        F.when(F.col("total") > room, F.col("oldest_kept")).otherwise(F.col("earliest")).alias("first_seen"),
        "last_seen",
        F.least("total", room).cast("int").alias("count"),
        "containers",
        F.transform(F.sort_array("kept"), lambda row: row["event"]).alias("events"),
        F.when(full, F.col("last_arrival")).otherwise(F.coalesce(ended, "last_arrival")).alias("flushed_at"),
        F.lit(False).alias("suppress_alert_sinks"),
        "has_alert",
        F.when(full, "size").when(F.col("has_alert"), "interval").otherwise("pending").alias("cause"),
    )


def assign_batches(
    events: DataFrame, flush_size: int | Column, interval: float | Column | None, origin: float = 0.0, slices: int | None = None
) -> DataFrame:
    """Every grouped event with ``batch_id`` and ``keep``, whether the buffer still holds it at the end."""
    return mark_batches(with_limits(grouped_events(events), flush_size, interval), origin, slices)


def mark_batches(rows: DataFrame, origin: float = 0.0, slices: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows with limits, each with the start of its batch."""
    order = order or ORDER
    kept = landed(rows.withColumns({"tick": tick_at(F.col("ingest_ts"), origin), "uid": F.monotonically_increasing_id()}), "rows")
    narrow = kept.select("uid", *KEYS, *order, "tick", "alert_matched", "flush_size")
    slices = slices or slice_count(narrow)
    sliced = range_slices(narrow, KEYS, [*order, "uid"], slices, row="row").drop(*order)
    notes = sliced.drop("uid", "row").mapInArrow(summarise, NOTE)
    entries = chain(notes, slices, lambda level: landed(level, "notes"))
    marks = sliced.groupBy(SLICE).cogroup(entries.groupBy("slice")).applyInArrow(mark, MARKS)
    return kept.join(marks, "uid").drop("uid")
