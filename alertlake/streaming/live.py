"""The alert job as a stream: grouping with keyed state, and the query that feeds the sinks."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from alertlake.operators.backfill import mark_suppressed
from alertlake.operators.batches import event_struct, is_single, with_limits
from alertlake.operators.lines import watched_lines
from alertlake.operators.parse import parse_events
from alertlake.plans.alerts import host_limits
from alertlake.plans.batch_scan import BUFFER_FACTOR
from alertlake.schema import BATCH_FIELDS, EVENT
from alertlake.settings import HostSettings, each_setting, output_folders
from alertlake.sources.sinks import Sink, best_effort, fan_out, file_sink, outbox_sink
from alertlake.streaming.commits import final_flush, grouping_sink, has_ended, last_commit, note_end

# The state processor travels with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Single events are spread over this many state keys per host; they leave no state behind.
SALTS = 256
OUTPUT = (
    "host string, log_id string, first_seen timestamp, last_seen timestamp, count int, containers array<string>,"
    " lines array<string>, flushed_at timestamp, cause string"
)


class GroupBuffer(StatefulProcessor):
    """Open group of one key: its newest events, and what is known of all of them."""

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ts long, arrival long, seq long, line string")
        self.facts = handle.getValueState(
            "facts", "first long, last long, alert boolean, tick long, total long, interval long, room long, containers array<string>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["marker", "arrival", "seq"], kind="stable")
        if key[2] >= 0:
            lines = [(row, [(row.ts, row.arrival, row.seq, row.line)]) for row in batch.itertuples()]
            single = [self.record(key, line, row.ts, row.ts, {row.container}, row.arrival, "single") for row, line in lines]
            yield pd.DataFrame(single)
            return
        group, stored = self.load()
        out = []
        for row in batch.itertuples():
            tick = row.arrival // row.interval
            if group["alert"] and (row.marker or tick != group["tick"]):
                out.append(self.finish(key, group, "interval"))
                group = new_group()
            if row.marker:
                continue
            self.append(group, row, tick)
            if group["alert"] and len(group["events"]) >= row.size:
                out.append(self.finish(key, group, "size"))
                group = new_group()
        self.save(group, stored)
        if self.timers and group["alert"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + group["interval"] // 1000)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        group, stored = self.load()
        if group["alert"]:
            self.save(new_group(), stored)
            yield pd.DataFrame([self.finish(key, group, "interval")])

    def finish(self, key, group, cause) -> dict:
        last = max(event[1] for event in group["events"])
        at = last if cause == "size" else (group["tick"] + 1) * group["interval"]
        first = group["events"][0][0] if group["total"] > group["room"] else group["first"]
        return self.record(key, group["events"], first, group["last"], group["containers"], at, cause)

    def append(self, group, row, tick) -> None:
        group["events"].append((row.ts, row.arrival, row.seq, row.line))
        group["interval"], group["room"] = int(row.interval), int(row.size) * BUFFER_FACTOR
        del group["events"][: -group["room"]]
        group["total"] += 1
        group["tick"] = tick
        group["alert"] = group["alert"] or bool(row.alert)
        group["containers"].add(row.container)
        if row.ts is not None and not pd.isna(row.ts):
            group["first"] = row.ts if group["first"] is None else min(group["first"], row.ts)
            group["last"] = row.ts if group["last"] is None else max(group["last"], row.ts)

    def close(self) -> None:
        pass

    @staticmethod
    def record(key, events, first, last, containers, at, cause) -> dict:
        ordered = sorted(events, key=lambda e: (-1 if e[0] is None or pd.isna(e[0]) else e[0], e[1], e[2]))
        return {
            "host": key[0], "log_id": key[1], "first_seen": _time(first), "last_seen": _time(last), "count": len(events),
            "containers": sorted(c for c in containers if c is not None), "lines": [e[3] for e in ordered],
            "flushed_at": _time(at), "cause": cause,
        }

    def load(self) -> tuple[dict, bool]:
        """The open group, and whether there is stored state."""
        facts = self.facts.get()
        if facts is None:
            return new_group(), False
        first, last, alert, tick, total, interval, room, containers = facts
        group = {
            "events": [tuple(event) for event in self.events.get()], "first": first, "last": last, "alert": alert,
            "tick": tick, "total": total, "interval": interval, "room": room, "containers": set(containers),
        }
        return group, True

    def save(self, group: dict, stored: bool) -> None:
        if group["events"]:
            self.events.put([tuple(_plain(value) for value in event) for event in group["events"]])
            facts = [_plain(group[name]) for name in ("first", "last", "alert", "tick", "total", "interval", "room")]
            self.facts.update((*facts, sorted(c for c in group["containers"] if c is not None)))
        elif stored:
            self.events.clear()
            self.facts.clear()


def new_group() -> dict:
    return {"events": [], "first": None, "last": None, "alert": False, "tick": 0, "total": 0, "interval": 0, "room": 0, "containers": set()}


def _plain(value):
    """Numpy scalars as Python ones, missing numbers as None."""
    if value is None or isinstance(value, (str, bool)):
        return value
    return None if pd.isna(value) else (bool(value) if type(value).__name__ == "bool_" else int(value))


def _time(micros):
    return pd.NaT if micros is None or pd.isna(micros) else pd.Timestamp(int(micros), unit="us")


def stream_batches(events: DataFrame, flush_size: int | Column, interval: float | Column, continuous: bool = True) -> DataFrame:
    """Batches of a stream of events, by size and by interval, which may be columns that depend on the host.

    Ticks follow the arrival times of the rows. With ``continuous``, a timer also ends groups whose key has gone
    quiet. Without it, for runs over what is available, a quiet group is ended by a row whose ``marker`` is true (a
    column of its own, optional). A group that waits for an alert is never forgotten.
    """
    # Keyed state in several columns needs this state store, which also keeps large state out of the heap.
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marker = F.coalesce("marker", F.lit(False)) if "marker" in events.columns else F.lit(False)
    single = F.coalesce(is_single(), F.lit(False)) & ~marker
    rows = with_limits(events, flush_size, interval).select(
        "host",
        "log_id",
        F.col("flush_size").alias("size"),
        F.col("interval_us").alias("interval"),
        F.when(single, F.pmod(F.hash("seq"), F.lit(SALTS))).otherwise(-1).alias("salt"),
        F.unix_micros("timestamp").alias("ts"),
        F.unix_micros("ingest_ts").alias("arrival"),
        "seq",
        F.coalesce("alert_matched", F.lit(False)).alias("alert"),
        F.col("container.name").alias("container"),
        F.to_json(event_struct(), JSON_TIME).alias("line"),
        marker.alias("marker"),
    )
    processor = GroupBuffer(continuous)
    mode = "ProcessingTime" if continuous else "None"
    batches = rows.groupBy("host", "log_id", "salt").transformWithStateInPandas(processor, OUTPUT, "append", mode)
    parsed = F.transform("lines", lambda line: F.from_json(line, EVENT, JSON_TIME))
    return batches.withColumns({"events": parsed, "suppress_alert_sinks": F.lit(False)}).select(*BATCH_FIELDS, "cause")


def alert_sink(settings: HostSettings, outbox: str | None, windows: Callable[[], DataFrame] | None = None) -> Sink:
    """Stored batches first, then notifications, which cannot hold up the files."""
    notify = best_effort("outbox", outbox_sink(outbox, settings)) if outbox else None
    write = fan_out(*[file_sink(path, hosts) for path, hosts in output_folders(settings)], notify)

    def sink(batches: DataFrame, commit: int) -> None:
        write(mark_suppressed(batches, windows()) if windows else batches, commit)

    return sink


def heartbeats(spark: SparkSession, seconds: float) -> DataFrame:
    """A stream of one row per ``seconds`` that only says how late it is."""
    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).option("advanceMillisPerBatch", int(seconds * 1000)).load()
    return beats.select(F.current_timestamp().alias("ingest_ts"), F.lit(True).alias("heartbeat"))


def start_alerts(
    raw: DataFrame, settings: HostSettings, checkpoint: str, outbox: str | None = None, continuous: bool = True,
    windows: Callable[[], DataFrame] | None = None, state: str | None = None, own_id: str = "", many_hosts: bool = False,
    beat: bool = True, started_at: dt.datetime | None = None,
) -> StreamingQuery:
    """Run the whole job on a stream of raw lines. ``windows`` reads the replay windows anew for each commit.

    Lines are filtered by container and prefixed as in the batch job; ``settings`` are one set or one per host. With
    ``started_at``, lines written before the host's ``since`` are left out.

    Groups are kept in keyed state or, with a ``state`` folder, commit by commit: choose the latter where one id may
    hold much of the stream. A continuous job ends the groups of a quiet stream by itself, by timers or, commit by commit, by a
    ``beat`` beside the rows. A job over what is available is always grouped commit by commit, by default below its
    checkpoint; it ends with open groups, which the next run goes on with. ``drain_alerts`` runs it and ends it.
    """
    events = parse_events(watched_lines(raw, settings, own_id, many_hosts, started_at), settings)
    size, interval = host_limits(settings)
    shortest = min(one.seconds("flush_interval") for one in each_setting(settings))
    sink = alert_sink(settings, outbox, windows)
    state = state if continuous else state or groups_folder(checkpoint)
    if state:
        if continuous and beat:
            events = events.withColumn("heartbeat", F.lit(False)).unionByName(heartbeats(raw.sparkSession, shortest), allowMissingColumns=True)
        writer = events.writeStream.foreachBatch(grouping_sink(state, size, interval, sink))
    else:
        batches = stream_batches(events, size, interval)
        writer = batches.drop("cause").writeStream.foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    trigger = {"processingTime": f"{shortest} seconds"} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def groups_folder(checkpoint: str) -> str:
    """Where a job over what is available keeps its open groups."""
    return f"{checkpoint.rstrip('/')}-groups"


def drain_alerts(
    raw: DataFrame, settings: HostSettings, checkpoint: str, outbox: str | None = None, windows: Callable[[], DataFrame] | None = None,
    own_id: str = "", many_hosts: bool = False,
) -> int:
    """Run the job over what is available, to its end: also the groups that are open then go to the sinks. Returns the last commit."""
    start_alerts(raw, settings, checkpoint, outbox, False, windows, None, own_id, many_hosts).awaitTermination()
    return end_alerts(raw.sparkSession, settings, groups_folder(checkpoint), outbox, windows)


def end_alerts(
    spark: SparkSession, settings: HostSettings, state: str, outbox: str | None = None, windows: Callable[[], DataFrame] | None = None
) -> int:
    """End a job that groups commit by commit: its open groups with an alert go to the sinks, under a number of their own.

    The sinks come first and the note that the groups have left comes last. If a sink fails, the error is raised and nothing is
    noted: ending again hands over the same batches, whose files replace what the first try has left. Calling it again after
    it has worked, or going on with the stream, does not send them twice. Returns the number of the commit.
    """
    commit = last_commit(spark, state)
    if commit >= 0 and not has_ended(spark, state, commit):
        # Its files stand beside those of the commit itself: numbers of ends are negative.
        alert_sink(settings, outbox, windows)(final_flush(spark, commit, state).drop("cause"), -2 - commit)
        note_end(spark, commit, state)
    return commit
