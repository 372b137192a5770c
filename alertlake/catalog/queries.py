"""One query per operator, over whole tables. Arrays come out as joined text and times as microseconds."""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import fixtures
from alertlake.functions import text as tx
from alertlake.functions.json import json_object, leaf_texts
from alertlake.functions.patterns import any_match, compile_patterns
from alertlake.functions.requests import client_ip, strip_query
from alertlake.functions.times import parse_time_string
from alertlake.operators import backfill, batches, health, lifecycle, lines, notify, parse, probes
from alertlake.plans import alerts
from alertlake.plans.session import tune
from alertlake.plans.slices import checkpointed, scratch_path
from alertlake.settings import Settings, apply_host_settings, resolve_host_settings
from alertlake.sources import readers, sinks
from alertlake.streaming import commits, live
from alertlake.streaming import health as stream_alerts

Query = Callable[[SparkSession, str], DataFrame]

UTC = dt.timezone.utc
SETTINGS = Settings(exclude_regexps=[r"(?i)context canceled"], at_mobiles=["13800000000", "13900000000"])
SIZE, INTERVAL = 3, 2 * 86400.0
OTHER_SIZE, OTHER_INTERVAL = 2, 86400.0
GAP, LONGEST = 6 * 3600.0, 1800.0
GLOBS = ["api-*", "w?b-[0-2]", "db"]
NAMES = ["svc-*"]
ZONE = "Asia/Shanghai"


def us(column: str | Column) -> Column:
    return F.unix_micros(column)


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def tuned(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(tune(spark), sf)

    return run


def raw_logs(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_logs(spark, sf)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_lines(raw_logs(spark, sf), SETTINGS)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the jobs hand them on: parsed once and stored."""
    return checkpointed(parse.parse_events(raw_logs(spark, sf), SETTINGS))


def alert_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.flush_batches(events(spark, sf), SIZE, INTERVAL)


def stored_batches(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "batches")
    sinks.write_batches(alert_batches(spark, sf), path)
    return path


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    return probes.explode_events(readers.read_probe_batches(spark, stored_batches(spark, sf)))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---- sources, sinks, raw lines


def _raw_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        "host", "seq", "stream", "line", F.col("container.id").alias("container_id"),
        F.col("container.name").alias("container_name"), us("timestamp").alias("ts_us"), us("ingest_ts").alias("ingest_us"),
    )


def read_raw_logs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    fixtures.raw_logs(spark, sf).write.parquet(path)
    return _raw_columns(readers.read_raw_logs(spark, path))


def stream_raw_logs(spark: SparkSession, sf: str) -> DataFrame:
    landed, copied = scratch_path(spark, "raw"), scratch_path(spark, "copy")
    fixtures.raw_logs(spark, sf).write.parquet(landed)
    query = (
        readers.stream_raw_logs(spark, landed)
        .writeStream.format("parquet")
        .option("path", copied)
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(600)
    query.stop()
    return _raw_columns(readers.read_raw_logs(spark, copied))


def read_container_events(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lifecycle")
    rows = fixtures.container_events(spark, sf)
    kind = F.when(F.col("seq") % 11 == 0, "network").otherwise("container")
    rows.withColumn("Type", kind).write.option("timestampFormat", sinks.TIME_FORM).json(path)
    read = readers.read_container_events(spark, path)
    return read.select("host", "seq", "Action", "id", F.col("Actor.Attributes")["name"].alias("name"), us("ts").alias("ts_us"))


def write_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Alert and health batches with the folder that each was filed in."""
    path = scratch_path(spark, "filed")
    own = health.health_batches(health.health_transitions(fixtures.status(spark, sf)))
    sinks.write_batches(alert_batches(spark, sf).drop("cause").unionByName(own), path)
    stored = readers.read_batches(spark, path)
    folder = [F.regexp_extract("file", f"/{name}=([^/]*)/", 1).alias(name) for name in ("month", "day", "kind")]
    return stored.select("log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), F.col("count").cast("bigint").alias("count"), *folder)


def read_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_columns(readers.read_batches(spark, stored_batches(spark, sf)))


def append_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one folder; both are read back."""
    path, rows = scratch_path(spark, "appended"), alert_batches(spark, sf).drop("cause")
    for half in (0, 1):
        sinks.write_batches(rows.where(F.pmod(F.crc32(F.col("log_id").cast("binary")), F.lit(2)) == half), path)
    return _batch_columns(readers.read_batches(spark, path))


def merged_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Four commits, of which three are merged into one and another is not whole; what readers see."""
    path, rows = scratch_path(spark, "merged"), checkpointed(alert_batches(spark, sf).drop("cause"))
    part = F.pmod(F.crc32(F.col("log_id").cast("binary")), F.lit(4))
    for commit in range(4):
        sinks.write_batches(rows.where(part == commit), path, commit)
    sinks.merge_commits(spark, path, 2)
    sinks.stored_files(rows.limit(5), path, 4)
    return _batch_columns(readers.read_batches(spark, path))


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two sinks and a failing one between them; what the last sink stored."""
    first, second = scratch_path(spark, "first"), scratch_path(spark, "second")

    def failing(_rows: DataFrame, _commit: int) -> None:
        raise OSError("sink is down")

    write = sinks.fan_out(sinks.file_sink(first), sinks.best_effort("failing", failing), sinks.file_sink(second))
    write(batches.single_event_batches(events(spark, sf)).drop("cause"), 7)
    return _batch_columns(readers.read_batches(spark, second))


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "outbox")
    sinks.outbox_sink(path, SETTINGS)(alert_batches(spark, sf).drop("cause"), 3)
    sent = spark.read.parquet(path)
    return sent.groupBy("log_id", "msgtype", "commit").agg(F.count("*").alias("messages"))


def debug_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.debug_lines(fixtures.raw_logs(spark, sf))


def match_containers(spark: SparkSession, sf: str) -> DataFrame:
    raw = lines.with_container_name(fixtures.raw_logs(spark, sf), F.concat(F.lit("/"), "container.name"))
    return lines.match_containers(raw, GLOBS).select("host", "seq", F.col("container.name").alias("container_name"))


def exclude_container(spark: SparkSession, sf: str) -> DataFrame:
    return lines.exclude_container(fixtures.raw_logs(spark, sf), " c0-0 ").select("seq", F.col("container.id").alias("id"))


def since_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    start = dt.datetime(2024, 1, 20, 0, 0, 0, 700000, tzinfo=UTC)
    return lines.since_cutoff(fixtures.raw_logs(spark, sf), start, 86400).select("seq", us("timestamp").alias("ts_us"))


def split_timestamp_prefix(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.raw_logs(spark, sf)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z' ")
    first = F.when(F.col("seq") % 3 == 0, stamp).when(F.col("seq") % 3 == 1, "not-a-timestamp ").otherwise("")
    split = lines.split_timestamp_prefix(raw.withColumn("line", F.concat(first, "line")))
    return split.select("seq", "line", us("timestamp").alias("ts_us"))


def clip_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = documents(spark, sf).select("doc_id", F.col("text").alias("line"))
    return lines.clip_lines(raw, 1000).select("doc_id", F.md5("line").alias("line_md5"), F.octet_length("line").alias("bytes"))


def drop_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.raw_logs(spark, sf)
    kind = F.col("seq") % 4
    line = F.when(kind == 0, F.lit(" \t　\r")).when(kind == 1, F.concat("line", F.lit("\r\r"))).otherwise(F.col("line"))
    return lines.drop_blank_lines(raw.withColumn("line", line)).select("seq", "line")


def host_labels(spark: SparkSession, sf: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    prefixes = ["", "unix:///run/", "ssh://root@", "ssh://@", "tcp://", "https://"]
    chosen = F.element_at(F.array(*[F.lit(p) for p in prefixes]), (F.col("c_custkey") % 6 + 1).cast("int"))
    url = F.when(F.col("c_custkey") % 6 == 0, " ").otherwise(F.concat(chosen, "c_name", F.lit("/x")))
    return customer.select("c_custkey", lines.host_label(url).alias("label"))


def prefix_host(spark: SparkSession, sf: str) -> DataFrame:
    return lines.prefix_host(fixtures.raw_logs(spark, sf)).select("seq", F.col("container.name").alias("container_name"))


def host_settings(spark: SparkSession, sf: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    override = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey") * 5)
    overrides = nation.select(
        F.col("n_nationkey").alias("host"), override.alias("flush_size"), F.lit(None).cast("int").alias("max_events")
    )
    settings = resolve_host_settings(overrides, Settings(), ["flush_size", "max_events"])
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("host"))
    return apply_host_settings(rows, settings)


# ---- parsing


def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_logs(spark, sf)
    fields = json_object(tx.trim_space(F.col("line")))
    return raw.select("seq", fields.isNotNull().alias("is_json"), F.coalesce(F.size(F.map_keys(fields)), F.lit(0)).alias("n"))


def ci_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.col("fields")
    return parsed(spark, sf).select("seq", *[parse.ci_get(fields, key).alias(key) for key in ("LOG_ID", "Level", "severity", "msg")])


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("seq", "message")


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("seq", us("event_ts").alias("ts_us"))


def time_strings(spark: SparkSession, sf: str) -> DataFrame:
    events_ = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    forms = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+08:00'"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        F.unix_seconds("ts").cast("string"),
        F.date_format("ts", "yyyy-MM-dd"),
        F.date_format("ts", "HH:mm:ss"),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return events_.select("event_id", us(parse_time_string(text)).alias("ts_us"))


def alert_levels(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("seq", "level")


def first_groups(spark: SparkSession, sf: str) -> DataFrame:
    patterns = compile_patterns([r"(?i)\b(purchase)( failed)?", r"(error) handled", r"view"])
    return raw_logs(spark, sf).select("seq", tx.first_group(F.col("line"), patterns).alias("found"))


def log_ids(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("seq", "log_id")


def exclude_shallow(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where(~F.col("excluded")).select("seq", "line")


def exclude_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose excluded word is spelled with an escape, so that only the decoded value shows it."""
    patterns = compile_patterns([r"(?i)\Acontext\b"])
    line = F.replace(F.trim("line"), F.lit("context"), F.lit("\\u0063ontext"))
    raw = raw_logs(spark, sf).withColumn("line", line)
    deep = F.exists(leaf_texts(F.col("line")), lambda leaf: any_match(leaf, patterns))
    return raw.select("seq", (json_object(F.col("line")).isNotNull() & deep).alias("excluded"))


def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse.parse_events(raw_logs(spark, sf), SETTINGS)
    return rows.select(
        "host", "seq", us("timestamp").alias("ts_us"), F.col("container.name").alias("container_name"), "stream", "level",
        "log_id", "alert_matched", "message", "raw", "parsed_from_json",
    )


def parse_per_host(spark: SparkSession, sf: str) -> DataFrame:
    per_host = {
        "host-0": SETTINGS,
        "host-1": SETTINGS.override({"level_regexps": [r"(?i)\b(INFO)\b"]}),
        "host-2": SETTINGS.override({"exclude_regexps": ["heartbeat", "request"]}),
    }
    rows = parse.parse_events(raw_logs(spark, sf), per_host)
    return rows.groupBy("host", "level").agg(F.count("*").alias("events"), F.countDistinct("log_id").alias("ids"))


# ---- batches


def _batch_columns(rows: DataFrame) -> DataFrame:
    texts = F.array_join(F.transform("events", lambda event: event["raw"]), "|")
    return rows.select(
        "log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
        F.col("count").cast("bigint").alias("count"), joined("containers").alias("containers"),
        F.md5(texts).alias("events_md5"), us("flushed_at").alias("flushed_us"),
    )


def single_event_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_columns(batches.single_event_batches(events(spark, sf)))


def flush_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_columns(batches.flush_batches(events(spark, sf), SIZE, final=False).where("cause != 'single'"))


def flush_small_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of one, so that the buffer of ten overflows in front of an alert."""
    return _batch_columns(batches.flush_batches(events(spark, sf), 1, INTERVAL).where("cause != 'single'"))


def flush_by_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches.flush_by_interval(events(spark, sf), INTERVAL)
    return rows.select(
        "host", "log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "count",
        joined("containers").alias("containers"), us("flushed_at").alias("flushed_us"),
    )


def assign_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return batches.assign_ticks(events(spark, sf), INTERVAL).select("seq", "batch_tick")


def flush_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_columns(alert_batches(spark, sf))


def sort_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = alert_batches(spark, sf)
    positions = rows.select("log_id", "flushed_at", F.posexplode("events").alias("place", "event"))
    return positions.select("log_id", us("flushed_at").alias("flushed_us"), "place", us("event.timestamp").alias("ts_us"), "event.raw")


def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """All events; alerts count only for ids that end in an even character, so that there are groups that wait."""
    even = F.ascii(F.substring("log_id", -1, 1)) % 2 == 0
    rows = events(spark, sf).withColumn("alert_matched", F.col("alert_matched") & even)
    return batches.keep_last(rows, 2).select("host", "log_id", "seq")


def pending_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches.pending_groups(events(spark, sf), INTERVAL)
    return rows.select("host", "log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "count")


def final_flush(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches.flush_batches(events(spark, sf), SIZE, final=True)
    return _batch_columns(rows.where("cause = 'interval'")).drop("flushed_us")


def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The grouping as a stream over stored events, each group ended by a marker row."""
    landed, out = scratch_path(spark, "events"), scratch_path(spark, "grouped")
    rows = events(spark, sf).withColumn("marker", F.lit(False))
    ends = rows.groupBy("host", "log_id").agg(F.max("ingest_ts").alias("ingest_ts"), F.max("unknown_log_id").alias("unknown_log_id"))
    marked = rows.unionByName(ends.withColumn("marker", F.lit(True)), allowMissingColumns=True)
    marked.write.parquet(landed)
    stream = live.stream_batches(spark.readStream.schema(marked.schema).parquet(landed), SIZE, INTERVAL, continuous=False)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(600)
    query.stop()
    return _batch_columns(spark.read.schema(stream.schema).parquet(out))


def group_commits(spark: SparkSession, sf: str) -> DataFrame:
    """The grouping commit by commit: the month in three parts, and a shutdown at the end."""
    rows, state = events(spark, sf), scratch_path(spark, "groups")
    first, second = F.col("ingest_ts") < "2024-01-11", F.col("ingest_ts") < "2024-01-21"
    made = []
    for commit, part in enumerate((first, second & ~first, ~second)):
        made.append(commits.group_commit(rows.where(part), commit, state, SIZE, INTERVAL))
    made.append(commits.final_flush(spark, 2, state))
    return _batch_columns(functools.reduce(DataFrame.unionByName, made))


def live_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job as a stream over landed lines of watched containers, twice over what is available, and its end."""
    landed, state, out = (scratch_path(spark, name) for name in ("landed", "groups", "stored"))
    settings = dataclasses.replace(SETTINGS, flush_size=SIZE, flush_interval=f"{INTERVAL:.0f}s", include_patterns=GLOBS, output_dir=out)
    rows, late = raw_logs(spark, sf), F.col("ingest_ts") >= "2024-01-16"
    place = scratch_path(spark, "stream")
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(landed)
        raw = readers.stream_raw_logs(spark, landed)
        live.start_alerts(raw, settings, place, continuous=False, state=state).awaitTermination(600)
    live.end_alerts(spark, settings, state)
    return _batch_columns(readers.read_batches(spark, out))


def drained_job(spark: SparkSession, sf: str) -> DataFrame:
    """The live job over all that is available, to its end."""
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "stored")
    settings = dataclasses.replace(SETTINGS, flush_size=SIZE, flush_interval=f"{INTERVAL:.0f}s", include_patterns=GLOBS, output_dir=out)
    raw_logs(spark, sf).write.parquet(landed)
    live.drain_alerts(readers.stream_raw_logs(spark, landed), settings, scratch_path(spark, "stream"))
    return _batch_columns(readers.read_batches(spark, out))


# ---- settings per host


def host_settings_of(output_dir: str = "data") -> dict[str, Settings]:
    """Two sets of settings for three hosts: sizes, intervals, replay limits, webhooks and whom to mention."""
    one = dataclasses.replace(SETTINGS, flush_size=SIZE, flush_interval=f"{INTERVAL:.0f}s", backfill_threshold="6h", backfill_max_duration="30m", webhook_url="https://one/hook", output_dir=output_dir)
    other = one.override({"flush_size": OTHER_SIZE, "flush_interval": f"{OTHER_INTERVAL:.0f}s", "backfill_threshold": "4h", "backfill_max_duration": "2h", "webhook_url": "https://other/hook", "at_mobiles": []})
    return {"host-0": one, "host-1": other, "host-2": other}


def flush_per_host(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches.flush_batches(events(spark, sf), *alerts.host_limits(host_settings_of()))
    return _batch_columns(rows.withColumn("log_id", F.concat_ws("/", "host", "log_id")))


def windows_per_host(spark: SparkSession, sf: str) -> DataFrame:
    found = backfill.backfill_windows(fixtures.raw_logs(spark, sf), *alerts.replay_limits(host_settings_of()))
    return found.select("host", "container", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "reason")


def job_per_host(spark: SparkSession, sf: str) -> DataFrame:
    """Alert messages of the whole job: who is told, by which webhook, and what a replay has muted."""
    tables = alerts.run_alerts(raw_logs(spark, sf), host_settings_of(), many_hosts=False)
    told = tables.messages.where(~notify.is_health(F.col("log_id")))
    return told.select("host", "webhook", "log_id", "msgtype", us("arrival").alias("arrival_us"))


# ---- replay windows


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return backfill.backfill_windows(fixtures.raw_logs(spark, sf), GAP, LONGEST)


def backfill_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).select(
        "host", "container", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"),
        F.round(F.col("disconnected_for") * 1e6).cast("bigint").alias("gap_us"), "reason",
    )


def merge_windows(spark: SparkSession, sf: str) -> DataFrame:
    return backfill.merge_windows(windows(spark, sf)).select(
        "host", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"),
        F.round(F.col("disconnected_for") * 1e6).cast("bigint").alias("gap_us"),
    )


def mark_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    merged = backfill.merge_windows(windows(spark, sf))
    marked = backfill.mark_suppressed(alert_batches(spark, sf).drop("cause"), merged)
    return marked.select(
        "log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), us("flushed_at").alias("flushed_us"),
        F.col("count").cast("bigint").alias("count"), "suppress_alert_sinks",
    )


def backfill_summary(spark: SparkSession, sf: str) -> DataFrame:
    merged = backfill.merge_windows(windows(spark, sf))
    rows = backfill.backfill_summary(events(spark, sf), merged)
    return rows.select(
        "host", "log_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
        F.col("events")[0]["message"].alias("message"),
    )


# ---- lifecycle and health


def _lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.normalize_container_events(fixtures.container_events(spark, sf), "c7")


def normalize_container_events(spark: SparkSession, sf: str) -> DataFrame:
    return _lifecycle(spark, sf).select("host", "seq", us("ts").alias("ts_us"), "action", "id", "name")


def container_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.container_sessions(_lifecycle(spark, sf), NAMES)
    return rows.select("host", "name", "id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "replaced_by")


def container_replacements(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.container_replacements(_lifecycle(spark, sf), NAMES)
    return rows.select("host", "name", "seq", "old_id", "new_id")


def container_renames(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.container_renames(_lifecycle(spark, sf), NAMES)
    return rows.select("host", "id", "seq", "old_name", "new_name")


def active_containers(spark: SparkSession, sf: str) -> DataFrame:
    sessions = lifecycle.container_sessions(_lifecycle(spark, sf), NAMES)
    return lifecycle.active_containers(sessions, dt.datetime(2024, 1, 15, tzinfo=UTC)).select("host", "name", "id")


def live_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    words = F.array(*[F.lit(word) for word in (" Running ", "exited", "PAUSED", "dead", "created", "")])
    status = F.element_at(words, (F.col("user_id") % 6 + 1).cast("int"))
    live_ = lifecycle.is_live_state(F.col("event_id") % 17 == 0, F.col("event_id") % 19 == 0, status)
    return rows.select("event_id", live_.alias("live"))


def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return health.failure_runs(fixtures.status(spark, sf)).select("host", "component", "seq", "ok", "failures", "run_id")


def health_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_transitions(fixtures.status(spark, sf)).select("host", "component", "seq", "level", "failures")


def health_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.health_batches(health.health_transitions(fixtures.status(spark, sf)))
    event = F.col("events")[0]
    return rows.select(
        "log_id", us("last_seen").alias("last_us"), joined("containers").alias("containers"), event["level"].alias("level"),
        event["raw"].alias("raw"),
    )


# ---- notifications


def _prefixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Alert batches with host names in front of the containers, and the health batches."""
    alerts = checkpointed(parse.parse_events(lines.prefix_host(raw_logs(spark, sf)), SETTINGS))
    grouped = batches.flush_batches(alerts, SIZE, INTERVAL).drop("cause")
    return grouped.unionByName(health.health_batches(health.health_transitions(fixtures.status(spark, sf))))


def _batch_key() -> list[Column]:
    return [F.col("log_id"), us("flushed_at").alias("flushed_us"), us("first_seen").alias("first_us")]


def health_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prefixed_batches(spark, sf)
    return rows.select(
        *_batch_key(), notify.is_health(F.col("log_id")).alias("is_health"),
        notify.health_component(F.col("log_id")).alias("component"),
    )


def batch_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixed_batches(spark, sf).select(*_batch_key(), joined(notify.batch_hosts(F.col("containers"))).alias("hosts"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixed_batches(spark, sf).select(*_batch_key(), notify.title(F.col("log_id"), F.col("containers")).alias("title"))


def should_mention(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixed_batches(spark, sf).select(*_batch_key(), notify.should_mention(F.col("events"), [" error ", ""]).alias("mention"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prefixed_batches(spark, sf).where(~notify.is_health(F.col("log_id")))
    body = notify.markdown(F.struct(*rows.columns), 2, ZONE)
    return rows.select(*_batch_key(), body.alias("body"))


def health_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.health_batches(health.health_transitions(fixtures.status(spark, sf)))
    return rows.select(*_batch_key(), notify.health_markdown(F.struct(*rows.columns)).alias("body"))


def event_detail(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("```"), "text")
    detail = notify.event_detail(F.when(F.col("doc_id") % 5 != 0, text), F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    return documents(spark, sf).select("doc_id", F.md5(detail).alias("detail_md5"))


def mention_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prefixed_batches(spark, sf)
    batch = F.struct(*rows.columns)
    return rows.select(
        *_batch_key(), notify.mention_text(batch, False, SETTINGS.at_mobiles).alias("mention"),
        notify.mention_text(batch, True, []).alias("everyone"),
    )


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    rows = notify.notifications(_prefixed_batches(spark, sf), SETTINGS, ZONE)
    return rows.groupBy("log_id", "msgtype").agg(
        F.count("*").alias("messages"), F.count("payload").alias("payloads"), F.min(us("arrival")).alias("first_us")
    )


def fit_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as message bodies."""
    rows = documents(spark, sf)
    payload = notify.fit_payload(lambda text: notify.payload_json("markdown", F.col("source"), text), F.col("text"))
    return rows.select("doc_id", F.md5(payload).alias("payload_md5"), F.octet_length(payload).alias("bytes"))


def send_schedule(spark: SparkSession, sf: str) -> DataFrame:
    status = fixtures.status(spark, sf)
    queue = status.select(F.concat(F.lit("hook-"), F.col("component")).alias("webhook"), "ts", "seq")
    rows = notify.send_schedule(queue, ["webhook"], ["ts", "seq"], 3600.0)
    return rows.select("webhook", "seq", "place", us("send_at").alias("send_us"))


def outbox_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The outbox over three commits: one queue of messages with their send times."""
    path, rows = scratch_path(spark, "outbox"), checkpointed(alert_batches(spark, sf).drop("cause"))
    first, second = F.col("flushed_at") < "2024-01-11", F.col("flushed_at") < "2024-01-21"
    for commit, part in enumerate((first, second & ~first, ~second)):
        sinks.outbox_sink(path, SETTINGS)(rows.where(part), commit)
    sent = spark.read.parquet(path)
    return sent.select(us("arrival").alias("arrival_us"), us("send_at").alias("send_us"))


def stream_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health batches of a stream of status rows, in two runs over what is available."""
    landed, out, place = (scratch_path(spark, name) for name in ("status", "stored", "stream"))
    rows, late = fixtures.status(spark, sf), F.col("ts") >= "2024-01-16"
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(landed)
        status = spark.readStream.schema(rows.schema).parquet(landed)
        stream_alerts.start_health(status, sinks.file_sink(out), place, {"availableNow": True}).awaitTermination(600)
    own = readers.read_batches(spark, out)
    event = F.col("events")[0]
    return own.select("log_id", us("last_seen").alias("last_us"), joined("containers").alias("containers"), event["level"].alias("level"), event["raw"].alias("raw"))


# ---- probes


def explode_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_events(spark, sf)
    return rows.select(F.col("container.name").alias("container"), us("timestamp").alias("ts_us"), "message", "raw")


def request_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = probes.request_events(stored_events(spark, sf))
    return rows.select(us("timestamp").alias("ts_us"), *[F.col("request")[name].alias(name) for name in ("url", "method", "x_forwarded_for")])


def strip_query_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    kind = F.col("page_id") % 4
    url = (
        F.when(kind == 1, F.concat("url", F.lit("#top")))
        .when(kind == 2, F.concat(F.regexp_replace("url", "^https?://[^/]*", ""), F.lit("/a%20b+c")))
        .when(kind == 3, F.concat("url", F.lit("/%zz")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", strip_query(F.regexp_replace(url, r"\?([^#/]*)(.*)$", "$2?$1")).alias("path"))


def client_ips(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    number = F.col("user_id").cast("string")
    kind = F.col("event_id") % 6
    real = F.when(kind == 0, F.concat(F.lit(" 1.0.0."), number)).when(kind == 1, "  ")
    forwarded = F.when(kind == 2, F.concat(F.lit("2.0.0."), number, F.lit(" , 9.9.9.9"))).when(kind == 3, " , 8.8.8.8")
    plain = F.when(kind == 4, F.concat(F.lit("3.0.0."), number))
    remote = F.when(kind == 5, F.concat(F.lit("[::1]:"), number)).when(kind == 1, ":80")
    return rows.select("event_id", client_ip(real, forwarded, plain, remote).alias("ip"))


def probe_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = probes.probe_hits(stored_events(spark, sf))
    return hits.select("path", "ip", us("timestamp").alias("ts_us"), "method", "url", "container")


def probe_values(spark: SparkSession, sf: str) -> DataFrame:
    return probes.probe_values(probes.probe_hits(stored_events(spark, sf)))


def probe_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = probes.probe_stats(probes.probe_hits(stored_events(spark, sf)))
    return stats.select(
        "path", "ip", "hits", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "n_methods", "n_urls", "n_containers",
    )


def rank_probes(spark: SparkSession, sf: str) -> DataFrame:
    stats = probes.probe_stats(probes.probe_hits(stored_events(spark, sf)))
    return probes.report_order(probes.rank_probes(stats)).select("path_position", "path", "rank", "ip", "hits")


def path_summary(spark: SparkSession, sf: str) -> DataFrame:
    paths = [*probes.DEFAULT_PATHS, "/never"]
    return probes.path_summary(probes.probe_stats(probes.probe_hits(stored_events(spark, sf), paths)), paths)


def probe_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Hits on a table of paths: one per customer, and two that are asked for."""
    customer = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("/c/"), "c_custkey").alias("path"))
    asked = customer.where("path = '/c/1'").select(F.explode(F.array(F.lit("/api/.env"), F.lit("/health"))).alias("path"))
    hits = probes.probe_hits(stored_events(spark, sf), customer.union(asked))
    return hits.groupBy("path", "ip").agg(F.count("*").alias("hits"))


def total_hits(spark: SparkSession, sf: str) -> DataFrame:
    return probes.total_hits(probes.probe_hits(stored_events(spark, sf)))


def all_queries() -> dict[str, Query]:
    named = [
        read_raw_logs, stream_raw_logs, read_container_events, write_batches, read_batches, append_batches, merged_commits, fan_out, outbox, debug_lines,
        match_containers, exclude_container, since_cutoff, split_timestamp_prefix, clip_lines, drop_blank_lines,
        host_labels, prefix_host, host_settings, json_objects, ci_fields, messages, event_times, time_strings, first_groups,
        alert_levels, log_ids, exclude_shallow, exclude_deep, parse_events, parse_per_host, single_event_batches,
        flush_by_size, flush_small_buffer, flush_by_interval, assign_ticks, flush_batches, sort_events, keep_last,
        pending_groups, final_flush, stream_batches, group_commits, live_job, drained_job, flush_per_host, windows_per_host, job_per_host, backfill_windows, merge_windows, mark_suppressed, backfill_summary,
        normalize_container_events, container_sessions, container_replacements, container_renames, active_containers,
        live_states, failure_runs, health_transitions, health_batches, health_components, batch_hosts, titles,
        should_mention, markdown, health_markdown, event_detail, mention_text, notifications, fit_payload, send_schedule,
        explode_events, request_events, strip_query_urls, client_ips, probe_hits, probe_values, probe_stats, rank_probes,
        path_summary, probe_targets, total_hits, outbox_schedule, stream_health,
    ]
    return {query.__name__: tuned(query) for query in named}
