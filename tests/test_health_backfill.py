import datetime as dt
import random

import pytest

from alertlake.operators import backfill, health
from alertlake.schema import BATCH_FIELDS, RAW_LOG

START = dt.datetime(2026, 1, 1)


def at(second):
    return START + dt.timedelta(seconds=second)


def second(ts):
    return int((ts - START).total_seconds())


def status(spark, flags, component="docker.event_stream"):
    rows = [("prod-a", component, at(n), n, bool(ok), None if ok else "dial error") for n, ok in enumerate(flags)]
    return spark.createDataFrame(rows, "host string, component string, ts timestamp, seq bigint, ok boolean, error string")


def test_degraded_and_recovered(spark):
    made = health.health_batches(health.health_transitions(status(spark, [0, 0, 0, 0, 1, 1, 0, 1])))
    first, last = made.orderBy("last_seen").collect()
    assert made.columns == BATCH_FIELDS and first.log_id == "monitor.health.docker.event_stream"
    assert (first.events[0].level, first.containers) == ("ERROR", ["prod-a/monitor"])
    assert first.events[0].message == "docker event stream entered degraded state"
    assert first.events[0].raw == "docker event stream entered degraded state: dial error\nconsecutive_failures=3"
    assert (last.events[0].level, last.events[0].raw) == ("INFO", "docker event stream recovered\nconsecutive_failures=4")


def test_failure_runs_equal_a_model(spark):
    rnd = random.Random(4)
    flags = [rnd.random() < 0.4 for _ in range(200)]
    run, expected = 0, []
    for ok in flags:
        expected.append(run if ok else run + 1)
        run = 0 if ok else run + 1
    got = health.failure_runs(status(spark, flags)).orderBy("seq").collect()
    assert [r.failures for r in got] == expected


def raw(spark, rows):
    """Rows of (container, arrival, time written)."""
    made = [("h", ("id", name), "stdout", "x", None if ts is None else at(ts), at(arrival), n) for n, (name, arrival, ts) in enumerate(rows)]
    return spark.createDataFrame(made, RAW_LOG)


def windows(spark, rows, threshold=100, longest=1000):
    found = backfill.backfill_windows(raw(spark, rows), threshold, longest).orderBy("container", "start_ts").collect()
    return [(r.container, second(r.start_ts), second(r.end_ts), r.disconnected_for, r.reason) for r in found]


def test_window_closes_when_caught_up(spark):
    rows = [("a", 0, 0), ("a", 200, 50), ("a", 201, None), ("a", 205, 169), ("a", 210, 170), ("a", 220, 220)]
    assert windows(spark, rows) == [("a", 200, 210, 200.0, backfill.CAUGHT_UP)]


def test_window_times_out(spark):
    rows = [("a", 0, 0), ("a", 200, 10), ("a", 290, 11), ("b", 5000, 5000)]
    assert windows(spark, rows, longest=80) == [("a", 200, 280, 200.0, backfill.TIMED_OUT)]


def test_window_ends_with_the_input(spark):
    assert windows(spark, [("a", 0, 0), ("a", 200, 10), ("b", 300, 300)]) == [("a", 200, 300, 200.0, backfill.STOPPED)]


def test_short_gaps_open_nothing(spark):
    assert windows(spark, [("a", 0, 0), ("a", 99, 0), ("a", 198, 0)]) == []
    assert windows(spark, [("a", 0, 0), ("a", 500, 0)], threshold=0) == []


def test_silence_alone_opens_nothing(spark):
    assert windows(spark, [("a", 0, 0), ("a", 500, 499), ("a", 1000, 970), ("a", 1500, None)]) == []
    assert windows(spark, [("a", 0, 0), ("a", 0.7, -60)], threshold=0.5) == [("a", 0, 0, 0.7, backfill.STOPPED)]


def merged(spark, rows, **options):
    made = [("h", name, at(start), at(end), float(gap), "r") for name, start, end, gap in rows]
    table = spark.createDataFrame(made, "host string, container string, start_ts timestamp, end_ts timestamp, disconnected_for double, reason string")
    return backfill.merge_windows(table, **options)


def test_overlapping_windows_are_one(spark):
    rows = [("a", 0, 100, 5), ("b", 10, 20, 9), ("c", 50, 150, 7), ("a", 150, 160, 1), ("d", 400, 400, 2)]
    got = merged(spark, rows).orderBy("start_ts").collect()
    assert [(second(r.start_ts), second(r.end_ts), r.disconnected_for) for r in got] == [(0, 150, 9.0), (150, 160, 1.0), (400, 400, 2.0)]


def test_muted_batches_and_summary(spark):
    from test_batches import SCHEMA, event

    spans = merged(spark, [("a", 100, 200, 21600.4)])
    rows = [event(110, "x", True), event(111, "x", True), event(120, "unknown", True), event(200, "y", True), event(201, "y", True)]
    from alertlake.operators.batches import flush_batches

    events = spark.createDataFrame(rows, SCHEMA)
    marked = backfill.mark_suppressed(flush_batches(events, 2, 1000), spans)
    got = {r.log_id: r.suppress_alert_sinks for r in marked.collect()}
    assert got == {"x": True, "unknown": True, "y": False}
    (summary,) = backfill.backfill_summary(events, spans).collect()
    text = summary.events[0].raw
    assert summary.log_id == "monitor.health.docker.log_backfill" and summary.events[0].level == "WARN"
    assert "previously offline for 6h0m0s, replayed 3 matching events" in text and "replayed_alert_count=3" in text
    assert "backfill_started_at=2026-01-01T00:01:40Z" in text and text.endswith("end_reason=r")
