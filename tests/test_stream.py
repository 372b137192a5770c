import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from test_batches import SCHEMA, event, flushed

from alertlake.operators.batches import flush_batches
from alertlake.operators.health import health_transitions
from alertlake.schema import RAW_LOG
from alertlake.settings import Settings
from alertlake.sources import readers
from alertlake.streaming import health as live_health
from alertlake.streaming import live

MARKED = f"{SCHEMA}, marker boolean"


def comparable(rows):
    return sorted(
        (r.log_id, r.first_seen, r.last_seen, r["count"], tuple(r.containers), tuple(e.raw for e in r.events), r.flushed_at, r.cause)
        for r in rows
    )


def land(spark, folder, parts):
    """One file per part, in order of landing."""
    for number, part in enumerate(parts):
        spark.createDataFrame(part, MARKED).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if number < len(parts) - 1 else 0)


@pytest.mark.parametrize("size", [1, 3])
def test_stream_equals_batch(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = []
    for seq in range(240):
        log_id = rnd.choice(["hot", "hot", "hot", "k1", "k2", "unknown"])
        rows.append(event(seq, log_id, log_id == "unknown" or rnd.random() < 0.15, at=seq + rnd.randint(-3, 3), arrival=seq // 2))
    ends = [event(10_000 + n, log_id, False) for n, log_id in enumerate(["hot", "k1", "k2"])]
    parts = [[(*r, False) for r in rows[i : i + 80]] for i in range(0, 240, 80)] + [[(*r, True) for r in ends]]
    folder = str(tmp_path / "in")
    land(spark, folder, parts)
    source = spark.readStream.schema(MARKED).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = live.stream_batches(source, size, 20, continuous=False)
    query = (
        stream.writeStream.format("memory").queryName(f"grouped{size}")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 4
    expected = flush_batches(spark.createDataFrame(rows, SCHEMA), size, 20).collect()
    assert comparable(spark.table(f"grouped{size}").collect()) == comparable(expected)


@pytest.mark.parametrize("state", [None, "groups"])
def test_whole_job_writes_files_and_outbox(spark, tmp_path, state):
    start = dt.datetime(2026, 3, 24, 10, 0)
    rows = [
        ("h", ("c", "api"), "stdout", f"{level} step log_id={key}", start + dt.timedelta(seconds=n), start + dt.timedelta(seconds=n), n)
        for n, (level, key) in enumerate([("INFO", "a"), ("ERROR", "a"), ("WARN", "b"), ("ERROR", "b"), ("INFO", "c")])
    ]
    landed, out, outbox = (str(tmp_path / name) for name in ("landed", "out", "outbox"))
    spark.createDataFrame(rows, RAW_LOG).write.parquet(landed)
    settings = Settings(flush_size=2, output_dir=out, at_all=True)

    def windows():
        span = (start + dt.timedelta(seconds=2), start + dt.timedelta(seconds=9))
        return spark.createDataFrame([("h", *span)], "host string, start_ts timestamp, end_ts timestamp")

    folder = str(tmp_path / state) if state else None
    source = readers.stream_raw_logs(spark, landed)
    query = live.start_alerts(source, settings, str(tmp_path / "ck"), outbox, continuous=False, windows=windows, state=folder)
    assert query.awaitTermination(300)
    stored = {r.log_id: r for r in readers.read_batches(spark, out).collect()}
    assert {k: (v["count"], v.suppress_alert_sinks) for k, v in stored.items()} == {"a": (2, False), "b": (2, True)}
    sent = spark.read.parquet(outbox).orderBy("part").collect()
    assert [(r.log_id, r.msgtype) for r in sent] == [("a", "markdown"), ("a", "text")]


def test_timer_ends_a_quiet_group(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [[(*event(1, "a", True), False), (*event(2, "b", False), False)]])
    stream = live.stream_batches(spark.readStream.schema(MARKED).parquet(folder), 5, 1, continuous=True)
    query = (
        stream.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not spark.table("quiet").count():
            time.sleep(1)
    finally:
        query.stop()
    assert [(r.log_id, r.cause) for r in spark.table("quiet").collect()] == [("a", "interval")]
    assert len(flushed(spark, [event(1, "a", True)], 5, 1)) == 1
    assert spark.table("quiet").where(F.col("log_id") == "b").count() == 0


def lone_line(spark, folder):
    at = dt.datetime(2026, 3, 24, 10, 0)
    row = ("h", ("c", "api"), "stdout", "ERROR step log_id=a", at, at, 1)
    spark.createDataFrame([row], RAW_LOG).write.parquet(folder)
    return readers.stream_raw_logs(spark, folder)


def batches_in(spark, folder, wait=0):
    deadline = time.time() + wait
    while True:
        try:
            found = [(r.log_id, r["count"]) for r in readers.read_batches(spark, folder).collect()]
        except Exception:
            found = []
        if found or time.time() >= deadline:
            return found
        time.sleep(1)


@pytest.mark.parametrize("state", [None, "groups"])
def test_a_lone_line_leaves_a_continuous_job(spark, tmp_path, state):
    """No further line arrives and nobody ends the job: a timer or the heartbeat does it."""
    out = str(tmp_path / "out")
    source = lone_line(spark, str(tmp_path / "landed"))
    settings = Settings(flush_size=5, flush_interval="2s", output_dir=out)
    query = live.start_alerts(source, settings, str(tmp_path / "ck"), state=str(tmp_path / state) if state else None)
    try:
        assert batches_in(spark, out, 150) == [("a", 1)]
    finally:
        query.stop()


def test_a_lone_line_leaves_a_job_over_what_is_available(spark, tmp_path):
    out = str(tmp_path / "out")
    source = lone_line(spark, str(tmp_path / "landed"))
    settings = Settings(flush_size=5, output_dir=out)
    live.drain_alerts(source, settings, str(tmp_path / "ck"))
    assert batches_in(spark, out) == [("a", 1)]
    live.drain_alerts(source, settings, str(tmp_path / "ck"))
    assert batches_in(spark, out) == [("a", 1)]


def test_an_end_whose_sink_fails_loses_nothing(spark, tmp_path):
    blocked, state = tmp_path / "blocked", str(tmp_path / "state")
    source = lone_line(spark, str(tmp_path / "landed"))
    settings = Settings(flush_size=5, output_dir=str(tmp_path / "out"))
    assert live.start_alerts(source, settings, str(tmp_path / "ck"), continuous=False, state=state).awaitTermination(300)
    blocked.write_text("a file where the folder should be")
    with pytest.raises(Exception):
        live.end_alerts(spark, Settings(flush_size=5, output_dir=str(blocked)), state)
    live.end_alerts(spark, settings, state)
    live.end_alerts(spark, settings, state)
    assert batches_in(spark, settings.output_dir) == [("a", 1)]


def test_health_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    rows = [(f"h{n % 2}", f"c{rnd.randint(0, 2)}", start + dt.timedelta(seconds=n // 3), n, rnd.random() < 0.3, "down") for n in range(500)]
    schema, folder = "host string, component string, ts timestamp, seq bigint, ok boolean, error string", str(tmp_path / "status")
    for part in range(5):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = live_health.stream_transitions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("transitions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    columns = ["host", "component", "ts", "seq", "level", "failures"]
    want = health_transitions(spark.createDataFrame(rows, schema)).select(*columns).collect()
    assert sorted(map(tuple, spark.table("transitions").select(*columns).collect())) == sorted(map(tuple, want)) and want
