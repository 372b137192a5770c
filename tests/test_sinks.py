import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F
from test_notify import event

from alertlake.schema import BATCH
from alertlake.settings import Settings
from alertlake.sources import readers, sinks

DAY = dt.datetime(2026, 3, 24, 23, 30)


def batches(spark, *rows):
    made = [("h", log_id, at, at, 1, ["app"], [event(log_id=log_id)], at, muted) for log_id, at, muted in rows]
    return spark.createDataFrame(made, f"host string, {BATCH}")


def stored_lines(path):
    return {f: open(f).read().splitlines() for f in glob.glob(f"{path}/**/*.json", recursive=True)}


def test_batches_are_filed_by_day_and_kind(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", DAY, False), ("b", DAY, True), ("monitor.health.docker.event_stream", dt.datetime(2026, 4, 1), False)]
    sinks.write_batches(batches(spark, *rows), path)
    files = stored_lines(path)
    assert sum(len(v) for k, v in files.items() if "month=2026-03/day=2026-03-24/kind=alert" in k) == 2
    assert sum(len(v) for k, v in files.items() if "month=2026-04/day=2026-04-01/kind=health" in k) == 1
    lines = {json.loads(line)["log_id"]: json.loads(line) for v in files.values() for line in v}
    assert "suppress_alert_sinks" not in lines["a"] and lines["b"]["suppress_alert_sinks"] is True
    assert lines["a"]["last_seen"] == "2026-03-24T23:30:00.000000Z"
    back = {r.log_id: r for r in readers.read_batches(spark, path).collect()}
    assert back["a"].last_seen == DAY and back["a"].suppress_alert_sinks is False and back["a"].events[0].raw == "boom"


def test_day_of_the_event_in_utc(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        filed = sinks.with_day(batches(spark, ("a", DAY, False)).withColumn("last_seen", F.lit("2026-03-25 00:30:00").cast("timestamp")))
        assert filed.select("day").first()[0] == "2026-03-24"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_commit_written_twice_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.write_batches(batches(spark, ("a", DAY, False)), path, commit=5)
    sinks.write_batches(batches(spark, ("b", DAY, False)), path, commit=6)
    assert sorted(r.log_id for r in readers.read_batches(spark, path).collect()) == ["a", "b"]


def test_bad_lines_are_counted_and_skipped(spark, tmp_path):
    folder = tmp_path / "2026-03"
    folder.mkdir()
    (folder / "2026-03-24.jsonl").write_text('{"log_id":"a","events":[]}\nnot json\n{"log_id":\n')
    (folder / "notes.txt").write_text("x\n")
    assert [r.log_id for r in readers.read_batches(spark, str(tmp_path)).collect()] == ["a"]
    assert [r.lines for r in readers.bad_lines(spark, str(tmp_path)).collect()] == [2]


def test_fan_out_reaches_every_sink(spark):
    seen = []

    def failing(_rows, _commit):
        raise OSError("down")

    def counting(rows, commit):
        seen.append((rows.count(), commit))

    rows = batches(spark, ("a", DAY, False))
    with pytest.raises(sinks.SinkErrors, match="down"):
        sinks.fan_out(counting, failing, None, counting)(rows, 3)
    sinks.fan_out(sinks.best_effort("x", failing), counting)(rows, 4)
    assert seen == [(1, 3), (1, 3), (1, 4)]


def test_outbox(spark, tmp_path):
    path = str(tmp_path / "outbox")
    write = sinks.outbox_sink(path, Settings(at_mobiles=["1"]))
    for _ in range(2):
        write(batches(spark, ("a", DAY, False), ("b", DAY, True)), 9)
    got = spark.read.parquet(path).orderBy("part").collect()
    assert [(r.log_id, r.msgtype, r.commit) for r in got] == [("a", "markdown", 9), ("a", "text", 9)]


def test_text_files(spark, tmp_path):
    folder = tmp_path / "prod-a" / "c1" / "api"
    folder.mkdir(parents=True)
    (folder / "stderr.log").write_text("2026-03-28T12:34:56.789123456Z hello world\r\n\n   \nno time\n2026-03-28T12:34:56+08:00 x\n")
    got = readers.read_raw_logs(spark, str(tmp_path), "text").orderBy("seq").collect()
    assert [r.line for r in got] == ["hello world", "no time", "x"]
    assert got[0].timestamp == dt.datetime(2026, 3, 28, 12, 34, 56, 789123) and got[1].timestamp is None
    assert (got[0].host, got[0].container.id, got[0].container.name, got[0].stream) == ("prod-a", "c1", "api", "stderr")
    assert got[1].ingest_ts is not None
    stream = readers.stream_raw_logs(spark, str(tmp_path), "text")
    query = stream.writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("landed").count() == 3


def test_container_events(spark, tmp_path):
    rows = [
        {"host": "h", "ts": "2026-03-28T12:00:00Z", "seq": 1, "Type": "container", "Action": "start", "id": "a", "Actor": {"ID": "a", "Attributes": {"name": "x"}}},
        {"host": "h", "ts": "2026-03-28T12:00:00Z", "seq": 2, "Type": "network", "Action": "connect"},
    ]
    (tmp_path / "events.json").write_text("\n".join(map(json.dumps, rows)))
    (got,) = readers.read_container_events(spark, str(tmp_path)).collect()
    assert (got.Action, got.Actor.Attributes["name"]) == ("start", "x")


def test_lines(spark):
    from alertlake.functions.text import CLIP_BYTES, CLIP_SUFFIX
    from alertlake.operators import lines

    stamp = "2026-03-28T12:34:56Z "
    frame = spark.createDataFrame([(1, stamp + "a" * CLIP_BYTES), (2, stamp + "ok\r")], "seq int, line string")
    clipped = lines.split_timestamp_prefix(lines.drop_blank_lines(lines.clip_lines(frame))).orderBy("seq").collect()
    assert clipped[0].line == "a" * (CLIP_BYTES - len(stamp)) + CLIP_SUFFIX and clipped[1].line == "ok"
    urls = ["", " unix:///x", "ssh://me@h/p", "ssh://@", "tcp://h:1", "https://h", "plain"]
    labels = spark.createDataFrame([(u,) for u in urls], "u string").select(lines.host_label(F.col("u"))).collect()
    assert [r[0] for r in labels] == ["local", "local", "me@h", "ssh", "h:1", "h", "plain"]


def test_outbox_queue_goes_on_over_commits(spark, tmp_path):
    """Send times of three commits, one of them tried twice and an end among them, are those of one queue; what does not fit takes no slot."""
    rnd = random.Random(6)
    at = [DAY + dt.timedelta(seconds=second) for second in sorted(rnd.choices(range(60), k=25))]
    rows = [(f"id{n}", ts, False) for n, ts in enumerate(at)]
    settings = Settings(at_all=True, mention_levels=["WARN", "ERROR", ""], webhook_url="https://x/y")
    path, once, huge = (str(tmp_path / name) for name in ("outbox", "once", "huge"))
    write = sinks.outbox_sink(path, settings)
    for low, high, commit in ((0, 8, 0), (8, 17, -2), (8, 17, -2), (17, 25, 1)):
        write(batches(spark, *rows[low:high]), commit)
    sent = spark.read.parquet(path).orderBy("send_at").collect()
    sinks.outbox_sink(once, settings)(batches(spark, *rows))
    alone = spark.read.parquet(once).orderBy("send_at").collect()
    assert [r.send_at for r in sent] == [r.send_at for r in alone] and len(sent) >= 25
    assert all((b.send_at - a.send_at).total_seconds() >= 4 for a, b in zip(sent, sent[1:]))
    sinks.outbox_sink(huge, settings)(batches(spark, ("x" * 30_000, DAY, False)), 0)
    # The title is part of the markdown message alone.
    refused, kept = (sorted(r.msgtype for r in spark.read.parquet(folder).collect()) for folder in (f"{huge}-rejected", huge))
    assert (refused, kept) == (["markdown"], ["text"])


def test_commits_are_read_whole_and_merged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    made = lambda *names: batches(spark, *[(name, DAY, name == "b") for name in names])
    seen = lambda: sorted((r.host, r.log_id, r.suppress_alert_sinks) for r in readers.read_stored_batches(spark, path).collect())
    rows = lambda names: [("h", name, name == "b") for name in names]
    for names, commit in (("ab", 0), ("x", 1), ("c", 1), ("d", -3), ("e", 2), ("f", None)):
        sinks.write_batches(made(*names), path, commit)
    assert seen() == rows("abcdef")

    def failing(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        # The data of commit 3 is there, its note is not.
        patch.setattr(sinks, "note_commit", failing)
        with pytest.raises(OSError):
            sinks.write_batches(made("g"), path, 3)
        with pytest.raises(OSError):
            sinks.merge_commits(spark, path, 1)
    assert seen() == rows("abcdef")
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "drop_hidden", failing)
        with pytest.raises(OSError):
            sinks.merge_commits(spark, path, 1)
    assert seen() == rows("abcdef")
    assert sinks.merge_commits(spark, path, 1) == 3 and seen() == rows("abcdef")
    sinks.write_batches(made("g"), path, 3)
    assert sinks.merge_commits(spark, path, 3) == 3 and seen() == rows("abcdefg")
    assert sinks.merge_commits(spark, path, 3) == 0 and seen() == rows("abcdefg")
    assert len({f.rsplit("/", 2)[1] for f in stored_lines(path)}) == 2
