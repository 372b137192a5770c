import datetime as dt
import random

import pyarrow as pa
import pytest
from models import cut_groups
from pyspark.sql import functions as F

from alertlake.operators import batches
from alertlake.plans import batch_scan
from alertlake.plans.batch_scan import BUFFER_FACTOR, ROW_BITS

SCHEMA = (
    "host string, timestamp timestamp, container struct<id:string,name:string>, stream string, level string, log_id string,"
    " alert_matched boolean, message string, raw string, parsed_from_json boolean, ingest_ts timestamp, seq bigint,"
    " unknown_log_id string"
)
START = dt.datetime(2026, 1, 1)


def event(seq, log_id, alert, at=None, arrival=None, container="app", host="h"):
    at = seq if at is None else at
    arrival = seq if arrival is None else arrival
    return (
        host, START + dt.timedelta(seconds=at), ("id", container), "stdout", "ERROR" if alert else "", log_id, alert, f"m{seq}",
        f"r{seq}", False, START + dt.timedelta(seconds=arrival), seq, "unknown",
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def flushed(spark, rows, size, interval=None, **options):
    found = batches.flush_batches(frame(spark, rows), size, interval, **options).collect()
    return sorted(found, key=lambda b: (b.log_id, b.flushed_at))


def seconds(ts):
    return int((ts - START).total_seconds())


def raws(batch):
    return [e.raw for e in batch.events]


def test_size(spark):
    rows = [event(10, "a", True, container="app-1"), event(11, "a", True, container="app-2")]
    (batch,) = flushed(spark, rows, 2, 10)
    assert (batch["count"], batch.containers, batch.cause) == (2, ["app-1", "app-2"], "size")
    assert (seconds(batch.first_seen), seconds(batch.last_seen)) == (10, 11)


def test_interval(spark):
    (batch,) = flushed(spark, [event(3, "a", True)], 10, 10)
    assert (batch["count"], batch.cause, seconds(batch.flushed_at)) == (1, "interval", 10)


def test_context_rides_along(spark):
    (batch,) = flushed(spark, [event(30, "a", False), event(31, "a", True)], 2, 10)
    assert raws(batch) == ["r30", "r31"]


def test_events_are_sorted_by_time(spark):
    (batch,) = flushed(spark, [event(1, "a", True, at=101), event(2, "a", False, at=100)], 2, 10)
    assert raws(batch) == ["r2", "r1"]


def test_no_alert_no_batch(spark):
    rows = [event(1, "a", False)]
    assert flushed(spark, rows, 10, 10) == []
    assert [r["count"] for r in batches.pending_groups(frame(spark, rows), 10).collect()] == [1]


def test_unknown_ids_are_single(spark):
    found = flushed(spark, [event(1, "unknown", True), event(2, "unknown", True)], 20, 10)
    assert [(b["count"], b.cause) for b in found] == [(1, "single")] * 2


def test_full_buffer_keeps_the_newest(spark):
    rows = [event(t, "a", False) for t in range(25)]
    kept = [r.seq for r in batches.keep_last(frame(spark, rows), 2).orderBy("seq").collect()]
    assert kept == list(range(5, 25))
    (batch,) = flushed(spark, [*rows, event(25, "a", True, container="late")], 2, 10_000)
    assert (batch["count"], seconds(batch.first_seen), seconds(batch.last_seen)) == (20, 6, 25)
    assert raws(batch)[0] == "r6" and batch.containers == ["app", "late"]


def test_waiting_group_survives_ticks(spark):
    (batch,) = flushed(spark, [event(1, "a", False), event(25, "a", True)], 10, 10)
    assert raws(batch) == ["r1", "r25"] and seconds(batch.flushed_at) == 30


def test_final_flush(spark):
    rows = [event(1, "a", True)]
    assert len(flushed(spark, rows, 5)) == 1 and flushed(spark, rows, 5, final=False) == []


def random_rows(rnd, count):
    rows, key, tick = [], 0, 0
    new_key, new_tick, alert = rnd.choice([0, 0.02, 0.2]), rnd.choice([0, 0.05, 0.3]), rnd.choice([0.02, 0.2, 0.7, 1])
    for _ in range(count):
        if rnd.random() < new_key:
            key, tick = key + 1, 0
        tick += rnd.random() < new_tick
        rows.append((f"{key:04d}", tick, rnd.random() < alert))
    return rows


def need_of(key, sizes):
    return sizes[int(key) % len(sizes)]


def arrow(rows, low, high, number, size, sizes):
    schema = pa.schema(
        [("slice", pa.int32()), ("host", pa.string()), ("log_id", pa.string()), ("tick", pa.int64()), ("alert_matched", pa.bool_()), ("flush_size", pa.int32()), ("uid", pa.int64()), ("row", pa.int64())]
    )
    for begin in range(low, high, size):
        part = [
            {"slice": number, "host": "h", "log_id": key, "tick": tick, "alert_matched": alert, "flush_size": need_of(key, sizes), "uid": begin + i, "row": begin + i - low}
            for i, (key, tick, alert) in enumerate(rows[begin : min(high, begin + size)])
        ]
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def entries_in_levels(notes, count):
    """What the levels of small tables do, without Spark."""
    levels = [notes]
    while count > batch_scan.FAN:
        groups = {}
        for note in levels[-1]:
            groups.setdefault(note["slice"] // batch_scan.FAN, []).append(note)
        levels.append([batch_scan.compose(group) for group in groups.values()])
        count = -(-count // batch_scan.FAN)
    entries = batch_scan.descend(levels.pop(), None) if levels[-1] else []
    while levels:
        groups = {}
        for note in levels.pop():
            groups.setdefault(note["slice"] // batch_scan.FAN, []).append(note)
        parents = {entry["slice"]: entry for entry in entries}
        entries = [entry for node, group in groups.items() for entry in batch_scan.descend(group, parents[node])]
    return {entry["slice"]: entry for entry in entries}


@pytest.mark.parametrize("seed", range(8))
def test_scan_equals_the_model_for_any_slices(seed, monkeypatch):
    monkeypatch.setattr(batch_scan, "FAN", 2 + seed % 3)
    rnd = random.Random(seed)
    for _ in range(120):
        sizes, rows = rnd.choice([[1], [2], [3], [5], [1, 4], [3, 2, 6]]), random_rows(rnd, rnd.randint(1, 150))
        # Keys are independent of each other, so each is cut by its own size.
        groups, begin = [], 0
        for end in range(1, len(rows) + 1):
            if end == len(rows) or rows[end][0] != rows[begin][0]:
                groups += [[begin + i for i in group] for group in cut_groups(rows[begin:end], need_of(rows[begin][0], sizes))]
                begin = end
        edges = [0, *sorted(rnd.choices(range(len(rows) + 1), k=rnd.randint(0, 30))), len(rows)]
        step = rnd.choice([1, 3, 7, 1000])
        slices = [(number, low, high) for number, (low, high) in enumerate(zip(edges, edges[1:]))]
        notes = [r for n, low, high in slices for b in batch_scan.summarise(arrow(rows, low, high, n, step, sizes)) for r in b.to_pylist()]
        entries, marked = entries_in_levels(notes, len(slices)), {}
        for number, low, high in slices:
            if low < high:
                part = pa.Table.from_batches(list(arrow(rows, low, high, number, step, sizes))[::-1])
                entry = pa.Table.from_pylist([entries[number]])
                marked.update({r["uid"]: (r["batch_id"], r["keep"]) for r in batch_scan.mark(part, entry).to_pylist()})
        ids = [{marked[row][0] for row in group} for group in groups]
        assert all(len(found) == 1 for found in ids) and len(set.union(*ids)) == len(groups)
        for group in groups:
            room = need_of(rows[group[0]][0], sizes) * BUFFER_FACTOR
            assert [marked[row][1] for row in group] == [len(group) - i <= room for i in range(len(group))]


def test_ten_thousand_slices_are_chained_by_spark(spark):
    """Notes of 10,000 slices, most of them within one key, composed as tables; a batch may span many slices."""
    rnd, rows = random.Random(11), []
    for number in range(10_000):
        key = "0001" if number < 7000 else f"{1 + (number - 7000) // 50:04d}"
        rows += [(key, number // 300, rnd.random() < 0.004) for _ in range(rnd.randint(1, 3))]
    edges, at = [], 0
    while at < len(rows):
        edges.append(at)
        at += rnd.randint(1, 3)
    edges = [*edges[: 9_999], len(rows)] if len(edges) >= 9_999 else [*edges, *[len(rows)] * (10_001 - len(edges))]
    slices = list(enumerate(zip(edges, edges[1:])))
    notes = [r for n, (low, high) in slices for b in batch_scan.summarise(arrow(rows, low, high, n, 1000, [5])) for r in b.to_pylist()]
    table = spark.createDataFrame(notes, batch_scan.NOTE).repartition(8)
    entries = {row["slice"]: row for row in batch_scan.chain(table, len(slices), lambda level: level.cache()).collect()}
    assert len(entries) == len(notes) > 9_000
    groups = cut_groups(rows, 5)
    starts = {row: group for group in groups for row in group}
    place = {low: n for n, (low, high) in slices if low < high}
    order = sorted(place)
    for low, high in zip(order, [*order[1:], len(rows)]):
        entry, group = entries[place[low]], starts[low]
        open_ = group[0] < low
        assert (entry["size"] > 0) == open_ and (not open_ or entry["alert"] == any(rows[i][2] for i in group if i < low))
        if open_:
            first = max(edge for edge in order if edge <= group[0])
            assert entry["batch_id"] == (place[first] << ROW_BITS) | (group[0] - first)
        last = starts[high - 1]
        assert entry["follow"] == sum(i >= high for i in last)


def test_lines_stay_out_of_the_scan(spark):
    """Neither the sort nor the passes in Python see messages or raw lines, and no driver step depends on their number."""
    rows = [event(seq, f"k{seq % 3}", seq % 7 == 0) for seq in range(50)]
    plan = batches.assign_batches(frame(spark, rows), 3, 40)._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("FlatMapCoGroupsInArrow") :]
    assert "FlatMapCoGroupsInArrow" in plan and "raw#" not in scan and "message#" not in scan


def test_size_and_interval_by_host(spark):
    """Two hosts with limits of their own give what each of them gives alone."""
    rnd, rows = random.Random(4), []
    for seq in range(600):
        rows.append(event(seq, rnd.choice(["a", "b", "unknown"]), rnd.random() < 0.2, arrival=seq, host=rnd.choice(["x", "y"])))
    limit = lambda x, y: F.when(F.col("host") == "x", F.lit(x)).otherwise(F.lit(y))
    found = batches.flush_batches(frame(spark, rows), limit(2, 6), limit(50.0, 7.0)).collect()
    alone = []
    for host, size, interval in (("x", 2, 50), ("y", 6, 7)):
        alone += batches.flush_batches(frame(spark, [row for row in rows if row[0] == host]), size, interval).collect()
    as_text = lambda made: sorted(str((b.host, b.log_id, raws(b), b.flushed_at, b.cause, b["count"])) for b in made)
    assert as_text(found) == as_text(alone)


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_hot_key_over_many_slices(spark, slices):
    """One key holds most rows; the batches are those of the model however the rows are cut."""
    rnd = random.Random(slices)
    rows = []
    for seq in range(1500):
        log_id = "hot" if rnd.random() < 0.8 else f"k{rnd.randint(0, 20)}"
        rows.append(event(seq, log_id, rnd.random() < (0.02 if seq < 700 else 0.5), arrival=seq // 3))
    ordered = sorted(rows, key=lambda r: (r[5], r[10], r[11]))
    groups = cut_groups([(r[5], seconds(r[10]) // 40, r[6]) for r in ordered], 3)
    expected = sorted(
        [ordered[i][8] for i in group][-30:] for group in groups if any(ordered[i][6] for i in group)
    )
    got = batches.flush_batches(frame(spark, rows), 3, 40, slices=slices).collect()
    assert sorted(sorted(raws(b), key=lambda r: int(r[1:])) for b in got) == sorted(
        sorted(e, key=lambda r: int(r[1:])) for e in expected
    )


def test_slices_meet_their_entries_in_many_partitions(spark):
    """A larger input keeps its shuffle partitions apart; a slice and what is open before it still meet in one task."""
    rows = [event(seq, "hot" if seq % 3 else f"k{seq % 20}", seq % 5 == 0) for seq in range(900)]
    ordered = sorted(rows, key=lambda r: (r[5], r[10], r[11]))
    groups = cut_groups([(r[5], seconds(r[10]) // 40, r[6]) for r in ordered], 3)
    expected = sorted(sorted(ordered[i][8] for i in group) for group in groups if any(ordered[i][6] for i in group))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batches.flush_batches(frame(spark, rows), 3, 40, slices=12).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(sorted(raws(b)) for b in got) == expected


def test_interval_only_equals_a_model(spark):
    rnd = random.Random(5)
    rows = [event(s, f"k{rnd.randint(0, 5)}", rnd.random() < 0.1, arrival=s) for s in range(400)]
    open_, emitted = {}, []
    for row in [*rows, None]:
        tick = 10**9 if row is None else seconds(row[10]) // 7
        for key in list(open_):
            if any(r[6] for r in open_[key]) and tick > seconds(open_[key][-1][10]) // 7:
                emitted.append((key, len(open_.pop(key))))
        if row:
            open_.setdefault(row[5], []).append(row)
    got = batches.flush_by_interval(frame(spark, rows), 7).collect()
    assert sorted((r.log_id, r["count"]) for r in got) == sorted(emitted)
    waiting = batches.pending_groups(frame(spark, rows), 7).collect()
    assert sorted((r.log_id, r["count"]) for r in waiting) == sorted((k, len(v)) for k, v in open_.items())
    left = batches.assign_ticks(frame(spark, rows), 7).where(F.col("batch_tick").isNull()).count()
    assert left == sum(len(v) for v in open_.values())
