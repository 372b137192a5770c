import random

import pytest
from test_batches import SCHEMA, event
from test_stream import comparable

from alertlake.operators.batches import flush_batches
from alertlake.plans import slices
from alertlake.streaming import commits


@pytest.mark.parametrize("size", [1, 3])
def test_commits_equal_one_run(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = []
    for seq in range(300):
        log_id = rnd.choice(["hot", "hot", "hot", "k1", "k2", "unknown"])
        alert = log_id == "unknown" or rnd.random() < (0.02 if seq < 200 else 0.3)
        rows.append(event(seq, log_id, alert, at=seq + rnd.randint(-3, 3), arrival=seq // 2, container=f"app-{seq // 50}"))
    state, got = str(tmp_path / "state"), []
    parts = [rows[:90], rows[90:91], rows[91:200], rows[200:]]
    for commit, part in enumerate(parts):
        for _ in range(2 if commit == 2 else 1):
            made = commits.group_commit(spark.createDataFrame(part, SCHEMA), commit, state, size, 20).collect()
        got += made
    got += commits.final_flush(spark, len(parts) - 1, state).collect()
    assert comparable(got) == comparable(flush_batches(spark.createDataFrame(rows, SCHEMA), size, 20).collect())
    assert max(r["count"] for r in got) == (10 if size == 1 else 30)


def test_commits_of_many_slices_in_many_partitions(spark, tmp_path, monkeypatch):
    """A larger commit keeps its shuffle partitions apart; each slice still meets what is open before it."""
    rows = [event(seq, "hot" if seq % 3 else f"k{seq % 20}", seq % 5 == 0) for seq in range(600)]
    expected = comparable(flush_batches(spark.createDataFrame(rows, SCHEMA), 3, 40).collect())
    monkeypatch.setattr(slices, "SMALL_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    state, got = str(tmp_path / "state"), []
    try:
        for commit, part in enumerate([rows[:330], rows[330:]]):
            got += commits.group_commit(spark.createDataFrame(part, SCHEMA), commit, state, 3, 40).collect()
        got += commits.final_flush(spark, 1, state).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert comparable(got) == expected


def test_grouping_sink_on_a_stream(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.createDataFrame([event(1, "a", True), event(2, "a", False), event(3, "b", False)], SCHEMA).write.parquet(folder)
    sink = commits.grouping_sink(str(tmp_path / "state"), 2, 20, lambda rows, commit: seen.append((commit, rows.count())))
    query = (
        spark.readStream.schema(SCHEMA).parquet(folder).writeStream.foreachBatch(sink)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert seen == [(0, 1)]
