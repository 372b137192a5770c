"""Shapes of plans that matter at scale, and the composed job."""

import re

from pyspark.sql import functions as F

from alertlake import fixtures
from alertlake.catalog import queries as q
from alertlake.operators import batches, lines, parse
from alertlake.plans.alerts import run_alerts, run_probe_report
from alertlake.plans.slices import row_positions
from alertlake.settings import Settings

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def stored_raw(spark, tmp_path):
    path = str(tmp_path / "raw")
    fixtures.raw_logs(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_parsing_reads_each_line_once(spark, tmp_path):
    text = plan(parse.parse_events(stored_raw(spark, tmp_path), q.SETTINGS))
    assert "Exchange" not in text and "Python" not in text
    assert len(re.findall(r"^.*Generate inline", text, re.M)) == 1
    below = text[text.index("Generate inline") :]
    filters = [line for line in below.splitlines() if "Filter" in line]
    assert not any("from_json" in line for line in filters)


def test_container_filter_reads_only_needed_columns(spark, tmp_path):
    raw = stored_raw(spark, tmp_path)
    text = plan(lines.since_cutoff(raw, q.dt.datetime(2024, 1, 5, tzinfo=q.UTC)).select("seq"))
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in text
    assert "ReadSchema: struct<timestamp:timestamp,seq:bigint>" in text


def test_rank_limit_runs_before_the_shuffle(spark, tmp_path):
    events = parse.parse_events(stored_raw(spark, tmp_path), Settings())
    text = plan(batches.keep_last(events, 20))
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


def test_ticks_are_reduced_before_any_window(spark, tmp_path):
    events = parse.parse_events(stored_raw(spark, tmp_path), Settings())
    text = plan(batches.flush_by_interval(events, 10))
    assert text.index("Window [") < text.rindex("HashAggregate") and "partial_bool_or" in text.replace("partial_max", "partial_bool_or")


def test_positions_over_slices(spark):
    frame = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") * 7 % 1000).alias("value"))
    assert row_positions(frame, ["key"], ["value"], "place").where("place <> value + 1").count() == 0


def test_whole_job(spark, tmp_path):
    raw = stored_raw(spark, tmp_path)
    settings = Settings(flush_size=3, flush_interval="48h", backfill_threshold="6h", at_all=True, webhook_url="https://hook")
    tables = run_alerts(raw, settings, status=fixtures.status(spark, SF))
    kinds = {r.k: r.n for r in tables.batches.groupBy(F.col("log_id").startswith("monitor.").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert kinds[True] > 0 and kinds[False] > 0
    sent = tables.messages
    assert sent.where("send_at < arrival").count() == 0 and sent.where("payload IS NULL").count() == 0
    gaps = sent.select((F.unix_micros("send_at") - F.unix_micros("arrival")).alias("wait"), "place")
    assert gaps.count() == sent.agg(F.max("place")).first()[0]
    assert run_probe_report(tables.events).count() > 0
