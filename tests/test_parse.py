import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertlake.functions.json import json_object, leaf_texts
from alertlake.functions.patterns import PatternError
from alertlake.functions.times import duration_text, parse_duration, parse_time_string
from alertlake.operators.parse import parse_events
from alertlake.schema import RAW_LOG
from alertlake.settings import Settings

NOW = dt.datetime(2026, 3, 24, 11, 0)
WARN = {"level_regexps": [r"(?i)\b(WARN|ERROR)\b"], "log_id_keys": ["log_id"]}


def parse(spark, line, **values):
    row = ("h", ("c1", "app"), "stdout", line, NOW, NOW, 1)
    found = parse_events(spark.createDataFrame([row], RAW_LOG), Settings(**values)).collect()
    return found[0] if found else None


def test_json_line(spark):
    line = '{"time":"2026-03-24T10:20:30Z","level":"WARN","log_id":"shard-7","message":"cache shard evicts early"}'
    event = parse(spark, line, level_regexps=[r"(?i)\b(WARN)\b"], log_id_keys=["log_id"])
    assert (event.log_id, event.level, event.alert_matched, event.message) == ("shard-7", "WARN", True, "cache shard evicts early")
    assert event.timestamp == dt.datetime(2026, 3, 24, 10, 20, 30) and event.parsed_from_json and event.raw == line


def test_text_line(spark):
    event = parse(spark, "2026-03-24 10:20:30 WARN lease renewal is slow log_id=lease-9")
    assert (event.log_id, event.level, event.parsed_from_json) == ("lease-9", "WARN", False)
    assert event.timestamp == NOW


def test_context_line_is_kept(spark):
    line = '{"time":"2026-03-24T10:20:30Z","level":"INFO","id":"basket-5","message":"basket opened"}'
    event = parse(spark, line, log_id_keys=["id"])
    assert (event.log_id, event.alert_matched) == ("basket-5", False)


@pytest.mark.parametrize(
    "line, exclude",
    [
        ("INFO service healthy", None),
        ("   ", None),
        ("2026-03-24 10:20:30 WARN lease renewal is slow IGNORE_ME log_id=lease-9", "(?i)IGNORE_ME"),
        ('{"level":"ERROR","log_id":"fault-3","message":"IGNORE_ME parcel was not shipped"}', "(?i)IGNORE_ME"),
        ("2026-03-24 10:20:30 WARN waited timeout=77ms log_id=lease-9", r"timeout=\d+ms"),
        ('{"level":"ERROR","log_id":"fault-3","message":"the deadline has long been exceeded"}', "(?i)deadline.*exceeded"),
        (r'{"level":"ERROR","log_id":"fault-3","error":{"message":"\u0055nauthorized"}}', r"(?i)\bUnauthorized\b"),
        (r'{"level":"ERROR","log_id":"e","a":[1,{"b":[true,42.5]}]}', r"\A42\.5\z"),
    ],
)
def test_dropped_lines(spark, line, exclude):
    assert parse(spark, line, exclude_regexps=[exclude] if exclude else [], **WARN) is None


def test_keys_are_not_excluded(spark):
    line = '{"level":"ERROR","log_id":"e","zap":{"zap" : "no"}}'
    assert parse(spark, line, exclude_regexps=[r"\Azap\z"], **WARN).log_id == "e"


def test_field_lookups(spark):
    event = parse(spark, '{"LEVEL":" warn ","LogID":" x ","Msg":"m","MESSAGE":"","ts":1711275630.9}', log_id_keys=["logid"])
    assert (event.level, event.log_id, event.message) == ("WARN", "x", "m")
    assert event.timestamp == dt.datetime(2024, 3, 24, 10, 20, 30)
    twice = parse(spark, '{"level":"INFO","Level":"ERROR","log_id":null,"trace_id":7}')
    assert (twice.level, twice.log_id) == ("ERROR", "7")


def test_bad_times_fall_back_to_arrival(spark):
    for value in ('"2026-03-24"', '"10:20:30"', '"1711275630.5"', "null", "{}", "99999999999999999"):
        assert parse(spark, '{"level":"WARN","ts":%s}' % value).timestamp == NOW


def test_unknown_id_in_json_is_searched_in_text(spark):
    assert parse(spark, '{"log_id":"unknown","message":"trace_id=t-9"}').log_id == "t-9"
    assert parse(spark, '{"log_id":"unknown","level":"WARN"}').log_id == "unknown"


def test_invalid_pattern(spark):
    with pytest.raises(PatternError):
        parse(spark, "x", exclude_regexps=["("])


def test_strict_json(spark):
    lines = ['{"a":1}', '{"a":1} x', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', "[1]", "null", '{"a":{"b":[1,"x"]}}', "{}"]
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, t string")
    valid = {r.i for r in frame.where(json_object(F.col("t")).isNotNull()).collect()}
    assert valid == {0, 7, 8}


def test_leaf_texts(spark):
    text = r'{"k\"1": "v:\n1", "b": [true, null, -1.5e3, "x\\"], "c": {"d": ""}}'
    row = spark.createDataFrame([(text,)], "t string").select(leaf_texts(F.col("t"))).first()[0]
    assert row == ["v:\n1", "true", "-1.5e3", "x\\", ""]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-03-24T10:20:30+08:00", dt.datetime(2026, 3, 24, 2, 20, 30)),
        ("2026-03-24 10:20:30", dt.datetime(2026, 3, 24, 10, 20, 30)),
        ("2026-03-24T10:20:30.123456789Z", dt.datetime(2026, 3, 24, 10, 20, 30, 123456)),
        ("1711275630", dt.datetime(2024, 3, 24, 10, 20, 30)),
        ("2026-13-24 10:20:30", None),
        ("2026-03-24", None),
        ("soon", None),
    ],
)
def test_time_strings(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(parse_time_string(F.col("t"))).first()
    assert row[0] == expected


def test_durations(spark):
    assert [parse_duration(t) for t in ("0s", "1h30m", "500ms", "-1.5h", "0")] == [0, 5400, 0.5, -5400, 0]
    for bad in ("", "5", "m", "1x"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    row = spark.range(1).select(*[duration_text(F.lit(s)) for s in (5, 65, 21600, 3725)]).first()
    assert list(row) == ["5s", "1m5s", "6h0m0s", "1h2m5s"]


@pytest.mark.parametrize(
    "line, seconds",
    [
        ('{"meta":{"ts":5},"ts":"12.5"}', None),
        ('{"meta":{"ts":"5"},"Ts":12.5}', 12),
        ('{"ts":"7","TS":12.75}', 12),
        ('{"ts":1.2e3}', 1200),
        ('{"ts":"12"}', 12),
        ('{"ts":12}', 12),
    ],
)
def test_only_a_number_of_the_line_itself_is_a_time_with_a_fraction(spark, line, seconds):
    from alertlake.functions.json import ci_get, json_object, lower_keys
    from alertlake.functions.times import json_time

    row = spark.createDataFrame([(line,)], "line string").select(F.unix_seconds(json_time(ci_get(lower_keys(json_object(F.col("line"))), "ts"), F.col("line"), "ts")))
    assert row.first()[0] == seconds
