import pytest

from alertlake.settings import Settings, SettingsError, duplicate_hosts, resolve_host_settings, resolve_hosts


def test_overrides_replace_lists_whole():
    base = Settings(level_regexps=["a", "b"], flush_size=7)
    first, second = resolve_hosts(base, ["tcp://one", {"host": " tcp://two ", "level_regexps": ["c"], "flush_size": 3, "debug": True}])
    assert (first.host, first.level_regexps, first.flush_size, first.debug) == ("tcp://one", ("a", "b"), 7, False)
    assert (second.host, second.level_regexps, second.flush_size, second.debug) == ("tcp://two", ("c",), 3, True)


def test_default_host():
    assert [s.host for s in resolve_hosts(Settings())] == [""]


@pytest.mark.parametrize(
    "values",
    [
        {"flush_size": 0}, {"max_events": 0}, {"flush_interval": "soon"}, {"since": ""}, {"backfill_threshold": "-5m"},
        {"unknown_log_id": ""}, {"output_dir": ""}, {"include_patterns": []}, {"secret": "s"}, {"webhook_url": "ftp://x"},
        {"webhook_url": "https://"}, {"no_such": 1},
    ],
)
def test_invalid_settings(values):
    with pytest.raises(SettingsError):
        resolve_hosts(Settings(), [{"host": "h", **values}])


def test_duplicate_hosts(spark):
    with pytest.raises(SettingsError):
        resolve_hosts(Settings(), ["a", " a"])
    table = spark.createDataFrame([("a",), (" a",), ("b",)], "host string")
    assert [r.host for r in duplicate_hosts(table).collect()] == ["a"]


def test_blank_replay_settings_read_as_zero():
    assert Settings(backfill_threshold=" ").seconds("backfill_threshold") == 0


def test_settings_table(spark):
    table = spark.createDataFrame([("a", 3), ("b", None)], "host string, flush_size int")
    rows = {r.host: r.flush_size for r in resolve_host_settings(table, Settings(), ["flush_size"]).collect()}
    assert rows == {"a": 3, "b": 20}
