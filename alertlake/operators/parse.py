"""Raw lines to events: JSON or text, level, correlation id, exclusion.

Everything is built-in expressions, so the same code serves static and streaming input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions import text as tx
from alertlake.functions.json import ci_get, json_object, leaf_texts, lower_keys
from alertlake.functions.patterns import any_match, compile_patterns
from alertlake.functions.times import json_time
from alertlake.plans.once import compute_once
from alertlake.settings import BARE_LEVEL_REGEXPS, MESSAGE_FIELDS, TIME_FIELDS, HostSettings, Settings, per_host


def clean_keys(keys) -> list[str]:
    return [key.strip().lower() for key in keys if key.strip()]


class LineParser:
    """Column expressions of one set of filter settings; patterns are checked when it is made."""

    def __init__(self, settings: Settings):
        self.unknown = settings.unknown_log_id
        self.levels = compile_patterns(settings.level_regexps or BARE_LEVEL_REGEXPS)
        self.excludes = compile_patterns(settings.exclude_regexps)
        self.ids = compile_patterns(settings.log_id_regexps)
        self.level_fields = clean_keys(settings.level_fields)
        self.message_fields = clean_keys(settings.message_fields) or list(MESSAGE_FIELDS)
        self.time_fields = clean_keys(settings.time_fields) or list(TIME_FIELDS)
        self.id_keys = clean_keys(settings.log_id_keys)

    def message(self, fields: Column, line: Column) -> Column:
        return tx.first_of([tx.non_empty(ci_get(fields, key)) for key in self.message_fields], line)

    def time(self, fields: Column, line: Column, arrival: Column) -> Column:
        return F.coalesce(*[json_time(ci_get(fields, key), line, key) for key in self.time_fields], arrival)

    def json_level(self, fields: Column) -> Column:
        return tx.first_of([tx.first_group(tx.trim_space(ci_get(fields, key)), self.levels) for key in self.level_fields])

    def level(self, fields: Column, line: Column) -> Column:
        return F.coalesce(self.json_level(fields), tx.first_group(line, self.levels))

    def json_id(self, fields: Column) -> Column:
        return tx.first_of([tx.non_blank(ci_get(fields, key)) for key in self.id_keys])

    def log_id(self, given: Column, message: Column, line: Column) -> Column:
        from_line = F.when(message != line, tx.first_capture(line, self.ids))
        known = F.when(given != self.unknown, given)
        return F.coalesce(known, tx.first_capture(message, self.ids), from_line, F.lit(self.unknown))

    def excluded(self, fields: Column, message: Column, line: Column) -> Column:
        """A pattern found in the message, the line, or any scalar value of a JSON line."""
        if not self.excludes:
            return F.lit(False)
        deep = F.exists(leaf_texts(line), lambda leaf: any_match(leaf, self.excludes))
        shallow = any_match(message, self.excludes) | any_match(line, self.excludes)
        return shallow | (fields.isNotNull() & F.coalesce(deep, F.lit(False)))


def parse_lines(raw: DataFrame, settings: HostSettings) -> DataFrame:
    """Every non-blank line with its parsed columns, nothing dropped yet."""
    pick = _per_host(settings)
    line, fields, message = F.col("line"), F.col("fields"), F.col("message")
    trimmed = raw.withColumn("line", tx.trim_space(line)).where(line != "")
    # One step per level of reuse: Catalyst keeps steps apart whose results are read more than once.
    with_fields = trimmed.withColumn("fields", json_object(line)).withColumn("fields", lower_keys(fields))
    with_message = with_fields.withColumns(
        {"message": pick(lambda p: p.message(fields, line)), "json_id": pick(lambda p: p.json_id(fields))}
    )
    return with_message.withColumns(
        {
            "event_ts": pick(lambda p: p.time(fields, line, F.col("timestamp"))),
            "level": pick(lambda p: p.level(fields, line)),
            "log_id": pick(lambda p: p.log_id(F.col("json_id"), message, line)),
            "excluded": pick(lambda p: p.excluded(fields, message, line)),
            "unknown_log_id": pick(lambda p: F.lit(p.unknown)),
        }
    )


def parse_events(raw: DataFrame, settings: HostSettings) -> DataFrame:
    """Relevant events: not excluded, and with an alert level or a correlation id.

    ``settings`` is one set for all rows or one per host; rows of a host without settings are dropped.
    """
    parsed = parse_lines(raw, settings)
    columns = {
        "host": F.col("host"),
        "timestamp": F.col("event_ts"),
        "container": F.col("container"),
        "stream": F.col("stream"),
        "level": F.coalesce("level", F.lit("")),
        "log_id": F.col("log_id"),
        "alert_matched": F.col("level").isNotNull(),
        "message": F.col("message"),
        "raw": F.col("line"),
        "parsed_from_json": F.col("fields").isNotNull(),
        "ingest_ts": F.col("ingest_ts"),
        "seq": F.col("seq"),
        "unknown_log_id": F.col("unknown_log_id"),
        "excluded": F.col("excluded"),
    }
    events = compute_once(parsed, columns, keep=[])
    relevant = F.col("alert_matched") | (F.col("log_id") != F.col("unknown_log_id"))
    return events.where(~F.col("excluded") & relevant).drop("excluded")


def _per_host(settings: HostSettings) -> Callable[[Callable[[LineParser], Column]], Column]:
    parsers: dict[tuple, LineParser] = {}

    def depends(one: Settings) -> tuple:
        return (
            one.unknown_log_id, one.level_regexps, one.exclude_regexps, one.log_id_regexps, one.level_fields,
            one.message_fields, one.time_fields, one.log_id_keys,
        )

    def parser(one: Settings) -> LineParser:
        key = depends(one)
        if key not in parsers:
            parsers[key] = LineParser(one)
        return parsers[key]

    return lambda build: per_host(settings, lambda one: build(parser(one)), depends)
