"""Time texts found in log lines and in settings."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed forms of a time text. A bare cast would accept far more (`2026`, `10:20:30`).
RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
LOCAL_TIME = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?\z"
WHOLE_NUMBER = r"\A[+-]?\d{1,18}\z"
FRACTION = r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"

# Seconds of 0001-01-01 and 9999-12-31: outside of them a number is no printable time.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799

DURATION_UNITS = {
    "ns": Fraction(1, 10**9), "us": Fraction(1, 10**6), "µs": Fraction(1, 10**6), "ms": Fraction(1, 1000),
    "s": Fraction(1), "m": Fraction(60), "h": Fraction(3600),
}


def rfc3339_time(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def epoch_time(seconds: Column) -> Column:
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(seconds))


def parse_time_string(text: Column) -> Column:
    """RFC3339, then a local time in the session zone, then whole seconds since 1970; else NULL."""
    local = F.when(text.rlike(LOCAL_TIME), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    whole = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
    return F.coalesce(rfc3339_time(text), local, epoch_time(whole))


def json_time(value: Column, line: Column, key: str) -> Column:
    """Time of a JSON field: a text as above, or a number of seconds whose fraction is cut."""
    # A number with a fraction counts, a text that looks like one does not: only then is the type of the field looked up.
    looks = value.rlike(FRACTION) & ~value.rlike(WHOLE_NUMBER)
    seconds = F.when(looks & is_json_number(line, key), value.try_cast("double").try_cast("bigint"))
    return F.when(value.isNotNull(), F.coalesce(parse_time_string(value), epoch_time(seconds)))


def is_json_number(line: Column, key: str) -> Column:
    """Whether a field of a JSON object, by a name in any case, is a number; of several such fields the last counts."""
    fields = F.map_entries(F.from_json(line, "map<string,variant>"))
    field = F.try_element_at(F.filter(fields, lambda entry: F.lower(entry["key"]) == key.lower()), F.lit(-1))
    return F.coalesce(F.schema_of_variant(field["value"]) != "STRING", F.lit(False))


def split_timestamp_prefix(line: Column) -> tuple[Column, Column]:
    """(time, rest): the first word is cut off only when it is an RFC3339 time."""
    word = F.regexp_extract(line, r"\A([^ ]*) ", 1)
    time = rfc3339_time(word)
    rest = F.when(time.isNotNull(), F.regexp_replace(line, r"\A[^ ]* ", "")).otherwise(line)
    return time, rest


def parse_duration(text: str) -> float:
    """Seconds of a duration such as ``1h30m``, ``10s``, ``-1.5h`` or ``0``."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return 0.0
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(number + unit for number, unit in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    return float(sign * sum(Fraction(number) * DURATION_UNITS[unit] for number, unit in parts))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``1h2m3s``, leading zero units left out."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    large = (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.lit(""))
    )
    return F.concat(large, rest.cast("bigint").cast("string"), F.lit("s"))
