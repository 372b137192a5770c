"""Settings of the alert job, with overrides per host."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.times import parse_duration


class SettingsError(ValueError):
    """A setting that the engine refuses."""


# The defaults of the reference.
LEVEL_REGEXPS = (r"(?i)\b(WARN|ERROR)\b",)
LEVEL_FIELDS = ("level", "severity")
MESSAGE_FIELDS = ("message", "msg", "log")
TIME_FIELDS = ("time", "timestamp", "@timestamp", "ts")
LOG_ID_KEYS = ("log_id", "logId", "alert_id", "alertId", "trace_id", "traceId")
LOG_ID_REGEXPS = (
    r"""(?i)\blog[_-]?id["'=:\s]+([A-Za-z0-9._:-]+)""",
    r"""(?i)\balert[_-]?id["'=:\s]+([A-Za-z0-9._:-]+)""",
    r"""(?i)\btrace[_-]?id["'=:\s]+([A-Za-z0-9._:-]+)""",
)
# Used when a list is given but empty.
BARE_LEVEL_REGEXPS = (r"(?i)\bWARN\b",)


@dataclass(frozen=True)
class Settings:
    """All knobs of one host. Lists are tuples so that equal settings can be recognised as equal."""

    host: str = ""
    include_patterns: Sequence[str] = ("*",)
    since: str = "0s"
    debug: bool = False
    level_regexps: Sequence[str] = LEVEL_REGEXPS
    exclude_regexps: Sequence[str] = ()
    level_fields: Sequence[str] = LEVEL_FIELDS
    message_fields: Sequence[str] = MESSAGE_FIELDS
    time_fields: Sequence[str] = TIME_FIELDS
    log_id_keys: Sequence[str] = LOG_ID_KEYS
    log_id_regexps: Sequence[str] = LOG_ID_REGEXPS
    flush_size: int = 20
    flush_interval: str = "10s"
    unknown_log_id: str = "unknown"
    backfill_threshold: str = "5m"
    backfill_max_duration: str = "30m"
    webhook_url: str = ""
    secret: str = ""
    at_all: bool = False
    at_mobiles: Sequence[str] = ()
    mention_levels: Sequence[str] = ("ERROR",)
    max_events: int = 5
    output_dir: str = "data"

    def __post_init__(self):
        for name, value in vars(self).items():
            if isinstance(value, list):
                object.__setattr__(self, name, tuple(value))

    def override(self, values: Mapping) -> Settings:
        """Every key present replaces the default; lists are replaced whole."""
        known = {item.name for item in fields(self)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise SettingsError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{key: value for key, value in values.items() if value is not None})

    def seconds(self, name: str) -> float:
        """A duration setting in seconds; the two replay settings may be blank, which reads as 0."""
        text = str(getattr(self, name))
        if name.startswith("backfill"):
            text = text.strip() or "0"
        try:
            return parse_duration(text)
        except ValueError as error:
            raise SettingsError(f"{name}: {error}") from error

    def validate(self) -> Settings:
        """The set itself, if it satisfies all rules; an error names every rule that it breaks."""
        broken = [f"{name} should be {text}" for name, holds, text in RULES if not holds(self)]
        if broken:
            raise SettingsError("; ".join(broken))
        return self


def is_web_address(text: str) -> bool:
    parts = urlparse(text)
    return parts.scheme in ("http", "https") and parts.netloc.strip() != ""


# Setting, test, and what it should be. A duration that cannot be read is an error of its own.
RULES: Sequence[tuple[str, Callable[[Settings], bool], str]] = (
    ("flush_interval", lambda s: s.seconds("flush_interval") is not None, "a duration"),
    ("since", lambda s: s.seconds("since") is not None, "a duration"),
    ("backfill_max_duration", lambda s: s.seconds("backfill_max_duration") >= 0, "a duration of 0 or longer"),
    ("backfill_threshold", lambda s: s.seconds("backfill_threshold") >= 0, "a duration of 0 or longer"),
    ("flush_size", lambda s: s.flush_size >= 1, "1 or more"),
    ("max_events", lambda s: s.max_events >= 1, "1 or more"),
    ("include_patterns", lambda s: len(s.include_patterns) > 0, "a list of one glob or more"),
    ("unknown_log_id", lambda s: s.unknown_log_id != "", "a text"),
    ("output_dir", lambda s: s.output_dir != "", "a folder"),
    ("webhook_url", lambda s: not s.webhook_url.strip() or is_web_address(s.webhook_url.strip()), "blank, or a web address with a host"),
    ("secret", lambda s: not s.secret.strip() or bool(s.webhook_url.strip()), "blank where there is no webhook"),
)


# One set for all hosts, or one per host.
HostSettings = Settings | Mapping[str, Settings]


def each_setting(settings: HostSettings) -> list[Settings]:
    return [settings] if isinstance(settings, Settings) else list(settings.values())


def per_host(settings: HostSettings, build: Callable[[Settings], Column], same: Callable[[Settings], object] | None = None, host: str = "host") -> Column:
    """An expression that depends on the settings of the row's host; NULL for a host without settings.

    Hosts are put together where the expressions are the same: ``same`` names what an expression depends on, by default its text.
    """
    if isinstance(settings, Settings):
        return build(settings)
    groups: dict[object, tuple[Column, list[str]]] = {}
    for name, one in settings.items():
        made = build(one) if same is None else None
        key = str(made) if same is None else same(one)
        if key not in groups:
            groups[key] = (build(one) if made is None else made, [])
        groups[key][1].append(name)
    chosen = F
    for made, names in groups.values():
        chosen = chosen.when(F.col(host).isin(names), made)
    return chosen


def output_folders(settings: HostSettings) -> list[tuple[str, list[str] | None]]:
    """Every output folder with the hosts that write to it; None stands for all hosts."""
    if isinstance(settings, Settings):
        return [(settings.output_dir, None)]
    folders: dict[str, list[str]] = {}
    for host, one in settings.items():
        folders.setdefault(one.output_dir, []).append(host)
    return [(path, None if len(folders) == 1 else hosts) for path, hosts in folders.items()]


def resolve_hosts(defaults: Settings, hosts: Sequence[str | Mapping] = ()) -> list[Settings]:
    """Settings of every host: an entry is a host name or a mapping with a ``host`` key and overrides."""
    resolved, seen = [], set()
    for entry in hosts or [{"host": defaults.host}]:
        values = {"host": entry} if isinstance(entry, str) else dict(entry)
        values["host"] = str(values.get("host", "")).strip()
        name = values["host"] or "local"
        if values["host"] in seen:
            raise SettingsError(f"duplicate host {name!r}")
        seen.add(values["host"])
        try:
            resolved.append(defaults.override(values).validate())
        except SettingsError as error:
            raise SettingsError(f"host {name!r}: {error}") from error
    return resolved


def resolve_host_settings(overrides: DataFrame, defaults: Settings, names: Sequence[str]) -> DataFrame:
    """Scalar settings as a table: the override of a host where given, else the default."""
    columns = [F.coalesce(F.col(name), F.lit(getattr(defaults, name))).alias(name) for name in names]
    return overrides.select("host", *columns)


def duplicate_hosts(overrides: DataFrame) -> DataFrame:
    """Hosts configured more than once; must be empty."""
    return overrides.groupBy(F.trim("host").alias("host")).count().where("count > 1")


def apply_host_settings(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Give each row the settings of its host. Small settings tables are broadcast by their measured size."""
    return rows.join(settings, "host", "left")
