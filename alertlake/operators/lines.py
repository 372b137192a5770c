"""Filters and projections on raw log lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions import text as tx
from alertlake.functions.patterns import matches_globs
from alertlake.functions.times import split_timestamp_prefix as split_prefix
from alertlake.settings import HostSettings, Settings, per_host


def bare_name(name: Column) -> Column:
    """Container name without its leading slash; only one slash is cut."""
    return F.regexp_replace(name, r"\A/", "")


def with_container_name(raw: DataFrame, name: Column) -> DataFrame:
    return raw.withColumn("container", F.struct(F.col("container.id").alias("id"), name.alias("name")))


def match_containers(raw: DataFrame, patterns) -> DataFrame:
    """Rows whose container name matches one of the globs."""
    name = bare_name(F.col("container.name"))
    return with_container_name(raw.where(matches_globs(name, patterns)), name)


def exclude_container(raw: DataFrame, own_id: str) -> DataFrame:
    """Rows of all containers but one, the monitor itself; rows without an id stay."""
    own_id = own_id.strip()
    if not own_id:
        return raw
    trimmed = tx.trim_space(F.col("container.id"))
    return raw.where(trimmed.isNull() | (trimmed != own_id))


def since_cutoff(raw: DataFrame, started_at: dt.datetime, since_seconds: float = 0) -> DataFrame:
    """Rows from ``since`` before the start on; the cut-off is a whole second."""
    return raw.where(F.col("timestamp") >= F.lit(cutoff(started_at, since_seconds)))


def cutoff(started_at: dt.datetime, since_seconds: float) -> dt.datetime:
    return (started_at - dt.timedelta(seconds=max(since_seconds, 0))).replace(microsecond=0)


def split_timestamp_prefix(raw: DataFrame) -> DataFrame:
    """Move an RFC3339 first word of the line into ``timestamp``, which is NULL when there is none."""
    time, rest = split_prefix(F.col("line"))
    return raw.withColumns({"timestamp": time, "line": rest})


def clip_lines(raw: DataFrame, max_bytes: int = tx.CLIP_BYTES) -> DataFrame:
    return raw.withColumn("line", tx.clip_line(F.col("line"), max_bytes))


def drop_blank_lines(raw: DataFrame) -> DataFrame:
    """Cut carriage returns at the end and drop lines of white space."""
    cut = F.regexp_replace("line", r"\r+\z", "")
    return raw.where(~tx.is_blank(F.col("line"))).withColumn("line", cut)


def host_label(url: Column) -> Column:
    """Short host name of a daemon address."""
    host = tx.trim_space(url)
    ssh = F.regexp_replace(F.regexp_extract(host, r"\Assh://([^/]*)", 1), r"\A@", "")
    return (
        F.when((host == "") | host.startswith("unix://"), F.lit("local"))
        .when(host.startswith("ssh://"), F.when(ssh != "", ssh).otherwise(F.lit("ssh")))
        .otherwise(F.regexp_replace(host, r"\A(?:tcp|https?)://", ""))
    )


def prefix_host(raw: DataFrame, label: Column | None = None) -> DataFrame:
    """Container name as ``label/name``, for jobs over several hosts; apply after the glob match."""
    label = F.col("host") if label is None else label
    return with_container_name(raw, F.concat_ws("/", label, F.col("container.name")))


def debug_lines(raw: DataFrame) -> DataFrame:
    """Printable form of raw rows, for hosts in debug mode: no parsing, no grouping."""
    stamp = F.coalesce("timestamp", F.current_timestamp())
    fraction = F.regexp_replace(F.date_format(stamp, ".SSSSSS"), r"\.?0+\z", "")
    time = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(stamp, "XXX"))
    line = F.format_string("%s [%s] [%s] %s", time, F.col("container.name"), F.col("stream"), F.col("line"))
    return raw.select(line.alias("value"))


def watched_lines(raw: DataFrame, settings: HostSettings, own_id: str = "", many_hosts: bool = False, started_at: dt.datetime | None = None) -> DataFrame:
    """The front of every job: lines of the containers to watch, without the monitor's own, named by host where there are several.

    Lines are cut at the limit. With ``started_at``, lines written before the host's ``since`` are left out; a line without a
    time stays. Hosts without settings, and hosts in debug mode, have no part in the job: see ``debug_lines``.
    """
    name = bare_name(F.col("container.name"))
    watched = per_host(settings, lambda one: F.lit(False) if one.debug else matches_globs(name, one.include_patterns), lambda one: (one.debug, tuple(one.include_patterns)))
    lines = exclude_container(with_container_name(raw.where(watched), name), own_id)
    if started_at is not None:
        start = per_host(settings, lambda one: F.lit(cutoff(started_at, one.seconds("since"))))
        lines = lines.where(F.col("timestamp").isNull() | (F.col("timestamp") >= start))
    lines = clip_lines(lines)
    return prefix_host(lines) if many_hosts else lines


def watched_debug_lines(raw: DataFrame, settings: HostSettings, own_id: str = "", many_hosts: bool = False) -> DataFrame:
    """Printable lines of the hosts in debug mode, of the containers to watch."""
    name = bare_name(F.col("container.name"))
    shown = per_host(settings, lambda one: matches_globs(name, one.include_patterns) if one.debug else F.lit(False), lambda one: (one.debug, tuple(one.include_patterns)))
    lines = exclude_container(with_container_name(raw.where(shown), name), own_id)
    return debug_lines(prefix_host(lines) if many_hosts else lines)


def hosts_without_settings(raw: DataFrame, settings: HostSettings) -> DataFrame:
    """(host, lines) of the hosts that no settings name: their lines are in no other result."""
    missing = F.lit(False) if isinstance(settings, Settings) else ~F.coalesce(F.col("host").isin(list(settings)), F.lit(False))
    return raw.where(missing).groupBy("host").agg(F.count("*").alias("lines"))
