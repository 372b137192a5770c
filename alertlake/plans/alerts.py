"""The alert job over landed logs, composed from the operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.operators.backfill import backfill_summary, backfill_windows, mark_suppressed, merge_windows
from alertlake.operators.batches import flush_batches
from alertlake.operators.health import health_batches, health_transitions
from alertlake.operators.lines import prefix_host, watched_lines
from alertlake.operators.notify import notifications, send_schedule
from alertlake.operators.parse import parse_events
from alertlake.operators.probes import DEFAULT_PATHS, probe_hits, probe_stats, rank_probes
from alertlake.plans.slices import checkpointed
from alertlake.settings import HostSettings, per_host


@dataclass
class AlertTables:
    """Results of one run over landed logs."""

    events: DataFrame
    batches: DataFrame
    messages: DataFrame


def host_limits(settings: HostSettings) -> tuple[Column, Column]:
    """Batch size and interval in seconds: of the one set of settings, or by host."""
    return per_host(settings, lambda one: F.lit(one.flush_size)), per_host(settings, lambda one: F.lit(float(one.seconds("flush_interval"))))


def replay_limits(settings: HostSettings) -> tuple[Column, Column]:
    """Threshold and longest duration of a replay, in seconds."""
    names = ("backfill_threshold", "backfill_max_duration")
    return tuple(per_host(settings, lambda one, name=name: F.lit(float(one.seconds(name)))) for name in names)


def run_alerts(
    raw: DataFrame,
    settings: HostSettings,
    own_id: str = "",
    many_hosts: bool = True,
    status: DataFrame | None = None,
    started_at: dt.datetime | None = None,
) -> AlertTables:
    """Raw lines to stored batches and scheduled messages, with one set of settings or one per host.

    What is read several times is stored once: events (to sample, to sort, to count) and batches (to file, to notify,
    to measure the queue).
    """
    lines = watched_lines(raw, settings, own_id, started_at=started_at)
    events = checkpointed(parse_events(prefix_host(lines) if many_hosts else lines, settings))
    windows = merge_windows(backfill_windows(lines, *replay_limits(settings)))
    batches = flush_batches(events, *host_limits(settings)).drop("cause")
    every = mark_suppressed(batches, windows).unionByName(backfill_summary(events, windows))
    if status is not None:
        every = every.unionByName(health_batches(health_transitions(status)))
    stored = checkpointed(every)
    messages = notifications(stored, settings)
    order = ["arrival", "host", "log_id", "first_seen", "part"]
    return AlertTables(events, stored, send_schedule(messages, ["webhook"], order))


def run_probe_report(events: DataFrame, paths=DEFAULT_PATHS) -> DataFrame:
    """Clients per path, ranked, from rows of events."""
    return rank_probes(probe_stats(probe_hits(events, paths)), paths)
