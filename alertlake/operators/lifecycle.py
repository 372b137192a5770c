"""Container lifecycle events to sessions: which container was watched under which name, and when."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.patterns import matches_globs
from alertlake.functions.text import trim_space
from alertlake.operators.lines import bare_name
from alertlake.plans.slices import SLICE, KeyWindow

# Actions that open and close a log stream, and states that count as alive.
OPENING = ["start", "restart", "unpause", "rename"]
CLOSING = ["die", "stop", "destroy"]
LIVE_STATES = ["running", "restarting", "created", "paused"]

ORDER = ["ts", "seq"]


def normalize_container_events(events: DataFrame, own_id: str = "") -> DataFrame:
    """Id, name and action of each event; events of the monitor's own container are left out."""
    event_id, actor = F.coalesce("id", F.lit("")), F.coalesce(F.col("Actor.ID"), F.lit(""))
    rows = events.select(
        "host",
        "ts",
        "seq",
        F.col("Action").alias("action"),
        F.when(trim_space(event_id) != "", event_id).otherwise(trim_space(actor)).alias("id"),
        F.coalesce(bare_name(F.col("Actor.Attributes")["name"]), F.lit("")).alias("name"),
    )
    own_id = own_id.strip()
    return rows.where(trim_space(F.col("id")) != own_id) if own_id else rows


def slot_changes(events: DataFrame, patterns) -> tuple[DataFrame, KeyWindow]:
    """Changes of what is watched under each name: ``holder`` is the container id from then on, NULL for none.

    With them comes the window over names, and the rows keep their slices for it.

    A name is a slot. Opening a container puts its id into the slot of its name, also over another id. Closing it
    empties the slot of its last name, and so does opening it under another name.
    """
    watched = (F.col("name") != "") & matches_globs(F.col("name"), patterns)
    opens = watched & F.col("action").isin(OPENING) & (trim_space(F.col("id")) != "")
    closes = F.col("action").isin(CLOSING) | (~watched & (F.col("action") == "rename"))
    rows = events.where(opens | closes).withColumn("opens", opens)

    named = KeyWindow(["host", "id"], ORDER).last(rows, F.when(F.col("opens"), F.col("name")), "old_name")
    enters = F.when(F.col("opens"), F.struct(F.col("name").alias("name"), F.lit(True).alias("enters")))
    moved = F.col("old_name").isNotNull() & (~F.col("opens") | (F.col("old_name") != F.col("name")))
    leaves = F.when(moved, F.struct(F.col("old_name").alias("name"), F.lit(False).alias("enters")))
    slots = named.select("host", "ts", "seq", "id", F.inline(F.array_compact(F.array(enters, leaves))))

    by_name = KeyWindow(["host", "name"], ORDER)
    held = by_name.last(slots, F.when(F.col("enters"), F.col("id")), "newest", including=True)
    # Leaving counts only for the container that entered last.
    effective = held.where(F.col("enters") | (F.col("id") == F.col("newest")))
    state = effective.withColumn("holder", F.when(F.col("enters"), F.col("id")))
    steps = by_name.last(state, F.struct("holder"), "previous")
    changed = F.col("previous").isNull() | ~F.col("previous.holder").eqNullSafe(F.col("holder"))
    changes = steps.where(changed).select(
        "host", "name", "ts", "seq", "holder", F.col("previous.holder").alias("old_holder"), SLICE
    )
    return changes, by_name


def container_sessions(events: DataFrame, patterns) -> DataFrame:
    """``[start_ts, end_ts)`` of every watched stream; ``end_ts`` is NULL while it is open.

    ``replaced_by`` is the id that took the name at the end of the session, if one did.
    """
    changes, by_name = slot_changes(events, patterns)
    ended = by_name.next(changes, F.struct("ts", "holder"), "end")
    return ended.where(F.col("holder").isNotNull()).select(
        "host",
        "name",
        F.col("holder").alias("id"),
        F.col("ts").alias("start_ts"),
        F.col("seq").alias("start_seq"),
        F.col("end.ts").alias("end_ts"),
        F.col("end.holder").alias("replaced_by"),
    )


def container_replacements(events: DataFrame, patterns) -> DataFrame:
    """Moments at which a name passed from one container straight to another."""
    changes, _ = slot_changes(events, patterns)
    straight = F.col("old_holder").isNotNull() & F.col("holder").isNotNull()
    return changes.where(straight).select(
        "host", "name", "ts", "seq", F.col("old_holder").alias("old_id"), F.col("holder").alias("new_id")
    )


def container_renames(events: DataFrame, patterns) -> DataFrame:
    """Moments at which a container came back under another name."""
    watched = (F.col("name") != "") & matches_globs(F.col("name"), patterns)
    opens = events.where(watched & F.col("action").isin(OPENING) & (trim_space(F.col("id")) != ""))
    by_id = KeyWindow(["host", "id"], ORDER)
    named = by_id.last(opens, F.col("name"), "old_name")
    return named.where(F.col("old_name") != F.col("name")).select(
        "host", "id", "ts", "seq", "old_name", F.col("name").alias("new_name")
    )


def active_containers(sessions: DataFrame, at: dt.datetime) -> DataFrame:
    """The stream of each name that is open at a moment."""
    moment = F.lit(at)
    live = sessions.where((F.col("start_ts") <= moment) & (F.col("end_ts").isNull() | (F.col("end_ts") > moment)))
    # One slot per name, so this only settles sessions that start and end within the same instant.
    newest = Window.partitionBy("host", "name").orderBy(F.desc("start_ts"), F.desc("start_seq"))
    return live.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def is_live_state(running: Column, restarting: Column, status: Column) -> Column:
    """A container that runs or is about to."""
    return (
        F.coalesce(running, F.lit(False))
        | F.coalesce(restarting, F.lit(False))
        | F.coalesce(F.lower(trim_space(status)).isin(LIVE_STATES), F.lit(False))
    )
