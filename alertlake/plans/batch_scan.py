"""The scan that finds batch starts in sorted event rows, run inside the tasks of ``assign_batches``.

The first pass reads one slice of the rows as a stream of Arrow batches and notes what the slice makes of every group that may
be open before it: a finite map from open group to open group. Such maps compose, so notes of neighbouring slices make one
note of the same form. ``compose`` does that for up to ``FAN`` of them, level by level, and ``descend`` hands the open group
back down; each step is a small table grouped by its parent, and nothing passes through the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The scan travels with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: a group without an alert holds this many times the batch size.
BUFFER_FACTOR = 10
ROW_BITS = 40
# Notes that one step composes.
FAN = 64

EXIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("size", T.LongType()),
            T.StructField("alert", T.BooleanType()),
            T.StructField("start", T.LongType()),
            T.StructField("head", T.LongType()),
        ]
    )
)
KEY = T.ArrayType(T.StringType())
# Of a slice, or of neighbouring ones. ``start`` names the batch that is open in the end, -1 if it was open before; ``head``
# counts the rows that still belong to the group that was open before.
NOTE = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_key", KEY),
        T.StructField("first_tick", T.LongType()),
        T.StructField("first_need", T.LongType()),
        T.StructField("last_key", KEY),
        T.StructField("last_tick", T.LongType()),
        T.StructField("exits", EXIT),
    ]
)
# The group that is open before a slice, and how many rows after the slice belong to its last batch.
ENTRY = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("alert", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("follow", T.LongType()),
    ]
)
MARKS = T.StructType([T.StructField("uid", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("keep", T.BooleanType())])


@dataclass(frozen=True)
class Group:
    """An open group: rows so far, alert seen, and where it began (-1: before what is looked at)."""

    size: int = 0
    alert: bool = False
    start: int = -1


NOTHING = Group()


class Run:
    """One Arrow batch of sorted rows, reduced to what the scan looks at."""

    def __init__(self, batch: pa.RecordBatch):
        self.rows = batch.num_rows
        columns = [batch.column("host"), batch.column("log_id")]
        self.needs = np.maximum(batch.column("flush_size").to_numpy(zero_copy_only=False).astype(np.int64), 1)
        self.ticks = batch.column("tick").to_numpy(zero_copy_only=False)
        self.alerts = batch.column("alert_matched").to_numpy(zero_copy_only=False).astype(bool)
        self.first_key = [column[0].as_py() for column in columns]
        self.last_key = [column[-1].as_py() for column in columns]
        key_change = np.zeros(self.rows, dtype=bool)
        for column in columns:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            key_change[1:] |= codes[1:] != codes[:-1]
        tick_change = key_change.copy()
        tick_change[1:] |= self.ticks[1:] != self.ticks[:-1]
        self.key_ends, self.tick_ends = _run_ends(key_change), _run_ends(tick_change)
        self.alert_rows = np.flatnonzero(self.alerts)
        changes = np.flatnonzero(key_change)
        self.last_key_row = int(changes[-1]) if len(changes) else 0


def _run_ends(change: np.ndarray) -> np.ndarray:
    """Last row of the run that each row belongs to."""
    starts = np.flatnonzero(change[1:]) + 1
    ends = np.append(starts, len(change)) - 1
    return np.repeat(ends, np.diff(np.append(np.insert(starts, 0, 0), len(change))))


def enough(need: int) -> int:
    """Without an alert, group sizes from here on act alike."""
    return max(need - 1, 1)


def variants(need: int) -> list[Group]:
    """All that matters of a group before a slice whose first key has this batch size."""
    return [Group(size) for size in range(enough(need) + 1)] + [Group(size, True) for size in range(1, need)]


def variant(group: Group, need: int) -> int:
    return enough(need) + group.size if group.alert else min(group.size, enough(need))


def cut(run: Run, group: Group, begin: int = 0) -> tuple[list[int], Group]:
    """Rows of the run that start a batch, and the group open after it, its start counted within the run.

    ``group`` is open before row ``begin``. A tick that reaches the end of the run may go on after it.
    """
    starts = [] if group.size else [begin]
    start, alert = begin - group.size, group.alert
    while True:
        row = max(start, begin)
        if row == run.rows:
            return starts[:-1], NOTHING
        trigger = row
        if not alert:
            index = int(np.searchsorted(run.alert_rows, row))
            trigger = int(run.alert_rows[index]) if index < len(run.alert_rows) else run.rows
        if trigger > run.key_ends[row]:
            # No alert in the rest of the key: the group stays open.
            last = int(run.key_ends[row])
            if last == run.rows - 1:
                return starts, Group(run.rows - start, False, starts[-1] if starts else -1)
        else:
            full, last = max(trigger, start + int(run.needs[row]) - 1), int(run.tick_ends[trigger])
            if last == run.rows - 1 and full > last:
                return starts, Group(run.rows - start, True, starts[-1] if starts else -1)
            last = min(full, last)
        start, alert = last + 1, False
        starts.append(start)


def after_gap(group: Group, last_key, last_tick, first_key, first_tick) -> Group:
    """The open group when the next rows begin: gone if the key or, with an alert, the tick has changed."""
    if list(last_key) != list(first_key):
        return NOTHING
    return NOTHING if group.alert and last_tick != first_tick else group


# ---- first pass: what a slice does to the group that is open before it


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    rows, exits, heads = 0, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = Run(batch)
        if first is None:
            first = (batch.column("slice")[0].as_py(), run.first_key, int(run.ticks[0]), int(run.needs[0]))
            exits = variants(first[3])
            heads = [None] * len(exits)
        else:
            exits = [after_gap(group, *last, run.first_key, run.ticks[0]) for group in exits]
        cuts, need = {}, int(run.needs[-1])
        for index, group in enumerate(exits):
            state = (group.size, group.alert)
            if state not in cuts:
                cuts[state] = cut(run, group)
            starts, left = cuts[state]
            if starts and heads[index] is None:
                heads[index] = rows + starts[0]
            if left.size:
                start = group.start if left.start < 0 else (first[0] << ROW_BITS) | (rows + left.start)
                left = replace(left, start=start, size=left.size if left.alert else min(left.size, enough(need)))
            exits[index] = left if left.size else NOTHING
        rows += run.rows
        last = (run.last_key, int(run.ticks[-1]))
    if first is None:
        return
    noted = [{"size": g.size, "alert": g.alert, "start": g.start, "head": rows if head is None else head} for g, head in zip(exits, heads)]
    note = {
        "slice": first[0], "rows": rows, "first_key": first[1], "first_tick": first[2], "first_need": first[3],
        "last_key": last[0], "last_tick": last[1], "exits": noted,
    }
    yield pa.RecordBatch.from_pylist([note], schema=to_arrow_schema(NOTE))


# ---- between the passes


def step(group: Group, batch_id: int, before: dict | None, note: dict) -> tuple[Group, int, dict]:
    """Through one more note: the open group and its batch where the note begins, and what the note makes of it."""
    if before is not None:
        group = after_gap(group, before["last_key"], before["last_tick"], note["first_key"], note["first_tick"])
    return group, batch_id if group.size else -1, note["exits"][variant(group, note["first_need"])]


def compose(notes: list[dict]) -> dict:
    """One note of several neighbouring ones."""
    notes, exits = sorted(notes, key=lambda note: note["slice"]), []
    for group in variants(notes[0]["first_need"]):
        batch_id, before, head, whole = -1, None, 0, True
        for note in notes:
            group, batch_id, exit_ = step(group, batch_id, before, note)
            if whole:
                # Nothing is open that could go on: the group from before has ended.
                mine = exit_["head"] if group.size or before is None else 0
                head, whole = head + mine, mine == note["rows"]
            batch_id = exit_["start"] if exit_["start"] >= 0 else batch_id
            group, before = Group(exit_["size"], exit_["alert"]), note
        exits.append({"size": group.size, "alert": group.alert, "start": batch_id if group.size else -1, "head": head})
    first, last = notes[0], notes[-1]
    kept = {name: first[name] for name in ("first_key", "first_tick", "first_need")} | {name: last[name] for name in ("last_key", "last_tick")}
    return {"slice": first["slice"] // FAN, "rows": sum(note["rows"] for note in notes), **kept, "exits": exits}


def descend(notes: list[dict], parent: dict | None) -> list[dict]:
    """The entry of each of several neighbouring notes, from the entry of all of them."""
    notes = sorted(notes, key=lambda note: note["slice"])
    parent = parent or {"size": 0, "alert": False, "batch_id": -1, "follow": 0}
    group, batch_id, before, entries, heads = Group(parent["size"], parent["alert"]), parent["batch_id"], None, [], []
    for note in notes:
        group, batch_id, exit_ = step(group, batch_id, before, note)
        entries.append({"slice": note["slice"], "size": group.size, "alert": group.alert, "batch_id": batch_id, "follow": 0})
        heads.append(exit_["head"] if group.size else 0)
        batch_id = exit_["start"] if exit_["start"] >= 0 else batch_id
        group, before = Group(exit_["size"], exit_["alert"]), note
    following = parent["follow"]
    for note, entry, head in reversed(list(zip(notes, entries, heads))):
        entry["follow"] = following
        # The head of these rows belongs to the last batch of those before.
        following = head + (following if head == note["rows"] else 0)
    return entries


def _composed(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([compose(table.to_pylist())], schema=to_arrow_schema(NOTE))


def _top(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(descend(table.to_pylist(), None), schema=to_arrow_schema(ENTRY))


def _descended(notes: pa.Table, parents: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(descend(notes.to_pylist(), parents.to_pylist()[0]) if len(notes) else [], schema=to_arrow_schema(ENTRY))


def chain(notes: DataFrame, slices: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entry of every slice, from the notes of all; slices are numbered below ``slices``. ``keep`` stores a level."""
    node = F.floor(F.col("slice") / FAN).alias("node")
    levels, width = [keep(notes)], slices
    while width > FAN:
        levels.append(keep(levels[-1].groupBy(node).applyInArrow(_composed, NOTE)))
        width = -(-width // FAN)
    entries = levels.pop().groupBy(node).applyInArrow(_top, ENTRY)
    while levels:
        entries = levels.pop().groupBy(node).cogroup(entries.groupBy("slice")).applyInArrow(_descended, ENTRY)
    return entries


# ---- second pass: the batch of every row


def mark(table: pa.Table, entries: pa.Table) -> pa.Table:
    """(uid, batch_id, keep) of the rows of one slice; ``keep`` says whether the buffer still holds the row at the end."""
    if not len(table):
        return pa.Table.from_pylist([], schema=to_arrow_schema(MARKS))
    table = table.sort_by("row").combine_chunks()
    run, entry, number = Run(table.to_batches()[0]), entries.to_pylist()[0], table.column("slice")[0].as_py()
    group = Group(entry["size"], entry["alert"])
    starts, _ = cut(run, group)
    ids = [(number << ROW_BITS) | start for start in starts]
    if group.size:
        starts, ids = [0, *starts], [entry["batch_id"], *ids]
    lengths = np.diff([*starts, run.rows])
    row_ids = np.repeat(np.array(ids, dtype=np.int64), lengths)
    after = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(run.rows)
    after[run.rows - int(lengths[-1]) :] += entry["follow"]
    columns = [table.column("uid").cast(pa.int64()), pa.array(row_ids), pa.array(after < run.needs * BUFFER_FACTOR)]
    return pa.Table.from_arrays(columns, schema=to_arrow_schema(MARKS))
