import datetime as dt
import random

import pytest
from models import Slots
from pyspark.sql import functions as F

from alertlake.operators import lifecycle
from alertlake.schema import CONTAINER_EVENT

START = dt.datetime(2026, 1, 1)
ACTIONS = ["start", "restart", "unpause", "rename", "die", "stop", "destroy", "exec"]


def frame(spark, rows):
    made = [
        ("h", START + dt.timedelta(seconds=n), n, "container", action, container, (container, {"name": name}))
        for n, (action, container, name) in enumerate(rows)
    ]
    return lifecycle.normalize_container_events(spark.createDataFrame(made, CONTAINER_EVENT))


def sessions(spark, rows, patterns, **options):
    def second(ts):
        return None if ts is None else int((ts - START).total_seconds())

    found = lifecycle.container_sessions(frame(spark, rows), patterns, **options).collect()
    return sorted(((r.name, r.id, second(r.start_ts), second(r.end_ts), r.replaced_by) for r in found), key=repr)


def test_ids_and_names(spark):
    rows = [
        ("h", START, 1, "container", "start", "container-123", ("actor-456", {"name": "/api"})),
        ("h", START, 2, "container", "start", "", ("actor-456", {"name": "api"})),
        ("h", START, 3, "container", "start", None, (" actor-456 ", {})),
        ("h", START, 4, "container", "start", "self", ("self", {"name": "monitor"})),
    ]
    got = lifecycle.normalize_container_events(spark.createDataFrame(rows, CONTAINER_EVENT), " self ").orderBy("seq").collect()
    assert [(r.id, r.name) for r in got] == [("container-123", "api"), ("actor-456", "api"), ("actor-456", "")]


def test_replacement_keeps_one_stream_per_name(spark):
    rows = [("start", "a", "/api"), ("start", "b", "api"), ("die", "a", "api"), ("start", "b", "api")]
    assert sessions(spark, rows, ["api"]) == [("api", "a", 0, 1, "b"), ("api", "b", 1, None, None)]
    (moment,) = lifecycle.container_replacements(frame(spark, rows), ["api"]).collect()
    assert (moment.old_id, moment.new_id, moment.seq) == ("a", "b", 1)


def test_rename_moves_the_stream(spark):
    rows = [("start", "a", "api-old"), ("rename", "a", "api"), ("rename", "a", "hidden")]
    assert sessions(spark, rows, ["api*"]) == [("api", "a", 1, 2, None), ("api-old", "a", 0, 1, None)]
    (moment,) = lifecycle.container_renames(frame(spark, rows), ["api*"]).collect()
    assert (moment.old_name, moment.new_name) == ("api-old", "api")


def test_rename_into_scope(spark):
    assert sessions(spark, [("start", "a", "tmp"), ("rename", "a", "api")], ["api"]) == [("api", "a", 1, None, None)]


def test_active_containers(spark):
    rows = [("start", "a", "x"), ("start", "b", "y"), ("die", "a", "x"), ("start", "c", "y")]
    made = lifecycle.container_sessions(frame(spark, rows), ["*"])
    at = START + dt.timedelta(seconds=2)
    assert [(r.name, r.id) for r in lifecycle.active_containers(made, at).collect()] == [("y", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_a_model(spark, seed):
    rnd = random.Random(seed)
    names = ["api-1", "api-2", "api-3", "db", ""]
    rows = [(rnd.choice(ACTIONS), f"c{rnd.randint(0, 4)}", rnd.choice(names)) for _ in range(300)]
    model = Slots(lambda name: name.startswith("api-"))
    for second, (action, container, name) in enumerate(rows):
        model.handle(second, action, container, name)
    assert sessions(spark, rows, ["api-*"]) == sorted(model.result(), key=repr)


@pytest.mark.parametrize(
    "running, restarting, status, live",
    [(True, False, "exited", True), (None, True, None, True), (False, False, " Created ", True), (False, False, "dead", False), (None, None, None, False)],
)
def test_live_states(spark, running, restarting, status, live):
    row = spark.createDataFrame([(running, restarting, status)], "a boolean, b boolean, c string")
    assert row.select(lifecycle.is_live_state(F.col("a"), F.col("b"), F.col("c"))).first()[0] is live
