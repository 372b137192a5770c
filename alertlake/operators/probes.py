"""Who asked for sensitive URL paths: stored batches to a ranking of clients per path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.json import json_object, lower_keys
from alertlake.functions.requests import client_ip, strip_query
from alertlake.functions.text import trim_space
from alertlake.plans.once import compute_once
from alertlake.plans.slices import checkpointed, row_positions
from alertlake.schema import REQUEST_FIELDS

# Fixed values.
DEFAULT_PATHS = ("/api/.env", "/api/.git/config")
REQUEST_MESSAGE = "request"


def target_paths(given: Sequence[str] = ()) -> list[str]:
    """Paths from repeated or comma-separated arguments, in order."""
    paths = [path.strip() for item in given for path in item.split(",")]
    return [path for path in paths if path] or list(DEFAULT_PATHS)


def explode_events(batches: DataFrame) -> DataFrame:
    """One row per event of the batches; a batch without events leaves none."""
    kept = [name for name in batches.columns if name in ("host", "file")]
    return batches.select(*kept, F.inline("events"))


def request_events(events: DataFrame) -> DataFrame:
    """Events that log a request, with the fields of the request under ``request``."""
    logged = events.where((F.col("message") == REQUEST_MESSAGE) & (F.col("raw") != ""))
    read = compute_once(logged, {"fields": lower_keys(json_object(trim_space(F.col("raw"))))})
    request = F.struct(*[F.col("fields")[name].alias(name) for name in REQUEST_FIELDS])
    return read.where(F.col("fields").isNotNull()).withColumn("request", request).drop("fields")


def path_in(requests: DataFrame, paths: Sequence[str] | DataFrame) -> DataFrame:
    """Requests whose path is one of the given ones, with ``path`` and ``client``.

    A table of paths, in a column ``path``, is joined and may be of any size; a list becomes part of the plan.
    """
    request = F.col("request")
    client = client_ip(request["x_real_ip"], request["x_forwarded_for"], request["ip"], request["remote_addr"])
    path = strip_query(F.coalesce(request["url"], F.lit("")))
    found = compute_once(requests, {"path": path, "client": client})
    if isinstance(paths, DataFrame):
        return found.join(paths.select("path"), "path", "left_semi")
    return found.where(F.col("path").isin(list(dict.fromkeys(paths))))


def may_hold_path(raw: Column, paths: Sequence[str]) -> Column:
    """Cheap test in front of the JSON reader: a path without escapes stands in the text as it is."""
    hint = raw.contains("%") | raw.contains("\\")
    for path in paths:
        hint = hint | raw.contains(path)
    return hint


def probe_hits(events: DataFrame, paths: Sequence[str] | DataFrame = DEFAULT_PATHS) -> DataFrame:
    """Requests for the paths, a list or a table, with the client; requests without a client address are left out."""
    request = F.col("request")
    candidates = events.where(F.col("message") == REQUEST_MESSAGE)
    if not isinstance(paths, DataFrame):
        candidates = candidates.where(may_hold_path(F.col("raw"), paths))
    hits = path_in(request_events(candidates), paths)
    kept = [name for name in events.columns if name == "file"]
    return hits.where(F.col("client") != "").select(
        "path",
        F.col("client").alias("ip"),
        "timestamp",
        F.coalesce(request["method"], F.lit("")).alias("method"),
        F.coalesce(request["url"], F.lit("")).alias("url"),
        F.coalesce("container.name", F.lit("")).alias("container"),
        *kept,
    )


KINDS = ("method", "url", "container")


def _combinations(hits: DataFrame) -> DataFrame:
    """Hits reduced to distinct combinations of what the report shows."""
    return hits.groupBy("path", "ip", *KINDS).agg(
        F.count("*").alias("hits"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def _values(combinations: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in KINDS]
    rows = combinations.select("path", "ip", "hits", F.inline(F.array(*pairs))).where(F.col("value") != "")
    return rows.groupBy("path", "ip", "kind", "value").agg(F.sum("hits").alias("hits"))


def probe_values(hits: DataFrame) -> DataFrame:
    """Distinct methods, URLs and containers of every path and client, as rows."""
    return _values(_combinations(hits))


def probe_stats(hits: DataFrame) -> DataFrame:
    """Hits per path and client, first and last time seen, and how many methods, URLs and containers there are.

    The values themselves are the rows of ``probe_values``: a client may have any number of them.
    """
    key = ["path", "ip"]
    # Stored once: both steps below would scan the batches again.
    combinations = checkpointed(_combinations(hits))
    seen = combinations.groupBy(*key).agg(
        F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    counts = _values(combinations).groupBy(*key).agg(*[F.count_if(F.col("kind") == kind).alias(f"n_{kind}s") for kind in KINDS])
    return seen.join(counts, key, "left").fillna(0, [f"n_{kind}s" for kind in KINDS])


def _positions(stats: DataFrame, paths: Sequence[str]) -> Column:
    """Place of the path among the given ones."""
    return F.array_position(F.array(*[F.lit(path) for path in paths]), F.col("path"))


def rank_probes(stats: DataFrame, paths: Sequence[str] = DEFAULT_PATHS) -> DataFrame:
    """Clients with their place in the report: paths as given, then hits from high to low, then address."""
    placed = stats.withColumns({"path_position": _positions(stats, paths), "fewer": -F.col("hits")})
    return row_positions(placed, ["path_position"], ["fewer", "ip"], "rank").drop("fewer")


def report_order(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("path_position", F.desc("hits"), "ip")


def path_summary(stats: DataFrame, paths: Sequence[str] = DEFAULT_PATHS) -> DataFrame:
    """Total hits and number of clients of every path, zero for paths without hits."""
    rows = [(place, path) for place, path in enumerate(paths, 1)]
    targets = stats.sparkSession.createDataFrame(rows, "path_position int, path string")
    totals = stats.groupBy("path").agg(F.sum("hits").alias("hits"), F.count("ip").alias("clients"))
    return targets.join(totals, "path", "left").fillna(0, ["hits", "clients"])


def total_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits"))
