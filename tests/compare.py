"""Compare a registered query with its SQL."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "quantize"):
        return int(value) if value == int(value) else float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return sorted((tuple(normal(row[index]) for index in order) for row in rows), key=repr), [columns[i] for i in order]


def difference(frame, connection, sql: str) -> str:
    """Empty when both sides hold the same rows."""
    mine, names = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(sql)
    theirs, other_names = rows_of([item[0] for item in result.description], result.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if mine == theirs:
        return ""
    extra = [row for row in mine if row not in set(theirs)][:2]
    missing = [row for row in theirs if row not in set(mine)][:2]
    return f"{len(mine)} and {len(theirs)} rows; only here {extra}; only there {missing}"
