"""Costly expressions that must not be evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns by way of a generator of one row.

    The optimizer pushes a filter below a projection and repeats the projected expression inside it, which would
    parse every line twice. It does not look through a generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in (df.columns if keep is None else keep) if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))
