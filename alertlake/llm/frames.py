"""Helpers that the operators share: Arrow batches, shared storage, safe column names, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.plans.slices import shared_folder

Columns = dict[str, pa.Array]


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns that an operator is about to add; Spark compares names without case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(quoted(name)) for name in df.columns if name.lower() not in taken])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_text(df: DataFrame, id_col: str, text_col: str, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Only the two columns that most operators read, under fixed names, so that no other column can clash."""
    return df.select(F.col(quoted(id_col)).cast("bigint").alias(id_name), F.col(quoted(text_col)).cast("string").alias(text_name))


def add_columns(df: DataFrame, fields: list[tuple[str, str]], compute: Callable[[pa.RecordBatch], Columns]) -> DataFrame:
    """Add columns batch by batch. ``compute`` sees a batch of all columns; a column of the same name is replaced."""
    names = [name for name, _ in fields]
    taken = {name.lower() for name in names}
    kept = [index for index, name in enumerate(df.columns) if name.lower() not in taken]
    schema = T.StructType([df.schema.fields[index] for index in kept] + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = compute(batch)
            arrays = [batch.column(index) for index in kept] + [added[name] for name in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[index] for index in kept] + names)

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: a cut of the lineage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_ids(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """The rows with a number ``name`` that no other row has: their id or, where that is null or repeated, one that is larger than any id.

    Only the rows without an id of their own are stored, which makes their numbers last.
    """
    given = F.col(quoted(id_col)).cast("bigint")
    twice = docs.groupBy(given.alias("_id")).count().where("_id IS NOT NULL AND count > 1").select("_id")
    marked = docs.withColumn("_id", given)
    unnamed = marked.where("_id IS NULL").unionByName(marked.join(twice, "_id", "left_semi"))
    numbered = stored(unnamed.withColumn(name, F.lit(2**63 - 1) - F.monotonically_increasing_id()), "unnamed")
    return marked.where("_id IS NOT NULL").join(twice, "_id", "left_anti").withColumn(name, F.col("_id")).unionByName(numbered).drop("_id")


def bounded_sample(df: DataFrame, rows: int, key: str, total: int | None = None) -> DataFrame:
    """At most ``rows`` rows, the same for the same data: the first in the order of a hash of the key.

    A cut by the hash, from the number of rows, leaves little more than ``rows`` in all tasks together, so that what reaches
    the driver does not grow with the number of tasks. ``total`` saves the count where it is known.
    """
    total = df.count() if total is None else total
    code = F.xxhash64(quoted(key))
    if total > 2 * rows:
        df = df.where(F.pmod(code, F.lit(1 << 40)) < int(1.3 * rows / total * (1 << 40)))
    return df.orderBy(F.pmod(code, F.lit(1 << 40)), quoted(key)).limit(rows)


def residue(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % modulus
