"""Order-dependent work on keys of any size.

A window over ``(host, log_id)`` puts all rows of a key into one task, and one key may hold a third of the data.
Here the rows are first sorted by key and order over the whole cluster and cut into slices of equal row count, so a
large key fills many slices. A window then covers one key within one slice, and what a slice must know of the
earlier ones is carried over from one summary row per key and slice.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "slice"
# Rows of a slice, and the least that is worth a slice of its own.
SLICE_ROWS, SMALL_ROWS = 200_000, 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, named by the cluster. Only a local session may do without: it gets one here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="alertlake-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Store the rows in the shared folder: later stages survive lost executors and see the same slices."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Store the rows as Parquet in the shared folder, for readers that need few of their columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_count(df: DataFrame) -> int:
    """Slices of ``SLICE_ROWS`` by the measured number of rows, however many; a small input is spread over the cores."""
    rows = df.count()
    return max(math.ceil(rows / SLICE_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / SMALL_ROWS)), 1)


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None, row: str | None = None) -> DataFrame:
    """Sort by key and order over the whole cluster; ``slice`` numbers the partitions in that order, ``row`` the rows of each.

    A big key fills many slices. Only the last key of a slice can go on in the next one. Slices are numbered in bigint, as in
    the notes of the batch scan: a cogroup of int and bigint keys would send equal numbers to different tasks.
    """
    ranged = df.repartitionByRange(slices or slice_count(df), *keys, *order).sortWithinPartitions(*keys, *order)
    if row:
        # The low bits of the number count the rows of a partition.
        ranged = ranged.withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Place of each row within its key, from 1, for keys of any size: rows are only numbered inside a slice."""
    rows = range_slices(df, keys, order)
    counts = rows.groupBy(*keys, SLICE).count()
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, SLICE, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order))
    numbered = rows.withColumn("_inside", inside).join(offsets, [*keys, SLICE])
    return numbered.withColumn(name, F.col("_offset") + F.col("_inside")).drop(SLICE, "_offset", "_inside")


def time_slice(ts: Column, seconds: float) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000))).cast("bigint")


class KeyWindow:
    """Running values over ``keys`` in ``order``, for keys of any size; each method adds one column to the rows.

    The first step sorts the rows into slices and stores them; further steps on its result use the same slices, as long as
    the rows keep the column ``slice``. Drop it in the end.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        within = Window.partitionBy(*self.keys, SLICE)
        across = Window.partitionBy(*self.keys)
        self.up_to = within.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        self.before = within.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        self.earlier = across.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        # A frame that ends with the key is computed anew for every row; in reverse order it grows row by row.
        self.after = within.orderBy(*map(F.desc, self.order)).rowsBetween(Window.unboundedPreceding, -1)
        self.later = across.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)

    def last(self, rows: DataFrame, value: Column, name: str, including: bool = False) -> DataFrame:
        """Last non-null value before the row, or up to it."""
        newest = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        local = F.last(value, ignorenulls=True).over(self.up_to if including else self.before)
        return self._run(rows, name, local, newest, lambda v: F.last(v, True).over(self.earlier), F.coalesce)

    def next(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """First non-null value after the row."""
        oldest = F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        local = F.last(value, ignorenulls=True).over(self.after)
        return self._run(rows, name, local, oldest, lambda v: F.last(v, True).over(self.later), F.coalesce)

    def sum(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """Sum of the values up to and including the row."""
        local = F.sum(value).over(self.up_to)

        def add(here: Column, carried: Column) -> Column:
            return here + F.coalesce(carried, F.lit(0))

        return self._run(rows, name, local, F.sum(value), lambda v: F.sum(v).over(self.earlier), add)

    def max(self, rows: DataFrame, value: Column, name: str, including: bool = True) -> DataFrame:
        """Greatest value up to the row, or before it."""
        local = F.max(value).over(self.up_to if including else self.before)
        return self._run(rows, name, local, F.max(value), lambda v: F.max(v).over(self.earlier), F.greatest)

    def _run(self, rows, name, local, summary, carry, combine) -> DataFrame:
        sliced = rows if SLICE in rows.columns else range_slices(rows, self.keys, self.order)
        keys = [*self.keys, SLICE]
        slices = sliced.groupBy(*keys).agg(summary.alias("_slice_value")).withColumn("_carried", carry(F.col("_slice_value")))
        right = slices.select(*[F.col(key).alias(f"_{key}") for key in keys], "_carried")
        same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
        joined = sliced.withColumn(name, local).join(right, same, "left")
        return joined.withColumn(name, combine(F.col(name), F.col("_carried"))).drop("_carried", *[f"_{key}" for key in keys])
