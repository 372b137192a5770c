"""Readers of landed logs, lifecycle events and stored batches, static or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.lines import drop_blank_lines, split_timestamp_prefix
from alertlake.schema import BATCH, CONTAINER_EVENT, PROBE_BATCH, RAW_LOG
from alertlake.sources.commits import whole_commits

BAD_LINE = "_bad"
# Landed log files lie under <host>/<container id>/<container name>/<stream>.log.
LOG_PATH = r"([^/]+)/([^/]+)/([^/]+)/(stdout|stderr)[^/]*\z"


def read_raw_logs(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Log lines of all containers and both output streams.

    ``parquet`` and ``json`` hold the raw-log table; ``text`` holds plain log files, one line per row, with the time
    as first word and the origin in the path. ``seq`` grows along a file and only orders lines of the same time.
    """
    if form != "text":
        return spark.read.schema(RAW_LOG).format(form).load(path)
    files = spark.read.option("recursiveFileLookup", True).text(path)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return _from_files(files, F.col("_metadata.file_block_start") + row)


def stream_raw_logs(spark: SparkSession, path: str, form: str = "parquet", max_files: int | None = None) -> DataFrame:
    """The same, endless: files are picked up as they land."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if form != "text":
        return reader.schema(RAW_LOG).format(form).load(path)
    return _from_files(reader.option("recursiveFileLookup", True).text(path), F.col("_metadata.file_block_start"))


def _from_files(files: DataFrame, seq: Column) -> DataFrame:
    path = F.col("_metadata.file_path")
    host, container_id, name, stream = (F.url_decode(F.regexp_extract(path, LOG_PATH, group)) for group in range(1, 5))
    lines = files.select(
        host.alias("host"),
        F.struct(container_id.alias("id"), name.alias("name")).alias("container"),
        stream.alias("stream"),
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("landed"),
        seq.alias("seq"),
    )
    split = split_timestamp_prefix(drop_blank_lines(lines))
    return split.withColumn("ingest_ts", F.coalesce("timestamp", "landed")).select(
        "host", "container", "stream", "line", "timestamp", "ingest_ts", "seq"
    )


def read_container_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lifecycle events of containers; events about other things are left out."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CONTAINER_EVENT).json(path).where("Type = 'container'")


def _read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of all files, but for files of commits that are not whole or have been merged into another."""
    stored = (
        spark.read.schema(f"{schema}, {BAD_LINE} string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,jsonl}")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    return whole_commits(stored, path)


def read_stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """Stored batches as they were written, with their host and file."""
    stored = _good_lines(_read_stored(spark, path, f"host string, {BATCH}"), F.length(F.coalesce("log_id", F.lit(""))))
    return stored.withColumn("suppress_alert_sinks", F.coalesce("suppress_alert_sinks", F.lit(False)))


def _good_lines(stored: DataFrame, size: Column) -> DataFrame:
    """Lines that could be read. ``size``, of a data column, keeps the reader from a scan of the bad lines alone, which Spark refuses."""
    return stored.where(F.col(BAD_LINE).isNull() & (size >= 0)).drop(BAD_LINE)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Stored batches below a folder, one per line; lines that are no batch are skipped, see ``bad_lines``."""
    stored = _good_lines(_read_stored(spark, path, BATCH), F.length(F.coalesce("log_id", F.lit(""))))
    return stored.withColumn("suppress_alert_sinks", F.coalesce("suppress_alert_sinks", F.lit(False)))


def read_probe_batches(spark: SparkSession, path: str) -> DataFrame:
    """Only what the probe queries need of stored batches."""
    return _good_lines(_read_stored(spark, path, PROBE_BATCH), F.size(F.coalesce("events", F.array())))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Number of unreadable lines per file, and of those that still showed an id."""
    stored = _read_stored(spark, path, BATCH).where(F.col(BAD_LINE).isNotNull())
    return stored.groupBy("file").agg(F.count(BAD_LINE).alias("lines"), F.count("log_id").alias("with_id"))
