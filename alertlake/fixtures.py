"""The engine's input tables, derived from the test tables by plain SQL.

Each text works in Spark and in DuckDB once the dialect words are filled in, so a query and its check start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"S": "STRING", "EPOCH": "unix_micros(CAST(ts AS TIMESTAMP)) div 1000000"}
DUCKDB = {"S": "VARCHAR", "EPOCH": "epoch_us(ts)//1000000"}

RAW_LOGS = """
WITH b AS (SELECT *,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END lv,
  concat('u-', CAST(user_id AS {S})) uid, CAST({EPOCH} AS BIGINT) es FROM events)
SELECT concat('host-', CAST(user_id % 3 AS {S})) AS host,
 concat('c', CAST(user_id % 5 AS {S}), '-', CAST(event_id % 4 AS {S})) AS container_id,
 concat(CASE event_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' WHEN 2 THEN 'web' ELSE 'db' END,
        '-', CAST(user_id % 5 AS {S})) AS container_name,
 CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
 CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
 CAST(CASE WHEN user_id % 5 = 0 AND hour(ts) IN (10,11)
      THEN date_trunc('day', ts) + INTERVAL '12' HOUR ELSE ts END AS TIMESTAMP) AS ingest_ts,
 CASE event_id % 8
  WHEN 0 THEN concat('{{"ts":', CAST(es AS {S}), ',"level":"', lv, '","trace_id":"', uid, '","message":"', event_type, ' handled","props":', props, '}}')
  WHEN 1 THEN concat(lv, ' ', event_type, ' failed log_id=', uid)
  WHEN 2 THEN concat('{{"severity":"', lower(lv), '","Log_ID":"', uid, '","msg":"', event_type, '"}}')
  WHEN 3 THEN concat('警告', lv, '失败 ', event_type)
  WHEN 4 THEN concat('{{"level":"', lv, '","log_id":"', uid, '","error":{{"message":"context canceled"}}}}')
  WHEN 5 THEN 'heartbeat ok'
  WHEN 6 THEN concat('  {{"level":"', lv, '","alert_id":"', uid, '"}} tail ')
  ELSE concat('{{"level":"', lv, '","message":"request","method":"GET","url":"',
       CASE user_id % 4 WHEN 0 THEN '/api/.env?x=1' WHEN 1 THEN '/api/.git/config' WHEN 2 THEN '/api/%2eenv' ELSE '/health' END,
       '","x_forwarded_for":"10.0.0.', CAST(user_id % 20 AS {S}), ', 172.16.0.1","trace_id":"', uid, '"}}')
 END AS line
FROM b
"""

CONTAINER_EVENTS = """
SELECT concat('host-', CAST(user_id % 3 AS {S})) AS host, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
 'container' AS type,
 CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'restart' WHEN 'click' THEN 'rename'
      WHEN 'purchase' THEN 'stop' ELSE 'die' END AS action,
 CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('c', CAST(user_id % 50 AS {S})) END AS id,
 concat('c', CAST(user_id % 50 AS {S})) AS actor_id,
 concat(CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END,
        CASE WHEN event_id % 7 = 0 THEN 'tmp-' ELSE 'svc-' END,
        CAST((CASE WHEN event_type = 'click' THEN user_id + event_id ELSE user_id END) % 20 AS {S})) AS name
FROM events
"""

STATUS = """
SELECT concat('host-', CAST(user_id % 3 AS {S})) AS host, concat('comp-', CAST(user_id % 4 AS {S})) AS component,
 CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, event_type NOT IN ('error', 'click') AS ok,
 CASE WHEN event_type IN ('error', 'click') THEN concat('cause ', event_type) END AS error
FROM events
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    _table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(text.format(**SPARK))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, RAW_LOGS).select(
        "host",
        F.struct(F.col("container_id").alias("id"), F.col("container_name").alias("name")).alias("container"),
        "stream",
        "line",
        F.col("ts").alias("timestamp"),
        "ingest_ts",
        "seq",
    )


def container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, CONTAINER_EVENTS).select(
        "host",
        "ts",
        "seq",
        F.col("type").alias("Type"),
        F.col("action").alias("Action"),
        "id",
        F.struct(
            F.col("actor_id").alias("ID"), F.create_map(F.lit("name"), F.col("name")).alias("Attributes")
        ).alias("Actor"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, STATUS)
