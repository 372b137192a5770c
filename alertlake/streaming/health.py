"""Health alerts of a stream of status rows: failures in a row are counted in keyed state, beside the stream of events."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from alertlake.operators.health import DEGRADED_AT, health_batches
from alertlake.sources.sinks import Sink

# The state processor travels with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "host string, component string, micros bigint, seq bigint, error string, level string, failures bigint"
# Commits of this stream are numbered from here on, so that its files stand beside those of the alerts.
FIRST_COMMIT = 1 << 40


def count_failures(ok: np.ndarray, before: int) -> np.ndarray:
    """Failures in a row that end at each row or, at a success, ended just before it."""
    failed = np.cumsum(~ok) + before
    # Counted from the last success before the row; the first ones go on with what was counted before.
    base = np.where(ok, failed, 0)
    reset = np.maximum.accumulate(np.concatenate([[0], base[:-1]])) if len(ok) else base
    return failed - reset


class FailureCounter(StatefulProcessor):
    """One number per component: its failures in a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        stored = self.failures.get()
        ok = batch["ok"].to_numpy(dtype=bool)
        batch["failures"] = count_failures(ok, 0 if stored is None else int(stored[0]))
        last = 0 if ok[-1] else int(batch["failures"].iloc[-1])
        self.failures.update((last,))
        degraded = ~ok & (batch["failures"] == DEGRADED_AT).to_numpy()
        recovered = ok & (batch["failures"] >= DEGRADED_AT).to_numpy()
        batch["level"] = np.where(degraded, "ERROR", "INFO")
        batch["host"], batch["component"] = key
        yield batch.loc[degraded | recovered, ["host", "component", "micros", "seq", "error", "level", "failures"]]

    def close(self) -> None:
        pass


def stream_transitions(status: DataFrame) -> DataFrame:
    """``health_transitions`` of a stream; rows of a component are taken in order of time within each commit."""
    status.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = status.select("host", "component", F.unix_micros("ts").alias("micros"), "seq", F.coalesce("ok", F.lit(False)).alias("ok"), "error")
    found = rows.groupBy("host", "component").transformWithStateInPandas(FailureCounter(), TRANSITION, "append", "None")
    return found.withColumn("ts", F.timestamp_micros("micros")).drop("micros")


def start_health(status: DataFrame, sink: Sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Health batches of a stream of status rows, to the sinks that the alerts go to (``live.alert_sink``)."""

    def write(batches: DataFrame, commit: int) -> None:
        sink(batches, FIRST_COMMIT + commit)

    writer = health_batches(stream_transitions(status)).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
