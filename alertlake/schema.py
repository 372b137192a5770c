"""Schemas of the tables that move between operators.

``host``, ``ingest_ts`` and ``seq`` say where and in which order a line arrived: every operator that depends
on order sorts by ``(ingest_ts, seq)``, never by the time written in the line.
"""

from __future__ import annotations

CONTAINER = "struct<id:string,name:string>"

RAW_LOG = (
    f"host string, container {CONTAINER}, stream string, line string, timestamp timestamp,"
    " ingest_ts timestamp, seq bigint"
)

EVENT_FIELDS = [
    "timestamp", "container", "stream", "level", "log_id", "alert_matched", "message", "raw", "parsed_from_json",
]

EVENT = (
    f"struct<timestamp:timestamp,container:{CONTAINER},stream:string,level:string,log_id:string,"
    "alert_matched:boolean,message:string,raw:string,parsed_from_json:boolean>"
)

BATCH = (
    "log_id string, first_seen timestamp, last_seen timestamp, count int, containers array<string>,"
    f" events array<{EVENT}>, flushed_at timestamp, suppress_alert_sinks boolean"
)

BATCH_FIELDS = [
    "host", "log_id", "first_seen", "last_seen", "count", "containers", "events", "flushed_at",
    "suppress_alert_sinks",
]

# What the probe queries read of a stored batch; the JSON reader skips all other fields.
PROBE_BATCH = "events array<struct<timestamp:timestamp,container:struct<name:string>,message:string,raw:string>>"

REQUEST_FIELDS = ["msg", "url", "method", "ip", "x_real_ip", "x_forwarded_for", "remote_addr"]

CONTAINER_EVENT = (
    "host string, ts timestamp, seq bigint, Type string, Action string, id string,"
    " Actor struct<ID:string,Attributes:map<string,string>>"
)
