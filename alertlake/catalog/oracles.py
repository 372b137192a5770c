"""DuckDB SQL for each registered query, over the same tables.

Batches are cut here by a recursive query that walks through each key row by row.
"""

from __future__ import annotations

from alertlake import fixtures
from alertlake.catalog import queries as q

DAY = 86_400_000_000
SPACE = r"[\s\x0B\x{85}\p{Z}]"
LEVEL = r"(?i)\b(WARN|ERROR)\b"
EXCLUDE = "(?i)context canceled"
ID_PATTERNS = [rf"""(?i)\b{word}[_-]?id["''=:\s]+([A-Za-z0-9._:-]+)""" for word in ("log", "alert", "trace")]


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"




RAW = f"raw AS ({fixtures.RAW_LOGS.format(**fixtures.DUCKDB).strip()})"
LIFECYCLE_RAW = fixtures.CONTAINER_EVENTS.format(**fixtures.DUCKDB).strip()
STATUS = f"status AS ({fixtures.STATUS.format(**fixtures.DUCKDB).strip()})"


def group1(text: str, pattern: str) -> str:
    return f"nullif({trim(f'regexp_extract({text}, {chr(39)}{pattern}{chr(39)}, 1)')}, '')"


ID_KEYS = ("log_id", "logid", "alert_id", "alertid", "trace_id", "traceid")
JSON_ID = ", ".join(f"nullif({trim(f'm[{chr(39)}{key}{chr(39)}]')}, '')" for key in ID_KEYS)
TEXT_ID = ", ".join(group1(text, pattern) for text in ("message", "line") for pattern in ID_PATTERNS)


def parsed(raw: str = RAW) -> str:
    """Chain of tables up to ``lines``: every line with its parsed columns."""
    return f"""{raw},
t1 AS (SELECT * REPLACE ({trim('line')} AS line) FROM raw),
t2 AS (SELECT *, json_valid(line) AND starts_with(line, '{{') AS is_json FROM t1),
t3 AS (SELECT *, CASE WHEN is_json THEN json_keys(line) ELSE []::VARCHAR[] END AS ks FROM t2),
t4 AS (SELECT *, map(list_transform(ks, lambda k: lower(k)),
         list_transform(ks, lambda k: json_extract_string(line, '$."' || k || '"'))) AS m FROM t3),
t5 AS (SELECT *, coalesce(nullif(m['message'], ''), nullif(m['msg'], ''), nullif(m['log'], ''), line) AS message FROM t4),
lines AS (SELECT *,
  coalesce(CASE WHEN regexp_full_match(m['ts'], '\\d+') THEN CAST(m['ts'] AS BIGINT) * 1000000 END, epoch_us(ts)) AS ts_us,
  epoch_us(ingest_ts) AS in_us,
  upper(coalesce({group1("m['level']", LEVEL)}, {group1("m['severity']", LEVEL)}, {group1('line', LEVEL)})) AS level,
  coalesce(nullif(coalesce({JSON_ID}), 'unknown'), {TEXT_ID}, 'unknown') AS log_id,
  regexp_matches(message, '{EXCLUDE}') OR regexp_matches(line, '{EXCLUDE}') AS excluded
  FROM t5)"""


EV = f"""{parsed()},
ev AS (SELECT host, seq, ts_us, in_us, container_id, container_name, stream, coalesce(level, '') AS level, log_id,
  level IS NOT NULL AS alert, message, line AS raw, is_json
  FROM lines WHERE line <> '' AND NOT excluded AND (level IS NOT NULL OR log_id <> 'unknown')),
grouped AS (SELECT * FROM ev WHERE NOT (alert AND log_id = 'unknown'))"""


def cut(size: int, interval_us: int | None, name: str = "cut") -> str:
    """Every grouped event with the number of its batch, by walking through the rows of each key."""
    tick = "0" if interval_us is None else f"in_us // {interval_us}"
    reset = "(w.flushed OR (w.has_alert AND r.tick <> w.tick))"
    return f"""rows_{name} AS (SELECT *, {tick} AS tick,
  row_number() OVER (PARTITION BY host, log_id ORDER BY in_us, seq) AS rn FROM grouped),
walk_{name} AS (
  SELECT host, log_id, rn, tick, 1 AS batch_no, 1 AS size, alert AS has_alert, alert AND 1 >= {size} AS flushed
  FROM rows_{name} WHERE rn = 1
  UNION ALL
  SELECT r.host, r.log_id, r.rn, r.tick,
    w.batch_no + CASE WHEN {reset} THEN 1 ELSE 0 END,
    CASE WHEN {reset} THEN 1 ELSE w.size + 1 END,
    r.alert OR (w.has_alert AND NOT {reset}),
    (r.alert OR (w.has_alert AND NOT {reset})) AND (CASE WHEN {reset} THEN 1 ELSE w.size + 1 END) >= {size}
  FROM walk_{name} w JOIN rows_{name} r ON r.host = w.host AND r.log_id = w.log_id AND r.rn = w.rn + 1),
{name} AS (SELECT r.*, w.batch_no, w.flushed FROM rows_{name} r JOIN walk_{name} w USING (host, log_id, rn)),
ranked_{name} AS (SELECT *, row_number() OVER (PARTITION BY host, log_id, batch_no ORDER BY rn DESC) AS from_end FROM {name}),
kept_{name} AS (SELECT * FROM ranked_{name} WHERE from_end <= {10 * size}),
facts_{name} AS (SELECT host, log_id, batch_no, min(ts_us) AS min_us, max(ts_us) AS last_us, count(*) AS total,
  string_agg(DISTINCT container_name, ',' ORDER BY container_name) AS containers, bool_or(alert) AS has_alert,
  bool_or(flushed) AS by_size, max(in_us) AS max_in, max(tick) AS tick
  FROM {name} GROUP BY ALL),
texts_{name} AS (SELECT host, log_id, batch_no, count(*) AS count, string_agg(raw, '|' ORDER BY ts_us, in_us, seq) AS raws,
  arg_min(ts_us, rn) AS oldest_us FROM kept_{name} GROUP BY ALL)"""


def batch_rows(name: str = "cut", interval_us: int | None = None) -> str:
    tick_end = "max_in" if interval_us is None else f"(tick + 1) * {interval_us}"
    return f"""SELECT host, log_id, batch_no, CASE WHEN total > count THEN oldest_us ELSE min_us END AS first_us, last_us, count,
  containers, md5(raws) AS events_md5, CASE WHEN by_size THEN max_in ELSE {tick_end} END AS flushed_us, has_alert, by_size
  FROM facts_{name} JOIN texts_{name} USING (host, log_id, batch_no)"""


SINGLE = """SELECT host, log_id, -seq - 1 AS batch_no, ts_us AS first_us, ts_us AS last_us, 1::BIGINT AS count, container_name AS containers,
  md5(raw) AS events_md5, in_us AS flushed_us, true AS has_alert, false AS by_size
  FROM ev WHERE alert AND log_id = 'unknown'"""
BATCH_COLUMNS = "log_id, first_us, last_us, count, containers, events_md5, flushed_us"
INTERVAL_US = int(q.INTERVAL * 1_000_000)

BATCHES = f"""{EV}, {cut(q.SIZE, INTERVAL_US)},
batches AS ({batch_rows('cut', INTERVAL_US)}), singles AS ({SINGLE}),
emitted AS (SELECT * FROM batches WHERE has_alert UNION ALL SELECT * FROM singles)"""

# Events that reached a stored batch.
STORED = f"""{BATCHES},
stored AS (SELECT k.* EXCLUDE (tick, rn, batch_no, flushed, from_end) FROM kept_cut k
  JOIN batches b USING (host, log_id, batch_no) WHERE b.has_alert
  UNION ALL SELECT * FROM ev WHERE alert AND log_id = 'unknown')"""

REQUESTS = f"""{STORED},
requests AS (SELECT *, json_extract_string(raw, '$.url') AS url, json_extract_string(raw, '$.method') AS method,
  json_extract_string(raw, '$.x_forwarded_for') AS x_forwarded_for
  FROM stored WHERE message = 'request' AND json_valid(raw)),
hits AS (SELECT *, url_decode(regexp_extract(url, '^[^?#]*')) AS path, trim(split_part(x_forwarded_for, ',', 1)) AS ip
  FROM requests WHERE url_decode(regexp_extract(url, '^[^?#]*')) IN ('/api/.env', '/api/.git/config')),
stats AS (SELECT path, ip, count(*) AS hits, min(ts_us) AS first_us, max(ts_us) AS last_us,
  count(DISTINCT nullif(method, '')) AS n_methods, count(DISTINCT nullif(url, '')) AS n_urls,
  count(DISTINCT nullif(container_name, '')) AS n_containers
  FROM hits WHERE ip <> '' GROUP BY path, ip)"""

GAP_US, LONGEST_US = int(q.GAP * 1_000_000), int(q.LONGEST * 1_000_000)
WINDOWS = f"""{RAW},
rows_w AS (SELECT host, container_name AS container, epoch_us(ts) AS ts_us, epoch_us(ingest_ts) AS in_us, seq FROM raw),
gaps AS (SELECT *, in_us - lag(in_us) OVER (PARTITION BY host, container ORDER BY in_us, seq) AS gap_us FROM rows_w),
opened AS (SELECT host, container, in_us AS start_us, gap_us,
  lead(in_us) OVER (PARTITION BY host, container ORDER BY in_us) AS next_us FROM gaps WHERE gap_us >= {GAP_US}
  AND ts_us < in_us - 30000000),
ends AS (SELECT host, max(in_us) AS input_us FROM rows_w GROUP BY host),
caught AS (SELECT o.host, o.container, o.start_us, min(r.in_us) AS caught_us FROM opened o JOIN rows_w r
  ON r.host = o.host AND r.container = o.container AND r.in_us >= o.start_us AND (o.next_us IS NULL OR r.in_us < o.next_us)
  AND r.ts_us >= o.start_us - 30000000 GROUP BY ALL),
limits AS (SELECT o.*, c.caught_us, least(o.start_us + {LONGEST_US}, e.input_us) AS limit_us, e.input_us
  FROM opened o JOIN ends e USING (host) LEFT JOIN caught c USING (host, container, start_us)),
windows AS (SELECT host, container, start_us, CASE WHEN caught_us <= limit_us THEN caught_us ELSE limit_us END AS end_us, gap_us,
  CASE WHEN caught_us <= limit_us THEN 'log stream caught up to realtime'
       WHEN start_us + {LONGEST_US} <= input_us THEN 'backfill max duration reached'
       ELSE 'watcher stream stopped' END AS reason FROM limits),
reach AS (SELECT *, max(end_us) OVER (PARTITION BY host ORDER BY start_us, container
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM windows),
islands AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us >= reached THEN 1 ELSE 0 END)
  OVER (PARTITION BY host ORDER BY start_us, container ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT host, island, min(start_us) AS start_us, max(end_us) AS end_us, max(gap_us) AS gap_us FROM islands GROUP BY host, island)"""

OTHER_US = int(q.OTHER_INTERVAL * 1_000_000)
BY_HOST = f"""{EV}, {cut(q.SIZE, INTERVAL_US, 'one')}, {cut(q.OTHER_SIZE, OTHER_US, 'other')}, singles AS ({SINGLE}),
emitted AS (SELECT * FROM ({batch_rows('one', INTERVAL_US)}) WHERE host = 'host-0' AND has_alert
  UNION ALL SELECT * FROM ({batch_rows('other', OTHER_US)}) WHERE host <> 'host-0' AND has_alert UNION ALL SELECT * FROM singles)"""
WINDOWS_BY_HOST = WINDOWS.replace(f"{GAP_US}", f"(CASE WHEN host = 'host-0' THEN {GAP_US} ELSE {4 * 3600 * 1_000_000} END)").replace(
    f"{LONGEST_US}", f"(CASE WHEN host = 'host-0' THEN {LONGEST_US} ELSE {2 * 3600 * 1_000_000} END)"
)

CONTAINER_EVENTS = f"""life AS (SELECT host, seq, epoch_us(ts) AS ts_us, action,
  CASE WHEN trim(id) <> '' THEN id ELSE trim(actor_id) END AS id, regexp_replace(name, '^/', '') AS name FROM ({LIFECYCLE_RAW})),
own AS (SELECT * FROM life WHERE id <> 'c7')"""

SLOTS = f"""{CONTAINER_EVENTS},
flags AS (SELECT *, starts_with(name, 'svc-') AND action IN ('start', 'restart', 'unpause', 'rename') AS opens,
  action IN ('die', 'stop', 'destroy') OR (NOT starts_with(name, 'svc-') AND action = 'rename') AS closes FROM own),
acts AS (SELECT *, last_value(CASE WHEN opens THEN name END IGNORE NULLS) OVER (PARTITION BY host, id ORDER BY ts_us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_name FROM flags WHERE opens OR closes),
slots AS (SELECT host, ts_us, seq, id, name, true AS enters FROM acts WHERE opens
  UNION ALL SELECT host, ts_us, seq, id, old_name, false FROM acts WHERE old_name IS NOT NULL AND (NOT opens OR old_name <> name)),
newest AS (SELECT *, last_value(CASE WHEN enters THEN id END IGNORE NULLS) OVER (PARTITION BY host, name ORDER BY ts_us, seq
  ROWS UNBOUNDED PRECEDING) AS newest FROM slots),
states AS (SELECT *, CASE WHEN enters THEN id END AS holder, row_number() OVER w AS n, lag(CASE WHEN enters THEN id END) OVER w AS old_holder
  FROM newest WHERE enters OR id = newest WINDOW w AS (PARTITION BY host, name ORDER BY ts_us, seq)),
changes AS (SELECT * FROM states WHERE n = 1 OR holder IS DISTINCT FROM old_holder),
sessions AS (SELECT *, lead(ts_us) OVER w AS end_us, lead(holder) OVER w AS replaced_by FROM changes
  WINDOW w AS (PARTITION BY host, name ORDER BY ts_us, seq))"""

RUNS = f"""{STATUS},
counted AS (SELECT *, epoch_us(ts) AS ts_us, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS run_id,
  coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host, component ORDER BY ts, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM status WINDOW w AS (PARTITION BY host, component ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
runs AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY host, component, earlier ORDER BY ts, seq
  ROWS UNBOUNDED PRECEDING) AS failures FROM counted),
transitions AS (SELECT *, 'ERROR' AS level FROM runs WHERE NOT ok AND failures = 3
  UNION ALL SELECT *, 'INFO' FROM runs WHERE ok AND failures >= 3),
health AS (SELECT host, component, ts_us, level, concat('monitor.health.', component) AS log_id, concat(host, '/monitor') AS containers,
  concat(component, CASE WHEN level = 'ERROR' THEN ' entered degraded state' ELSE ' recovered' END) AS message,
  concat(component, CASE WHEN level = 'ERROR' THEN ' entered degraded state: ' || error ELSE ' recovered' END,
         chr(10), 'consecutive_failures=', CAST(failures AS VARCHAR)) AS raw FROM transitions)"""

# Batches with host names in front of the containers, and the health batches.
PREFIXED = BATCHES.replace("FROM b\n)", "FROM b\n)", 1).replace(
    "t1 AS (SELECT * REPLACE (", "t1 AS (SELECT * REPLACE (concat(host, '/', container_name) AS container_name, ", 1
)
ALL_BATCHES = f"""{PREFIXED}, {RUNS},
errors AS (SELECT host, log_id, batch_no, bool_or(level = 'ERROR') AS has_error FROM kept_cut GROUP BY ALL
  UNION ALL SELECT host, log_id, -seq - 1, level = 'ERROR' FROM ev WHERE alert AND log_id = 'unknown'),
every AS (SELECT e.log_id, e.flushed_us, e.first_us, e.last_us, e.containers, e.host AS hosts, x.has_error, e.batch_no, e.host, e.count,
  'Docker日志告警 ' || e.log_id || ' [' || e.host || ']' AS title, '' AS message
  FROM emitted e JOIN errors x USING (host, log_id, batch_no)
  UNION ALL
  SELECT log_id, ts_us, ts_us, ts_us, containers, host, level = 'ERROR', 0, host, 1,
    'Docker监控健康告警 ' || log_id || ' [' || host || ']', message FROM health)"""


def shanghai(us: str) -> str:
    return f"strftime(make_timestamp({us} + 28800000000), '%Y-%m-%d %H:%M:%S') || ' +08:00'"


def utc(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') || ' +00:00'"


MARKDOWN = f"""{ALL_BATCHES},
shown AS (SELECT host, log_id, batch_no, ts_us, in_us, seq, container_name, level, raw FROM kept_cut
  UNION ALL SELECT host, log_id, -seq - 1, ts_us, in_us, seq, container_name, level, raw FROM ev WHERE alert AND log_id = 'unknown'),
placed AS (SELECT *, row_number() OVER (PARTITION BY host, log_id, batch_no ORDER BY ts_us, in_us, seq) AS place FROM shown),
items AS (SELECT host, log_id, batch_no, string_agg(concat(chr(10), '- `', {shanghai('ts_us')}, '` `', container_name, '` `',
   CASE WHEN level = '' THEN '-' ELSE level END, '`', chr(10), chr(10), '```', chr(10), raw, chr(10), '```', chr(10)), '' ORDER BY place) AS items
  FROM placed WHERE place <= 2 GROUP BY ALL)"""


def payload(body: str) -> str:
    """JSON text of a markdown message."""
    escaped = f"""replace(replace(replace(CAST(to_json({body}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"""
    escaped = f"replace(replace({escaped}, chr(8232), '\\u2028'), chr(8233), '\\u2029')"
    return (
        """concat('{"msgtype":"markdown","markdown":{"title":', CAST(to_json(source) AS VARCHAR), ',"text":', """
        + escaped
        + """, '},"text":{"content":""},"at":{"atMobiles":null,"isAtAll":false}}')"""
    )


def all_oracles() -> dict[str, str]:
    raw_columns = "host, seq, stream, line, container_id, container_name, epoch_us(ts) AS ts_us, epoch_us(ingest_ts) AS ingest_us"
    lines_with = f"WITH {parsed()} SELECT"
    emitted = f"WITH RECURSIVE {BATCHES} SELECT {BATCH_COLUMNS} FROM emitted"
    key = "log_id, flushed_us, first_us"
    notice = "chr(10) || chr(10) || '... (已截断)'"

    def by_size(size: int, interval: int | None, where: str, columns: str = BATCH_COLUMNS) -> str:
        return (
            f"WITH RECURSIVE {EV}, {cut(size, interval)}, batches AS ({batch_rows('cut', interval)})"
            f" SELECT {columns} FROM batches WHERE {where}"
        )

    return {
        "read_raw_logs": f"WITH {RAW} SELECT {raw_columns} FROM raw",
        "stream_raw_logs": f"WITH {RAW} SELECT {raw_columns} FROM raw",
        "read_container_events": f"""SELECT host, seq, action AS "Action", id, name, epoch_us(ts) AS ts_us
            FROM ({LIFECYCLE_RAW}) WHERE seq % 11 <> 0""",
        "write_batches": f"""WITH RECURSIVE {BATCHES}, {RUNS},
            filed AS (SELECT log_id, first_us, last_us, count, 'alert' AS kind FROM emitted
              UNION ALL SELECT log_id, ts_us, ts_us, 1, 'health' FROM health)
            SELECT log_id, first_us, last_us, count, strftime(make_timestamp(last_us), '%Y-%m') AS month,
              strftime(make_timestamp(last_us), '%Y-%m-%d') AS day, kind FROM filed""",
        "read_batches": emitted,
        "append_batches": emitted,
        "merged_commits": emitted,
        "fan_out": f"WITH {EV}, singles AS ({SINGLE}) SELECT {BATCH_COLUMNS} FROM singles",
        "outbox": f"""WITH RECURSIVE {BATCHES},
            errors AS (SELECT host, log_id, batch_no, bool_or(level = 'ERROR') AS has_error FROM kept_cut GROUP BY ALL
              UNION ALL SELECT host, log_id, -seq - 1, level = 'ERROR' FROM ev WHERE alert AND log_id = 'unknown'),
            x AS (SELECT * FROM emitted JOIN errors USING (host, log_id, batch_no))
            SELECT log_id, 'markdown' AS msgtype, 3 AS commit, count(*) AS messages FROM x GROUP BY log_id
            UNION ALL SELECT log_id, 'text', 3, count(*) FROM x WHERE has_error GROUP BY log_id""",
        "debug_lines": f"""WITH {RAW} SELECT concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'),
            CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE rtrim(strftime(ts, '.%f'), '0') END,
            'Z [', container_name, '] [', stream, '] ', line) AS value FROM raw""",
        "match_containers": f"""WITH {RAW} SELECT host, seq, container_name FROM raw
            WHERE regexp_full_match(container_name, 'api-[^/]*|w[^/]b-[0-2]|db')""",
        "exclude_container": f"WITH {RAW} SELECT seq, container_id AS id FROM raw WHERE container_id <> 'c0-0'",
        "since_cutoff": f"WITH {RAW} SELECT seq, epoch_us(ts) AS ts_us FROM raw WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'",
        "split_timestamp_prefix": f"""WITH {RAW} SELECT seq, CASE WHEN seq % 3 = 1 THEN 'not-a-timestamp ' ELSE '' END || line AS line,
            CASE WHEN seq % 3 = 0 THEN epoch_us(ts) END AS ts_us FROM raw""",
        "clip_lines": """WITH d AS (SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE
              left(text, list_max(list_filter(range(0, 1001), lambda k: strlen(left(text, k)) <= 1000))::BIGINT)
              || ' [truncated: docker log line exceeded limit]' END AS line FROM documents)
            SELECT doc_id, md5(line) AS line_md5, CAST(strlen(line) AS INTEGER) AS bytes FROM d""",
        "drop_blank_lines": f"WITH {RAW} SELECT seq, line FROM raw WHERE seq % 4 <> 0",
        "host_labels": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'local' WHEN 2 THEN 'root@' || c_name
            WHEN 3 THEN c_name ELSE c_name || '/x' END AS label FROM customer""",
        "prefix_host": f"WITH {RAW} SELECT seq, concat(host, '/', container_name) AS container_name FROM raw",
        "host_settings": """SELECT c_custkey, c_nationkey AS host,
            coalesce(CASE WHEN n_regionkey <> 0 THEN n_regionkey * 5 END, 20) AS flush_size, 5 AS max_events
            FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
        "json_objects": f"{lines_with} seq, is_json, CAST(len(ks) AS INTEGER) AS n FROM lines",
        "ci_fields": f"""{lines_with} seq, m['log_id'] AS "LOG_ID", m['level'] AS "Level", m['severity'] AS severity,
            m['msg'] AS msg FROM lines""",
        "messages": f"{lines_with} seq, message FROM lines",
        "event_times": f"{lines_with} seq, ts_us FROM lines",
        "time_strings": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts)
            WHEN 1 THEN (epoch_us(ts) // 1000000 - 28800) * 1000000 WHEN 2 THEN epoch_us(ts) // 1000 * 1000
            WHEN 3 THEN epoch_us(ts) // 1000000 * 1000000 END AS ts_us FROM events""",
        "first_groups": f"""{lines_with} seq, CASE WHEN regexp_matches(line, '(?i)\\b(purchase)') THEN 'PURCHASE'
            WHEN regexp_matches(line, 'error handled') THEN 'ERROR' WHEN regexp_matches(line, 'view') THEN 'VIEW' END AS found FROM lines""",
        "alert_levels": f"{lines_with} seq, level FROM lines",
        "log_ids": f"{lines_with} seq, log_id FROM lines",
        "exclude_shallow": f"{lines_with} seq, line FROM lines WHERE NOT excluded",
        "exclude_deep": f"""WITH {RAW}, e AS (SELECT seq, replace(trim(line), 'context', '\\u0063ontext') AS line FROM raw)
            SELECT seq, CASE WHEN json_valid(line)
              THEN coalesce(starts_with(json_extract_string(line, '$.error.message'), 'context'), false)
              ELSE false END AS excluded FROM e""",
        "parse_events": f"""WITH {EV} SELECT host, seq, ts_us, container_name, stream, level, log_id, alert AS alert_matched,
            message, raw, is_json AS parsed_from_json FROM ev""",
        "parse_per_host": f"""WITH {parsed()},
            h AS (SELECT *, CASE WHEN host = 'host-1' THEN upper(coalesce({group1("m['level']", '(?i)\\b(INFO)\\b')},
                {group1("m['severity']", '(?i)\\b(INFO)\\b')}, {group1('line', '(?i)\\b(INFO)\\b')})) ELSE level END AS lv,
              CASE WHEN host = 'host-2' THEN regexp_matches(line, 'heartbeat|request') ELSE excluded END AS ex FROM lines)
            SELECT host, coalesce(lv, '') AS level, count(*) AS events, count(DISTINCT log_id) AS ids FROM h
            WHERE NOT ex AND (lv IS NOT NULL OR log_id <> 'unknown') GROUP BY 1, 2""",
        "single_event_batches": f"WITH {EV}, singles AS ({SINGLE}) SELECT {BATCH_COLUMNS} FROM singles",
        "flush_by_size": by_size(q.SIZE, None, "by_size"),
        "flush_small_buffer": by_size(1, INTERVAL_US, "has_alert"),
        "flush_by_interval": f"""WITH {EV},
            w AS (SELECT *, min(CASE WHEN alert THEN in_us // {INTERVAL_US} END) OVER (PARTITION BY host, log_id ORDER BY in_us // {INTERVAL_US}
              RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS batch_tick FROM grouped)
            SELECT host, log_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS count,
              string_agg(DISTINCT container_name, ',' ORDER BY container_name) AS containers,
              (batch_tick + 1) * {INTERVAL_US} AS flushed_us
            FROM w WHERE batch_tick IS NOT NULL GROUP BY host, log_id, batch_tick""",
        "assign_ticks": f"""WITH {EV} SELECT seq, min(CASE WHEN alert THEN in_us // {INTERVAL_US} END) OVER (PARTITION BY host, log_id
            ORDER BY in_us // {INTERVAL_US} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS batch_tick FROM grouped""",
        "flush_batches": emitted,
        "sort_events": f"""WITH RECURSIVE {BATCHES} SELECT k.log_id, b.flushed_us,
            CAST(row_number() OVER (PARTITION BY k.host, k.log_id, k.batch_no ORDER BY k.ts_us, k.in_us, k.seq) - 1 AS INTEGER) AS place,
            k.ts_us, k.raw FROM kept_cut k JOIN batches b USING (host, log_id, batch_no) WHERE b.has_alert
            UNION ALL SELECT log_id, in_us, 0, ts_us, raw FROM ev WHERE alert AND log_id = 'unknown'""",
        "keep_last": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY host, log_id ORDER BY in_us DESC, seq DESC) AS rn
            FROM grouped) SELECT host, log_id, seq FROM r WHERE rn <= 20
            AND NOT (ascii(right(log_id, 1)) % 2 = 0 AND EXISTS (SELECT 1 FROM grouped g WHERE g.host = r.host AND g.log_id = r.log_id AND g.alert))""",
        "pending_groups": f"""WITH {EV}, w AS (SELECT *, min(CASE WHEN alert THEN in_us // {INTERVAL_US} END) OVER (PARTITION BY host, log_id
              ORDER BY in_us // {INTERVAL_US} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS batch_tick FROM grouped)
            SELECT host, log_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS count
            FROM w WHERE batch_tick IS NULL GROUP BY host, log_id""",
        "final_flush": by_size(
            q.SIZE, None, "has_alert AND NOT by_size", "log_id, first_us, last_us, count, containers, events_md5"
        ),
        "stream_batches": emitted,
        "group_commits": emitted,
        "live_job": emitted.replace(
            " AS line) FROM raw)", " AS line) FROM raw WHERE regexp_full_match(container_name, 'api-[^/]*|w[^/]b-[0-2]|db'))", 1
        ),
        "drained_job": emitted.replace(
            " AS line) FROM raw)", " AS line) FROM raw WHERE regexp_full_match(container_name, 'api-[^/]*|w[^/]b-[0-2]|db'))", 1
        ),
        "flush_per_host": f"""WITH RECURSIVE {BY_HOST} SELECT host || '/' || log_id AS log_id, first_us, last_us, count, containers, events_md5,
            flushed_us FROM emitted""",
        "windows_per_host": f"WITH {WINDOWS_BY_HOST} SELECT host, container, start_us, end_us, reason FROM windows",
        "job_per_host": f"""WITH RECURSIVE {BY_HOST}, {WINDOWS_BY_HOST[len(RAW) + 1 :]},
            errors AS (SELECT host, log_id, batch_no, bool_or(level = 'ERROR') AS has_error FROM kept_one WHERE host = 'host-0' GROUP BY ALL
              UNION ALL SELECT host, log_id, -seq - 1, level = 'ERROR' FROM ev WHERE alert AND log_id = 'unknown' AND host = 'host-0'),
            told AS (SELECT e.host, e.log_id, e.flushed_us, coalesce(x.has_error, false) AS mentioned FROM emitted e LEFT JOIN errors x USING (host, log_id, batch_no)
              WHERE NOT EXISTS (SELECT 1 FROM merged w WHERE w.host = e.host AND e.flushed_us >= w.start_us AND e.flushed_us < w.end_us))
            SELECT host, CASE WHEN host = 'host-0' THEN 'https://one/hook' ELSE 'https://other/hook' END AS webhook, log_id, msgtype, flushed_us AS arrival_us
            FROM told, (VALUES ('markdown'), ('text')) t(msgtype) WHERE msgtype = 'markdown' OR mentioned""",
        "backfill_windows": f"WITH {WINDOWS} SELECT host, container, start_us, end_us, gap_us, reason FROM windows",
        "merge_windows": f"WITH {WINDOWS} SELECT host, start_us, end_us, gap_us FROM merged",
        "mark_suppressed": f"""WITH RECURSIVE {BATCHES}, {WINDOWS[len(RAW) + 1 :]},
            marked AS (SELECT *, EXISTS (SELECT 1 FROM merged w WHERE w.host = e.host AND e.flushed_us >= w.start_us
              AND e.flushed_us < w.end_us) AS suppress_alert_sinks FROM emitted e)
            SELECT log_id, first_us, last_us, flushed_us, count, suppress_alert_sinks FROM marked""",
        "backfill_summary": f"""WITH {EV}, {WINDOWS[len(RAW) + 1 :]},
            n AS (SELECT w.host, w.island, w.start_us, w.end_us, w.gap_us, (SELECT count(*) FROM ev e WHERE e.host = w.host AND e.alert
              AND e.in_us >= w.start_us AND e.in_us < w.end_us) AS alerts, CAST(round(w.gap_us / 1e6) AS BIGINT) AS s FROM merged w WHERE w.start_us < w.end_us)
            SELECT host, 'monitor.health.docker.log_backfill' AS log_id, start_us AS first_us, end_us AS last_us,
              concat('docker log backfill completed: previously offline for ', s // 3600, 'h', s // 60 % 60, 'm', s % 60, 's, replayed ',
                alerts, ' matching events (see persisted log file)') AS message FROM n""",
        "normalize_container_events": f"WITH {CONTAINER_EVENTS} SELECT host, seq, ts_us, action, id, name FROM own",
        "container_sessions": f"""WITH {SLOTS} SELECT host, name, id, ts_us AS start_us, end_us, replaced_by
            FROM sessions WHERE holder IS NOT NULL""",
        "container_replacements": f"""WITH {SLOTS} SELECT host, name, seq, old_holder AS old_id, holder AS new_id FROM changes
            WHERE old_holder IS NOT NULL AND holder IS NOT NULL""",
        "container_renames": f"""WITH {SLOTS}, o AS (SELECT *, lag(name) OVER (PARTITION BY host, id ORDER BY ts_us, seq) AS before
            FROM acts WHERE opens) SELECT host, id, seq, before AS old_name, name AS new_name FROM o WHERE before <> name""",
        "active_containers": f"""WITH {SLOTS} SELECT host, name, id FROM sessions WHERE holder IS NOT NULL
            AND ts_us <= epoch_us(TIMESTAMP '2024-01-15') AND (end_us IS NULL OR end_us > epoch_us(TIMESTAMP '2024-01-15'))""",
        "live_states": """SELECT event_id, event_id % 17 = 0 OR event_id % 19 = 0 OR user_id % 6 IN (0, 2, 4) AS live FROM events""",
        "failure_runs": f"""WITH {RUNS} SELECT host, component, seq, ok, CAST(failures AS BIGINT) AS failures,
            CAST(run_id AS BIGINT) AS run_id FROM runs""",
        "health_transitions": f"""WITH {RUNS} SELECT host, component, seq, level, CAST(failures AS BIGINT) AS failures FROM transitions""",
        "health_batches": f"WITH {RUNS} SELECT log_id, ts_us AS last_us, containers, level, raw FROM health",
        "health_components": f"""WITH RECURSIVE {ALL_BATCHES} SELECT {key}, starts_with(log_id, 'monitor.health.') AS is_health,
            replace(log_id, 'monitor.health.', '') AS component FROM every""",
        "batch_hosts": f"WITH RECURSIVE {ALL_BATCHES} SELECT {key}, hosts FROM every",
        "titles": f"WITH RECURSIVE {ALL_BATCHES} SELECT {key}, title FROM every",
        "should_mention": f"WITH RECURSIVE {ALL_BATCHES} SELECT {key}, has_error AS mention FROM every",
        "markdown": f"""WITH RECURSIVE {MARKDOWN} SELECT {key}, concat('### ', title, chr(10), chr(10), '- 主机: `', hosts, '`', chr(10),
            '- LogID: `', log_id, '`', chr(10), '- 日志条数: `', count, '`', chr(10), '- 容器: `', replace(containers, ',', ', '), '`', chr(10),
            '- 首次时间: `', {shanghai('first_us')}, '`', chr(10), '- 最后时间: `', {shanghai('last_us')}, '`', chr(10),
            chr(10), '#### 最近日志', chr(10), items,
            CASE WHEN count > 2 THEN concat(chr(10), '- 其余 `', count - 2, '` 条日志已省略') ELSE '' END) AS body
            FROM every JOIN items USING (host, log_id, batch_no)""",
        "health_markdown": f"""WITH {RUNS} SELECT log_id, ts_us AS flushed_us, ts_us AS first_us, concat('### Docker监控健康告警 ', log_id,
            ' [', host, ']', chr(10), chr(10), '- 主机: `', host, '`', chr(10), '- 状态: `', level, '`', chr(10), '- 组件: `', component, '`',
            chr(10), '- 时间: `', {utc('ts_us')}, '`', chr(10), '- 容器: `', containers, '`', chr(10), chr(10), '#### 说明', chr(10), chr(10),
            message, chr(10), chr(10), '#### 详情', chr(10), chr(10), '```', chr(10), raw, chr(10), '```', chr(10)) AS body FROM health""",
        "event_detail": f"""WITH d AS (SELECT doc_id, coalesce(nullif({trim("CASE WHEN doc_id % 5 <> 0 THEN '```' || text END")}, ''),
              CASE WHEN doc_id % 7 <> 0 THEN lang END) AS t FROM documents),
            s AS (SELECT doc_id, replace(t, '```', '''''''') AS t FROM d)
            SELECT doc_id, md5(CASE WHEN t IS NULL THEN '-' WHEN strlen(t) <= 5000 THEN t ELSE
              left(t, list_max(list_filter(range(1000, 5001), lambda k: strlen(left(t, k)) <= 5000))::BIGINT) || chr(10) || '... (已截断)' END)
              AS detail_md5 FROM s""",
        "mention_text": f"""WITH RECURSIVE {ALL_BATCHES}, x AS (SELECT *, CASE WHEN starts_with(log_id, 'monitor.health.')
              THEN concat('Docker监控健康告警 [', host, '] ', message) ELSE title END AS base FROM every)
            SELECT {key}, base || ' @13800000000 @13900000000' AS mention, base || ' @all' AS everyone FROM x""",
        "notifications": f"""WITH RECURSIVE {ALL_BATCHES},
            n AS (SELECT log_id, flushed_us, 'markdown' AS msgtype FROM every
              UNION ALL SELECT log_id, flushed_us, 'text' FROM every WHERE has_error)
            SELECT log_id, msgtype, count(*) AS messages, count(*) AS payloads, min(flushed_us) AS first_us FROM n GROUP BY 1, 2""",
        "fit_payload": f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, rtrim(text, chr(10)) AS body, strlen({payload('text')}) AS size
              FROM documents),
            search AS (SELECT doc_id, source, body, 0::BIGINT AS low, length(body)::BIGINT AS high FROM d WHERE size > 20000
              UNION ALL
              SELECT doc_id, source, body,
                CASE WHEN strlen({payload(f"rtrim(left(body, (low + high + 1) // 2), chr(10)) || {notice}")}) <= 20000
                  THEN (low + high + 1) // 2 ELSE low END,
                CASE WHEN strlen({payload(f"rtrim(left(body, (low + high + 1) // 2), chr(10)) || {notice}")}) <= 20000
                  THEN high ELSE (low + high + 1) // 2 - 1 END
              FROM search WHERE low < high),
            sent AS (SELECT doc_id, {payload(f"rtrim(left(body, low), chr(10)) || {notice}")} AS p FROM search WHERE low = high
              UNION ALL SELECT doc_id, {payload('text')} FROM d WHERE size <= 20000)
            SELECT doc_id, md5(p) AS payload_md5, CAST(strlen(p) AS INTEGER) AS bytes FROM sent""",
        "send_schedule": f"""WITH RECURSIVE {STATUS},
            queue AS (SELECT concat('hook-', component) AS webhook, seq, epoch_us(ts) AS at_us,
              row_number() OVER (PARTITION BY component ORDER BY ts, seq) AS place FROM status),
            walk AS (SELECT webhook, seq, place, at_us AS send_us FROM queue WHERE place = 1
              UNION ALL SELECT n.webhook, n.seq, n.place, greatest(n.at_us, w.send_us + 3600000000)
              FROM walk w JOIN queue n ON n.webhook = w.webhook AND n.place = w.place + 1)
            SELECT webhook, seq, place, send_us FROM walk""",
        "explode_events": f"""WITH RECURSIVE {STORED} SELECT container_name AS container, ts_us, message, raw FROM stored""",
        "request_events": f"WITH RECURSIVE {REQUESTS} SELECT ts_us, url, method, x_forwarded_for FROM requests",
        "strip_query_urls": """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN url || '#top'
              WHEN 2 THEN regexp_replace(url, '^https?://[^/]*', '') || '/a%20b+c' WHEN 3 THEN url || '/%zz' ELSE url END AS url FROM pages),
            v AS (SELECT page_id, regexp_replace(url, '\\?([^#/]*)(.*)$', '\\2?\\1') AS url FROM u),
            c AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS cut FROM v),
            p AS (SELECT *, regexp_replace(cut, '^[a-z]+://[^/]*', '') AS path FROM c)
            SELECT page_id, CASE WHEN path = '' OR contains(path, '%zz') THEN cut ELSE url_decode(path) END AS path FROM p""",
        "client_ips": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1.0.0.' || user_id WHEN 1 THEN ':80' WHEN 2 THEN '2.0.0.' || user_id
            WHEN 3 THEN '' WHEN 4 THEN '3.0.0.' || user_id ELSE '[::1]' END AS ip FROM events""",
        "probe_hits": f"""WITH RECURSIVE {REQUESTS} SELECT path, ip, ts_us, method, url, container_name AS container FROM hits""",
        "probe_values": f"""WITH RECURSIVE {REQUESTS}, v AS (SELECT path, ip, 'method' AS kind, method AS value FROM hits
              UNION ALL SELECT path, ip, 'url', url FROM hits UNION ALL SELECT path, ip, 'container', container_name FROM hits)
            SELECT path, ip, kind, value, count(*) AS hits FROM v GROUP BY ALL""",
        "probe_stats": f"WITH RECURSIVE {REQUESTS} SELECT path, ip, hits, first_us, last_us, n_methods, n_urls, n_containers FROM stats",
        "rank_probes": f"""WITH RECURSIVE {REQUESTS} SELECT CAST(CASE path WHEN '/api/.env' THEN 1 ELSE 2 END AS BIGINT) AS path_position, path,
            row_number() OVER (PARTITION BY path ORDER BY hits DESC, ip) AS rank, ip, hits FROM stats""",
        "path_summary": f"""WITH RECURSIVE {REQUESTS}, targets AS (SELECT * FROM (VALUES (1, '/api/.env'), (2, '/api/.git/config'), (3, '/never'))
              t(path_position, path))
            SELECT t.path_position, t.path, coalesce(sum(s.hits), 0)::BIGINT AS hits, count(s.ip) AS clients
            FROM targets t LEFT JOIN stats s USING (path) GROUP BY 1, 2""",
        "probe_targets": f"""WITH RECURSIVE {REQUESTS}, p AS (SELECT url_decode(regexp_extract(url, '^[^?#]*')) AS path,
              trim(split_part(x_forwarded_for, ',', 1)) AS ip FROM requests)
            SELECT path, ip, count(*) AS hits FROM p WHERE ip <> '' AND (path IN ('/api/.env', '/health')
              OR path IN (SELECT '/c/' || c_custkey FROM customer)) GROUP BY ALL""",
        "outbox_schedule": f"""WITH RECURSIVE {BATCHES},
            errors AS (SELECT host, log_id, batch_no, bool_or(level = 'ERROR') AS has_error FROM kept_cut GROUP BY ALL
              UNION ALL SELECT host, log_id, -seq - 1, level = 'ERROR' FROM ev WHERE alert AND log_id = 'unknown'),
            m AS (SELECT flushed_us FROM emitted UNION ALL SELECT flushed_us FROM emitted JOIN errors USING (host, log_id, batch_no) WHERE has_error),
            n AS (SELECT flushed_us, row_number() OVER (ORDER BY flushed_us) AS place FROM m)
            SELECT flushed_us AS arrival_us, place * 4000000 + max(flushed_us - place * 4000000) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS send_us FROM n""",
        "stream_health": f"WITH {RUNS} SELECT log_id, ts_us AS last_us, containers, level, raw FROM health",
        "total_hits": f"WITH RECURSIVE {REQUESTS} SELECT count(*) AS hits FROM hits",
    }
