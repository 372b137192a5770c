"""Alert batches to notification messages: texts, mentions, size limit and send times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions import text as tx
from alertlake.operators.health import HEALTH_PREFIX
from alertlake.plans.slices import SLICE, KeyWindow
from alertlake.settings import HostSettings, Settings, per_host

# The texts and limits of a message.
ALERT_TITLE = "Docker日志告警 "
HEALTH_TITLE = "Docker监控健康告警 "
HEALTH_MENTION = "Docker监控健康告警"
CUT_NOTICE = "\n... (已截断)"
PAYLOAD_NOTICE = "\n\n... (已截断)"
DETAIL_BYTES = 5000
PAYLOAD_BYTES = 20000
SEND_SECONDS = 4.0


def is_health(log_id: Column) -> Column:
    return tx.trim_space(log_id).startswith(HEALTH_PREFIX)


def health_component(log_id: Column) -> Column:
    return F.regexp_replace(tx.trim_space(log_id), r"\Amonitor\.health\.", "")


def batch_hosts(containers: Column) -> Column:
    """Hosts in front of the container names ``host/name``."""
    prefixed = F.filter(containers, lambda name: F.instr(name, "/") > 1)
    hosts = F.transform(prefixed, lambda name: tx.trim_space(F.substring_index(name, "/", 1)))
    return F.array_distinct(F.filter(hosts, lambda host: host != ""))


def title(log_id: Column, containers: Column) -> Column:
    prefix = F.when(is_health(log_id), HEALTH_TITLE).otherwise(ALERT_TITLE)
    return F.concat(prefix, log_id, _host_list(containers))


def _host_list(containers: Column) -> Column:
    hosts = batch_hosts(containers)
    return F.when(F.size(hosts) > 0, F.concat(F.lit(" ["), F.array_join(hosts, ","), F.lit("]"))).otherwise("")


def clean_levels(levels: Sequence[str]) -> list[str]:
    return [level.strip().upper() for level in levels if level.strip()]


def should_mention(events: Column, levels: Sequence[str]) -> Column:
    wanted = clean_levels(levels)
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(events, lambda e: tx.trim_space(F.upper(e["level"])).isin(wanted)), F.lit(False))


def display_time(ts: Column, zone: str | None = None) -> Column:
    """Time as ``2026-03-24 18:00:00 +08:00`` in a zone, by default the one of the session."""
    if zone is None:
        text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss xxx")
    else:
        local = F.date_format(F.convert_timezone(None, F.lit(zone), ts), "yyyy-MM-dd HH:mm:ss")
        offset = F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)
        size = F.abs(offset)
        sign = F.when(offset < 0, "-").otherwise("+")
        hours, minutes = F.floor(size / 3600).cast("int"), F.floor(size % 3600 / 60).cast("int")
        text = F.format_string("%s %s%02d:%02d", local, sign, hours, minutes)
    return F.when(ts.isNotNull(), text).otherwise("-")


def empty_as_dash(text: Column) -> Column:
    return F.when(tx.is_blank(text), "-").otherwise(text)


def event_detail(raw: Column, message: Column) -> Column:
    """Text of an event inside a code block."""
    text = F.coalesce(tx.non_blank(raw), tx.non_blank(message))
    safe = F.replace(text, F.lit("```"), F.lit("'''"))
    cut = F.concat(tx.byte_prefix(safe, DETAIL_BYTES), F.lit(CUT_NOTICE))
    return F.when(text.isNull(), "-").when(F.octet_length(safe) > DETAIL_BYTES, cut).otherwise(safe)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: `"), value, F.lit("`\n"))


def _host_line(containers: Column) -> Column:
    hosts = batch_hosts(containers)
    return F.when(F.size(hosts) > 0, _line("主机", F.array_join(hosts, ", "))).otherwise("")


def markdown(batch: Column, max_events: int = 5, zone: str | None = None) -> Column:
    """Body of an ordinary batch: a header, and its first events."""
    events, count = batch["events"], F.size(batch["events"])

    def item(event: Column) -> Column:
        head = F.format_string(
            "\n- `%s` `%s` `%s`",
            display_time(event["timestamp"], zone),
            F.coalesce(event["container"]["name"], F.lit("")),
            empty_as_dash(event["level"]),
        )
        return F.concat(head, F.lit("\n\n```\n"), event_detail(event["raw"], event["message"]), F.lit("\n```\n"))

    rest = F.format_string("\n- 其余 `%d` 条日志已省略", count - max_events)
    return F.concat(
        F.lit("### "),
        title(batch["log_id"], batch["containers"]),
        F.lit("\n\n"),
        _host_line(batch["containers"]),
        _line("LogID", batch["log_id"]),
        _line("日志条数", batch["count"].cast("string")),
        _line("容器", F.array_join(batch["containers"], ", ")),
        _line("首次时间", display_time(batch["first_seen"], zone)),
        _line("最后时间", display_time(batch["last_seen"], zone)),
        F.lit("\n#### 最近日志\n"),
        F.array_join(F.transform(F.slice(events, 1, max_events), item), ""),
        F.when(count > max_events, rest).otherwise(""),
    )


def health_markdown(batch: Column, zone: str | None = None) -> Column:
    """Body of a health batch, about its first event."""
    event = F.get(batch["events"], F.lit(0))
    return F.concat(
        F.lit("### "),
        title(batch["log_id"], batch["containers"]),
        F.lit("\n\n"),
        _host_line(batch["containers"]),
        _line("状态", empty_as_dash(event["level"])),
        _line("组件", health_component(batch["log_id"])),
        _line("时间", display_time(event["timestamp"], zone)),
        _line("容器", F.array_join(batch["containers"], ", ")),
        F.lit("\n#### 说明\n\n"),
        F.coalesce(tx.trim_space(event["message"]), F.lit("")),
        F.lit("\n\n#### 详情\n\n```\n"),
        event_detail(event["raw"], event["message"]),
        F.lit("\n```\n"),
    )


def render_mobiles(mobiles: Sequence[str]) -> str:
    """Mentions of the numbers; a blank one leaves no mention, and none at the front leaves its blank."""
    shown = [(" " if index else "") + "@" + mobile.strip() for index, mobile in enumerate(mobiles) if mobile.strip()]
    return "".join(shown)


def mention_text(batch: Column, at_all: bool, at_mobiles: Sequence[str]) -> Column:
    message = tx.trim_space(F.coalesce(F.get(batch["events"], F.lit(0))["message"], F.lit("")))
    health = F.concat(
        F.lit(HEALTH_MENTION),
        _host_list(batch["containers"]),
        F.when(message != "", F.concat(F.lit(" "), message)).otherwise(""),
    )
    text = F.when(is_health(batch["log_id"]), health).otherwise(title(batch["log_id"], batch["containers"]))
    mobiles = render_mobiles(at_mobiles)
    suffix = " @all" if at_all else (f" {mobiles}" if mobiles else "")
    return F.concat(text, F.lit(suffix))


# ---- payload --------------------------------------------------------------------------------------------------


def payload_json(msgtype: str, heading: Column, body: Column, at_all: bool = False, at_mobiles: Sequence[str] = ()) -> Column:
    """Message as JSON. The angle brackets, ampersands and line separators are escaped, which counts for its size."""
    is_markdown = msgtype == "markdown"
    nothing = F.lit("")
    mobiles = F.array(*[F.lit(m) for m in at_mobiles]) if at_mobiles else F.lit(None).cast("array<string>")
    message = F.struct(
        F.lit(msgtype).alias("msgtype"),
        F.struct((heading if is_markdown else nothing).alias("title"), (body if is_markdown else nothing).alias("text")).alias("markdown"),
        F.struct((nothing if is_markdown else body).alias("content")).alias("text"),
        F.struct(mobiles.alias("atMobiles"), F.lit(at_all).alias("isAtAll")).alias("at"),
    )
    text = F.to_json(message, {"ignoreNullFields": "false"})
    for char, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return text


def fit_payload(build, body: Column, limit: int = PAYLOAD_BYTES) -> Column:
    """``build(body)``, with the longest prefix of the body whose payload fits; NULL if not even the notice does."""
    text = F.rtrim(body, F.lit("\n"))

    def cut(characters: Column) -> Column:
        return F.concat(F.rtrim(F.substr(text, F.lit(1), characters), F.lit("\n")), F.lit(PAYLOAD_NOTICE))

    def fits(characters: Column) -> Column:
        return F.octet_length(build(cut(characters))) <= limit

    def halve(bounds: Column, _step: Column) -> Column:
        middle = ((bounds["low"] + bounds["high"] + 1) / 2).cast("int")
        open_ = bounds["low"] < bounds["high"]
        return F.when(
            open_ & fits(middle), F.struct(middle.alias("low"), bounds["high"].alias("high"))
        ).when(open_, F.struct(bounds["low"].alias("low"), (middle - 1).alias("high"))).otherwise(bounds)

    # A character takes a byte at least, so no longer prefix fits, and halving ends after as many steps as the limit has bits.
    bounds = F.struct(F.lit(0).alias("low"), F.least(F.length(text), F.lit(limit)).alias("high"))
    best = F.aggregate(F.sequence(F.lit(1), F.lit(limit.bit_length())), bounds, halve)["low"]
    whole = build(body)
    return F.when(F.octet_length(whole) <= limit, whole).when(fits(F.lit(0)), build(cut(best)))


# ---- tables ---------------------------------------------------------------------------------------------------


def notifications(batches: DataFrame, settings: HostSettings, zone: str | None = None) -> DataFrame:
    """Messages of each batch: a markdown one, and a text one if somebody is to be mentioned.

    Whom to mention, how many events to show and the ``webhook`` to send to are those of the batch's host. ``payload`` is NULL
    for a message that cannot be made to fit, see ``rejected``.
    """
    batch = F.struct(*batches.columns)
    shown = per_host(settings, lambda one: markdown(batch, one.max_events, zone), lambda one: one.max_events)
    body = F.when(is_health(F.col("log_id")), health_markdown(batch, zone)).otherwise(shown)
    mention = per_host(settings, lambda one: should_mention(F.col("events"), one.mention_levels), lambda one: tuple(one.mention_levels))
    reachable = per_host(settings, lambda one: F.lit(one.at_all or bool(one.at_mobiles)))
    first = F.struct(F.lit(1).alias("part"), F.lit("markdown").alias("msgtype"), body.alias("body"))
    mentioned = per_host(settings, lambda one: mention_text(batch, one.at_all, one.at_mobiles), _named)
    second = F.when(mention & reachable, F.struct(F.lit(2).alias("part"), F.lit("text").alias("msgtype"), mentioned.alias("body")))
    messages = batches.where(~F.col("suppress_alert_sinks")).select(
        "host",
        "log_id",
        F.col("flushed_at").alias("arrival"),
        "first_seen",
        title(F.col("log_id"), F.col("containers")).alias("title"),
        F.inline(F.array_compact(F.array(first, second))),
    )
    heading, content = F.col("title"), F.col("body")
    as_markdown = fit_payload(lambda text: payload_json("markdown", heading, text), content)
    as_text = per_host(settings, lambda one: fit_payload(lambda text: payload_json("text", heading, text, one.at_all, one.at_mobiles), content), _named)
    fitted = F.when(F.col("msgtype") == "markdown", as_markdown).otherwise(as_text)
    return messages.withColumns({"payload": fitted, "webhook": per_host(settings, lambda one: F.lit(one.webhook_url))})


def _named(one: Settings) -> tuple:
    return one.at_all, tuple(one.at_mobiles)


def rejected(messages: DataFrame) -> DataFrame:
    """Messages that no sender can take: their payload does not fit, even without a body."""
    return messages.where("payload IS NULL").select("host", "log_id", "arrival", "msgtype", F.octet_length("title").alias("title_bytes"), F.octet_length("body").alias("body_bytes"))


def send_schedule(
    messages: DataFrame, keys: Sequence[str], order: Sequence[str], interval: float = SEND_SECONDS, arrival: str | None = None
) -> DataFrame:
    """Send time of each message of a queue: its arrival, or ``interval`` after the one before it if that is later.

    With n the place in the queue, slot(n) = n·d + max over k ≤ n of (arrival(k) − k·d). ``order`` starts with the
    arrival time, or ``arrival`` names it. All messages may share one queue, so this runs in slices.
    """
    step = int(interval * 1_000_000)
    window = KeyWindow(keys, order)
    placed = window.sum(messages, F.lit(1).cast("bigint"), "place")
    lead = F.unix_micros(F.col(arrival or order[0])) - F.col("place") * step
    queued = window.max(placed, lead, "_lead")
    return queued.withColumn("send_at", F.timestamp_micros(F.col("place") * step + F.col("_lead"))).drop("_lead", SLICE)
