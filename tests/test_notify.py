import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from alertlake.operators import notify
from alertlake.schema import BATCH
from alertlake.settings import Settings

T = dt.datetime(2026, 3, 24, 10, 0)
MOBILES = ["13800000000", "13900000000"]


def event(level="ERROR", message="boom", raw="boom", container="app", log_id="err-1"):
    return (T, ("id", container), "stdout", level, log_id, True, message, raw, False)


def frame(spark, events, log_id="err-1", containers=("app",), muted=False):
    row = ("h", log_id, T, T, len(events), list(containers), events, T, muted)
    return spark.createDataFrame([row], f"host string, {BATCH}")


def messages(spark, batch, zone=None, **settings):
    return notify.notifications(batch, Settings(**settings), zone).orderBy("part").collect()


def test_warning_without_mention(spark):
    (one,) = messages(spark, frame(spark, [event("WARN")]), at_mobiles=MOBILES)
    payload = json.loads(one.payload)
    assert payload["msgtype"] == "markdown" and payload["at"] == {"atMobiles": None, "isAtAll": False}


def test_error_mentions_mobiles(spark):
    batch = frame(spark, [event(container="coach_test/local-dev-api")], containers=["coach_test/local-dev-api"])
    first, second = (json.loads(m.payload) for m in messages(spark, batch, at_mobiles=MOBILES))
    assert first["markdown"]["title"] == "Docker日志告警 err-1 [coach_test]"
    assert "- 主机: `coach_test`\n" in first["markdown"]["text"]
    assert second["text"]["content"] == "Docker日志告警 err-1 [coach_test] @13800000000 @13900000000"
    assert second["at"] == {"atMobiles": MOBILES, "isAtAll": False}


def test_at_all(spark):
    second = messages(spark, frame(spark, [event()]), at_all=True)[1]
    assert json.loads(second.payload)["text"]["content"].endswith("err-1 @all")


def test_nobody_to_mention(spark):
    assert len(messages(spark, frame(spark, [event()]))) == 1
    assert len(messages(spark, frame(spark, [event()]), at_mobiles=MOBILES, mention_levels=[])) == 1


def test_first_events_are_shown(spark):
    batch = frame(spark, [event(raw=f"line-{n}") for n in range(3)])
    text = messages(spark, batch, max_events=2)[0].body
    assert "line-0" in text and "line-1" in text and "line-2" not in text and "其余 `1` 条日志已省略" in text


def test_display_zone(spark):
    text = messages(spark, frame(spark, [event()]), zone="Asia/Shanghai")[0].body
    assert "- 首次时间: `2026-03-24 18:00:00 +08:00`" in text
    assert "`2026-03-24 10:00:00 +00:00`" in messages(spark, frame(spark, [event()]))[0].body


def test_health_layout(spark):
    log_id = "monitor.health.docker.event_stream"
    batch = frame(spark, [event(message="stream degraded", log_id=log_id)], log_id, ["prod-a/monitor"])
    first, second = messages(spark, batch, at_mobiles=MOBILES)
    assert "- 组件: `docker.event_stream`" in first.body and first.body.startswith(f"### Docker监控健康告警 {log_id} [prod-a]")
    assert second.body == "Docker监控健康告警 [prod-a] stream degraded @13800000000 @13900000000"


def test_muted_batches_send_nothing(spark):
    assert messages(spark, frame(spark, [event()], muted=True), at_mobiles=MOBILES) == []


def test_detail(spark):
    rows = spark.createDataFrame([(" ``` ", "m"), (" ", "m"), (None, None), ("字" * 2000, "")], "raw string, message string")
    got = [r[0] for r in rows.select(notify.event_detail(F.col("raw"), F.col("message"))).collect()]
    assert got == ["'''", "m", "-", "字" * 1666 + "\n... (已截断)"]


@pytest.mark.parametrize("unit", ["a", "<", "字", "\n", '"', " ", "a\n\n"])
def test_payload_is_the_longest_that_fits(spark, unit):
    body = unit * 20000
    row = spark.createDataFrame([(body,)], "b string")

    def build(text):
        return notify.payload_json("markdown", F.lit("t"), text)

    payload = row.select(notify.fit_payload(build, F.col("b"))).first()[0]
    assert len(payload.encode()) <= 20000
    text = json.loads(payload)["markdown"]["text"]
    shown = text.removesuffix(notify.PAYLOAD_NOTICE)
    assert text != shown and body.startswith(shown)
    longer = body.rstrip("\n")[: len(shown) + 1].rstrip("\n") + notify.PAYLOAD_NOTICE
    if len(longer) > len(text):
        size = row.select(F.octet_length(build(F.lit(longer)))).first()[0]
        assert size > 20000


def test_payload_that_cannot_fit(spark):
    row = spark.createDataFrame([("x" * 100, "t" * 30000)], "b string, t string")
    fit = notify.fit_payload(lambda text: notify.payload_json("markdown", F.col("t"), text), F.col("b"))
    assert row.select(fit).first()[0] is None


def test_send_times_equal_a_queue(spark):
    rnd = random.Random(3)
    arrivals = sorted(rnd.randint(0, 900) for _ in range(150))
    rows = [("hook", T + dt.timedelta(seconds=s), n) for n, s in enumerate(arrivals)]
    free, expected = None, []
    for _, arrival, _ in rows:
        free = arrival if free is None else max(arrival, free + dt.timedelta(seconds=4))
        expected.append(free)
    table = spark.createDataFrame(rows, "webhook string, arrival timestamp, seq bigint")
    got = notify.send_schedule(table, ["webhook"], ["arrival", "seq"]).orderBy("seq").collect()
    assert [r.send_at for r in got] == expected
