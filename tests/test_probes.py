import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alertlake.functions.requests import client_ip, strip_query
from alertlake.operators import probes
from alertlake.schema import PROBE_BATCH

T = dt.datetime(2026, 3, 24)


@pytest.mark.parametrize(
    "url, path",
    [
        ("", ""),
        ("/api/.env?x=1", "/api/.env"),
        ("/api/%2eenv#top", "/api/.env"),
        ("http://h:80/a%20b+c?q", "/a b+c"),
        ("http://h", "http://h"),
        ("/a%zz?q", "/a%zz"),
        ("//host/x", "/x"),
        ("?q", ""),
        ("a/b", "a/b"),
        ("mailto:x@y", "mailto:x@y"),
        (":80/x", ":80/x"),
    ],
)
def test_strip_query(spark, url, path):
    assert spark.createDataFrame([(url,)], "u string").select(strip_query(F.col("u"))).first()[0] == path


@pytest.mark.parametrize(
    "fields, ip",
    [
        ((" 1.1.1.1 ", "2.2.2.2", "3.3.3.3", "4.4.4.4:5"), "1.1.1.1"),
        ((" ", "2.2.2.2 , 9.9.9.9", "3.3.3.3", ""), "2.2.2.2"),
        (("", ",9.9.9.9", "3.3.3.3", ""), ""),
        ((None, None, "3.3.3.3", None), "3.3.3.3"),
        (("", "", "", "172.21.0.1:42532"), "172.21.0.1"),
        (("", "", "", "[::1]:80"), "[::1]"),
        (("", "", "", ":80"), ":80"),
        (("", "", "", "host"), "host"),
    ],
)
def test_client_ip(spark, fields, ip):
    row = spark.createDataFrame([fields], "a string, b string, c string, d string")
    assert row.select(client_ip(*[F.col(c) for c in "abcd"])).first()[0] == ip


def events(spark, requests):
    rows = [(T + dt.timedelta(seconds=n), (f"app-{n % 2}",), message, raw) for n, (message, raw) in enumerate(requests)]
    return probes.explode_events(spark.createDataFrame([(rows,), ([],)], PROBE_BATCH))


def request(url, **fields):
    return ("request", json.dumps({"url": url, "method": "GET", **fields}))


@pytest.fixture(scope="module")
def hits(spark):
    return probes.probe_hits(
        events(
            spark,
            [
                request("/api/.env?a", ip="b"), request("/api/.env?b", ip="b"), request("/api/%2Eenv", ip="a"),
                request("/api/.env", ip="a"), request("\\/api/.git/config".replace("\\", ""), x_real_ip="c"),
                request("/api/.env", ip=" "), request("/other", ip="a"), ("other", "{}"), ("request", "{"), ("request", "[1]"),
                ("request", ""), ("request", '{"URL":"\\/api\\/.env","Ip":"d"}'),
            ],
        )
    )


def test_stats_and_rank(hits):
    stats = probes.probe_stats(hits)
    got = probes.report_order(probes.rank_probes(stats)).collect()
    assert [(r.path, r["rank"], r.ip, r.hits) for r in got] == [
        ("/api/.env", 1, "a", 2), ("/api/.env", 2, "b", 2), ("/api/.env", 3, "d", 1), ("/api/.git/config", 1, "c", 1),
    ]
    first = got[1]
    assert (first.n_urls, first.n_methods, first.n_containers) == (2, 1, 2)
    assert (first.first_seen, first.last_seen) == (T, T + dt.timedelta(seconds=1))
    assert got[2].n_methods == 0
    assert probes.total_hits(hits).first().hits == 6


def test_values_are_rows(hits):
    rows = probes.probe_values(hits).where("ip = 'b' AND path = '/api/.env'").collect()
    assert {(r.kind, r.value, r.hits) for r in rows} == {
        ("url", "/api/.env?a", 1), ("url", "/api/.env?b", 1), ("method", "GET", 2), ("container", "app-0", 1), ("container", "app-1", 1),
    }


def test_summary_has_paths_without_hits(hits):
    got = probes.path_summary(probes.probe_stats(hits), [*probes.DEFAULT_PATHS, "/none"]).orderBy("path_position").collect()
    assert [(r.path, r.hits, r.clients) for r in got] == [("/api/.env", 5, 3), ("/api/.git/config", 1, 1), ("/none", 0, 0)]


def test_target_paths():
    assert probes.target_paths([" /a, /b", "", "/c"]) == ["/a", "/b", "/c"]
    assert probes.target_paths() == list(probes.DEFAULT_PATHS)
