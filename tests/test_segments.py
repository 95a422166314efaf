"""Requests out of segments, responses out of flows that arrive cut, doubled, out of order and with gaps."""

import datetime as dt
import random

import pytest

from logsieve.sources import segments as s

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "flow string, seq long, ts timestamp, payload binary, status string"
PLAIN = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\ncontent-length: 5\r\n\r\nhello"
CHUNKS = b"HTTP/1.1 500 Oops\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n"
NONE = b"HTTP/1.1 204 No Content\r\nContent-Length: 7\r\n\r\n"
CLOSE = b"HTTP/1.0 404 Not Found\n\nuntil the end"


def pieces(flow, data, size, isn=2**32 - 40, seed=1):
    """``data`` in pieces that overlap by two bytes, some of them twice, in any order but the first."""
    out = [(i, data[max(0, i - 2) : i + size]) for i in range(0, len(data), size)]
    rest = out[1:] + out[1::3]
    random.Random(seed).shuffle(rest)
    return [(flow, (isn + max(0, i - 2)) % 2**32, T0 + dt.timedelta(seconds=k), p, "x") for k, (i, p) in enumerate([*out[:1], *rest])]


def found(spark, rows, **more):
    out = s.responses(spark.createDataFrame(rows, SCHEMA), **more)
    return [(r.flow, r.n, r.status, r.content_type, r.content_length, bytes(r.preview)) for r in out.orderBy("flow", "n").collect()]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_flows_are_put_in_order(spark, size):
    rows = pieces("a", PLAIN + CHUNKS + NONE + CLOSE, size) + pieces(None, NONE + PLAIN, size, isn=5)
    assert found(spark, rows) == [
        (None, 1, 204, "", 0, b""), (None, 2, 200, "text/html", 5, b"hello"),
        ("a", 1, 200, "text/html", 5, b"hello"), ("a", 2, 500, "", 13, b"abc0123456789"), ("a", 3, 204, "", 0, b""), ("a", 4, 404, "", 13, b"until the end"),
    ]


def test_gaps_cuts_and_malformed_flows(spark):
    at = lambda flow, *parts: [(flow, q, T0 + dt.timedelta(seconds=k), p, None) for k, (q, p) in enumerate(parts)]
    big = b"HTTP/1.1 200 OK\r\nContent-Length: 100000\r\n\r\n" + b"z" * 100_000
    rows = [
        *at("bad", (0, PLAIN + b"nonsense\r\n\r\n" + PLAIN)), *at("big", (0, big + PLAIN)), *at("cut", (0, PLAIN[:-3])), *at("empty", (0, None), (0, b"")),
        *at("gap", (0, PLAIN[:-5]), (len(PLAIN) + 90, b"world" + PLAIN)), *at("head", (0, PLAIN[:30])), *at("late", (50, PLAIN[50:]), (0, PLAIN[:50])),
        *at("odd", (0, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\nzz\r\n" + PLAIN)), ("none", None, T0, PLAIN, None), ("none", 1, None, PLAIN, None),
    ]
    plain = (200, "text/html", 5)
    assert found(spark, rows, max_body=4) == [
        ("bad", 1, *plain, b"hell"), ("big", 1, 200, "", 100_000, b"zzzz"), ("big", 2, *plain, b"hell"), ("cut", 1, *plain, b"he"), ("gap", 1, *plain, b"worl"), ("gap", 2, *plain, b"hell"),
        ("late", 1, *plain, b"hell"), ("odd", 1, 200, "", 3, b"abc"),
    ]
    assert found(spark, []) == []


def test_requests(spark):
    texts = [
        b"GET /caf\xc3\xa9?a b HTTP/1.1\r\nHost: one\r\nhOST:\t two \r\nUser-Agent: x:y\r\n\r\nrest", b"POST / HTTP/1.0\nContent-Length: 12\nbroken\nContent-Length: many\n\n", b"PUT / HTTP/1.1\r\nTransfer-Encoding: gzip, CHUNKED\r\nHost: cu",
        b"GET / HTTP/1.1\r\nX: " + b"y" * 9000 + b"\r\nHost: late\r\n\r\n", b"FETCH / HTTP/1.1\r\n\r\n", b"GET /noversion\r\n\r\n", b"GET / HTTP/1.1 ", b"GET / HTTP/1", b"", None,
    ]
    rows = s.requests(spark.createDataFrame([(i, x, "old") for i, x in enumerate(texts)], "id int, payload binary, host string"))
    assert [tuple(r) for r in rows.select("id", "method", "path", "host", "user_agent", "content_length", "header_len").orderBy("id").collect()] == [
        (0, "GET", "/café?a b", "two", "x:y", -1, len(texts[0]) - 4), (1, "POST", "/", "", "", 12, len(texts[1])), (2, "PUT", "/", "", "", -2, 0), (3, "GET", "/", "", "", -1, 0),
    ]


def test_requests_are_read_after_rows_are_dealt_and_once(spark):
    from logsieve.plans import catalog

    plan = catalog.queries()["http_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert "X-Pad" in plan[:dealt] and "X-Pad" not in plan[dealt:]


def test_heads_end_at_the_first_empty_line_of_either_kind(spark):
    rows = [b"GET /a HTTP/1.1\r\nHost: x\r\n\r\nHost: y\n\n", b"GET /b HTTP/1.1\nHost: x\n\nHost: y\r\n\r\n", b"GET /c HTTP/1.1\r\nHost: x\r\nUser-", b"GET /d HTTP/1.1\n\r\n\n"]
    got = s.requests(spark.createDataFrame([(r,) for r in rows], "payload binary")).orderBy("path").collect()
    assert [(r.path, r.host, r.header_len) for r in got] == [("/a", "x", 28), ("/b", "x", 25), ("/c", "x", 0), ("/d", "", 18)]


def test_flows_are_dealt_by_rows(spark):
    from logsieve.plans import catalog

    plan = catalog.queries()["http_responses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 32\n") == 2  # 8 tasks of log lines, four segments a line
