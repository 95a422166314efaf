"""Queries on captured payloads: requests and responses of the log lines' events as bytes on the wire."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.sources import log_lines as source
from logsieve.sources import segments

LINES = source.sql()
MAX_BODY = 256
_CRLF = "concat(chr(13), chr(10))"

# a request for each event, in one of eight forms by user and event
_REQUEST = f"""SELECT event_id, CASE (event_id + user_id) % 8
    WHEN 0 THEN concat(method, ' ', path, ' HTTP/1.1', {_CRLF}, 'Host: ', source_name, {_CRLF}, 'User-Agent: curl/', user_id, {_CRLF}, {_CRLF})
    WHEN 1 THEN concat('POST ', path, ' HTTP/1.1', {_CRLF}, 'hOST:  ', ip, ' ', {_CRLF}, 'Content-Length: ', bytes, {_CRLF}, {_CRLF}, repeat('x', 20))
    WHEN 2 THEN concat('PUT ', path, ' HTTP/1.1', {_CRLF}, 'Content-Length: 3', {_CRLF}, 'Transfer-Encoding: gzip, Chunked', {_CRLF}, 'Host: ', ip, {_CRLF}, {_CRLF})
    WHEN 3 THEN concat(method, ' ', path, ' HTTP/1.1', {_CRLF}, 'Host: ', ip, {_CRLF}, 'User-Ag')
    WHEN 4 THEN concat('FETCH ', path, ' HTTP/1.1', {_CRLF}, {_CRLF})
    WHEN 5 THEN concat(method, ' ', path, chr(10), 'Host: ', ip, chr(10), chr(10))
    WHEN 6 THEN concat(method, ' ', path, ' and more HTTP/1.0', chr(10), 'Host: a', user_id, chr(10), 'Host: b', event_id, chr(10), chr(10), 'Host: body')
    ELSE concat(method, ' ', path, ' HTTP/1.1', {_CRLF}, 'X-Pad: ', repeat('y', 8000 + CAST(event_id % 400 AS INT)), {_CRLF}, 'Host: late', {_CRLF}, {_CRLF}) END AS p FROM {{l}}"""

# a response for each event: garbage, chunks, without a body, or with a length; a user's responses are one flow
_RESPONSE = f"""SELECT event_id, user_id, ts, status, n, CASE WHEN event_id % 101 = 7 THEN concat('nonsense', {_CRLF}, {_CRLF})
    WHEN event_id % 5 = 1 THEN concat('HTTP/1.1 ', status, ' Chunked', {_CRLF}, 'Content-Type: text/x', user_id, {_CRLF}, 'Transfer-Encoding: chunked', {_CRLF}, {_CRLF}, lower({{hex}}(n)), {_CRLF}, repeat('x', n), {_CRLF}, '3;last', {_CRLF}, 'end', {_CRLF}, '0', {_CRLF}, {_CRLF})
    WHEN event_id % 5 = 2 THEN concat('HTTP/1.1 204 None', {_CRLF}, {_CRLF})
    ELSE concat('HTTP/1.1 ', status, ' Fine', {_CRLF}, 'content-type: text/html', {_CRLF}, 'Content-Length: ', n, {_CRLF}, {_CRLF}, repeat(CAST(event_id % 10 AS {{text}}), n)) END AS r
  FROM (SELECT *, CAST(1 + event_id % 700 AS INT) AS n FROM {{l}}) t"""

# each response in three segments, the second begins three bytes early and the third comes twice; a flow's numbers wrap
_SEGMENTS = """SELECT concat('flow-', user_id) AS flow, (4294960000 + user_id * 7 + off + lo) % 4294967296 AS seq, timestamp_micros(unix_micros(ts) + (7 * p + copy) % 3) AS ts, CAST(substring(r, CAST(lo + 1 AS INT), CAST(hi - lo AS INT)) AS BINARY) AS payload
FROM (SELECT *, CASE p WHEN 1 THEN greatest(size DIV 3 - 3, 0) ELSE size * p DIV 3 END AS lo, size * (p + 1) DIV 3 AS hi FROM (
  SELECT *, length(r) AS size, coalesce(sum(length(r)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({r})) LATERAL VIEW inline(array(struct(0, 0), struct(1, 0), struct(2, 0), struct(2, 1))) AS p, copy)"""


def http_requests(spark, sf_dir):
    """Requests out of single segments."""
    rows = spark.sql(_REQUEST.format(l="{lines}"), lines=source.log_lines(spark, sf_dir))
    found = segments.requests(rows.select("event_id", F.col("p").cast("binary").alias("payload")))
    return found.select("event_id", "method", "path", "host", "user_agent", "content_length", "header_len")


def http_responses(spark, sf_dir):
    """Responses out of flows whose segments overlap, repeat and come out of order."""
    lines = source.log_lines(spark, sf_dir)
    tasks = lines.rdd.getNumPartitions() * 4  # a line is four segments
    rows = spark.sql(_SEGMENTS.format(r=_RESPONSE.format(l="{lines}", hex="hex", text="STRING")), lines=lines.repartition(tasks, "user_id"))
    found = segments.responses(rows, MAX_BODY, tasks)
    return found.select("flow", "n", "status", "content_type", "content_length", F.octet_length("preview").alias("preview_bytes"), "preview_hash")


QUERIES = {f.__name__: f for f in (http_requests, http_responses)}


# ---- the same in DuckDB SQL: requests by patterns on the text, responses from the events without any bytes ----

_HEAD = r"regexp_extract(h, '(?is)^.*\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r?\n', 1)"

SQL = {
    "http_requests": rf"""WITH l AS ({LINES}), q AS ({_REQUEST.format(l="l")}), a AS (SELECT *, left(p, 8192) AS t FROM q WHERE regexp_matches(p, '^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE) [^\n]* HTTP/[^ \n]*\n')),
b AS (SELECT *, length(regexp_extract(t, '(?s)^.*?\n\r?\n')) AS header_len FROM a), c AS (SELECT *, CASE WHEN header_len > 0 THEN left(t, header_len) ELSE regexp_extract(t, '(?s)^.*\n') END AS h FROM b)
SELECT event_id, regexp_extract(h, '^[A-Z]+') AS method, regexp_extract(h, '^[A-Z]+ ([^\n]*) HTTP/', 1) AS path, {_HEAD.format(name="host")} AS host, {_HEAD.format(name="user-agent")} AS user_agent,
  CASE WHEN regexp_matches(h, '(?i)\ntransfer-encoding:[^\n]*chunked') THEN -2 ELSE coalesce(try_cast({_HEAD.format(name="content-length")} AS BIGINT), -1) END AS content_length, header_len FROM c""",
    "http_responses": f"""WITH l AS ({LINES}), x AS (SELECT *, 1 + event_id % 700 AS size, event_id % 5 AS form, count(*) FILTER (event_id % 101 = 7) OVER (PARTITION BY user_id ORDER BY event_id) AS ended FROM l),
b AS (SELECT *, CASE form WHEN 1 THEN repeat('x', size) || 'end' WHEN 2 THEN '' ELSE repeat((event_id % 10)::VARCHAR, size) END AS body FROM x WHERE ended = 0)
SELECT 'flow-' || user_id AS flow, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE form WHEN 2 THEN 204 ELSE status END AS status, CASE form WHEN 1 THEN 'text/x' || user_id WHEN 2 THEN '' ELSE 'text/html' END AS content_type,
  CASE form WHEN 1 THEN least(length(body), {MAX_BODY}) WHEN 2 THEN 0 ELSE size END AS content_length, least(length(body), {MAX_BODY}) AS preview_bytes, sha256(left(body, {MAX_BODY})) AS preview_hash FROM b""",
}
