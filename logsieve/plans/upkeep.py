"""Queries of what keeps the engine's tables: change logs, lists of networks and rules, retries, coverage and counters, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import http
from logsieve.operators import classify, networks, retry, reviews, store
from logsieve.operators import patterns as p
from logsieve.plans import tables, verdicts
from logsieve.plans.lines import LINES, with_norm
from logsieve.sources import journal
from logsieve.sources.log_lines import log_lines
from logsieve.sources.tables import cut, held, shared_dir
from logsieve.streaming import changelog

#: Patterns that were learned between the first and the second try.
LATER = [("docker:api-backend", "suppress", "prefix", "GET /api/keys/1", "llm", "first keys", False, 40), ("docker:api-backend", "alert", "contains", "/keys/2", "human", "second keys", False, 41)]
RULE_KEYS = ["http_method", "http_path", "http_status"]
CHANGE = "http_method string, http_path string, http_status int, event_id bigint, description string, op string"


def trusted_networks(spark, sf_dir):
    """Whether each line's address lies in a network around another line's, of any prefix length."""
    rows = log_lines(spark, sf_dir)
    bits = F.when(F.col("event_id") % 35 == 1, 40).otherwise(25 + F.col("user_id") % 8)
    listed = rows.where("event_id % 7 = 1").select(F.lit("").alias("ip_address"), F.concat_ws("/", "ip", bits).alias("cidr"))
    return networks.with_trust(rows, listed, "ip").select("event_id", "ip", "trusted")


def trusted_statements(spark, sf_dir):
    """What becomes of every line's wish to have its address or network trusted."""
    e = F.col("event_id")
    rows = log_lines(spark, sf_dir)
    listed = rows.where("event_id % 50 = 0").select(e.alias("id"), F.col("ip").alias("ip_address"), F.lit(None).cast("string").alias("cidr"))
    ip = F.when(e % 4 == 1, F.concat(F.lit("x"), "ip")).when(e % 4 == 2, "").otherwise(F.col("ip"))
    net = F.when(e % 3 == 0, F.concat("ip", F.lit("/24"))).when(e % 3 == 1, "").otherwise(F.concat_ws("/", "ip", e % 40))
    return networks.refused(rows.where("event_id % 50 <> 0").select(e.alias("id"), ip.alias("ip_address"), net.alias("cidr")), listed).select("id", "fault")


def rule_log(spark, sf_dir):
    """Rules for endpoints out of a log of four batches, one of which came twice, compacted half-way."""
    gone = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("upsert")
    rows = log_lines(spark, sf_dir).select(F.col("method").alias("http_method"), F.col("path").alias("http_path"), F.col("status").alias("http_status"), "event_id", F.concat_ws("-", "source_name", "user_id").alias("description"), gone.alias("op"))
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    part = lambda i: rows.where(F.col("event_id") % 4 == i)
    write = changelog.writer(f"{path}/old")
    for i in (0, 1, 1):
        write(part(i), i)
    write = changelog.writer(f"{path}/new", after=changelog.compact(spark, f"{path}/old", f"{path}/new", CHANGE, RULE_KEYS, "event_id"))
    for i in (1, 2, 3):
        write(part(i), i)
    return changelog.current(changelog.changes(spark, f"{path}/new", CHANGE), RULE_KEYS, "event_id")


def shed_findings(spark, sf_dir):
    """What is written of findings in batches of several sizes when there is room for a third of them."""
    rows = tables.findings(spark, sf_dir).withColumn("part", F.expr("CASE WHEN id % 8 < 5 THEN 0 WHEN id % 8 < 7 THEN 1 ELSE 2 END")).select("id", "verdict", "part")
    path, room = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}", rows.count() // 3
    write = changelog.writer(path, room=room)
    for i in range(3):
        write(rows.where(F.col("part") == i), i)
    return changelog.changes(spark, path, "id bigint, verdict string, part int").select("id", "verdict", "batch")


def audit_rows(spark, sf_dir):
    """Decisions as they enter the audit table."""
    return reviews.audit(tables.decisions(spark, sf_dir)).select("id", "event_id", "tier", "review_status")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_id") % 3 == 0, "mixed").otherwise("benign")
    return log_lines(spark, sf_dir).select(F.col("source_name").alias("host"), F.col("method").alias("http_method"), F.col("status").alias("http_status"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("body_preview_hash"), "event_id", verdict.alias("verdict"), F.col("ts").alias("verified_at"))


def catch_all_statements(spark, sf_dir):
    """Stored catch-all rules that are loaded, after upserts and deletes."""
    keys, new = ["host", "http_method", "http_status", "body_preview_hash"], _rules(spark, sf_dir)
    table = store.upsert(new.where("event_id < 0"), new, keys, "event_id")
    left = store.without(table, new.where("http_status = 404 AND event_id % 2 = 0").select(*keys), keys)
    return store.loaded_catch_alls(left).select(*keys, "event_id")


def endpoint_statements(spark, sf_dir):
    """Expected endpoints after upserts and deletes by their whole key."""
    keys = ["host", "http_method", "http_path", "http_status", "body_preview_hash"]
    new = _rules(spark, sf_dir).withColumn("http_path", F.concat(F.lit("/p"), F.col("event_id") % 11))
    table = store.upsert(new.where("event_id < 0"), new, keys, "event_id")
    return store.without(table, new.where("event_id % 9 = 2").select(*keys), keys).select(*keys, "event_id")


def covered_containers(spark, sf_dir):
    """Containers by what becomes of them: watched, beyond the most of their host, left out or passed over."""
    e = F.col("event_id")
    port = F.struct(F.when(e % 6 == 0, "127.0.0.1").otherwise("0.0.0.0").alias("ip"), F.lit(80).alias("private"), F.lit(8080).alias("public"), F.lit("tcp").alias("type"), F.lit("ingress").alias("publish_mode"))
    rows = log_lines(spark, sf_dir).select(e.cast("string").alias("id"), F.concat_ws("-", "source_name", e % 3).alias("host"), F.array(F.concat(F.lit("/app"), F.col("user_id") % 40)).alias("names"), F.array(port).alias("ports"))
    return journal.covered(journal.discovered(rows, ["app7"])).select("id", "host", "name", "class")


def coverage_report(spark, sf_dir):
    return covered_containers(spark, sf_dir).groupBy("host", "class").agg(F.count("*").alias("n"))


def retried_events(spark, sf_dir):
    """Events that a busy classifier left without an answer, after a second try."""
    busy = lambda i: lambda groups: classify.by_rules(groups.where(F.col("leader") % 3 == i))
    # a decided event is neither asked, nor learned from, nor tried again
    asked = verdicts._decided(spark, sf_dir).select(*classify.DECIDED).where(held(F.col("verdict") == "unknown"))
    first = cut(classify.with_classifier(asked, busy(0)), "first")
    # every look-up of patterns reads them
    known = cut(p.learn(p.patterns(spark, verdicts.PATTERNS + LATER), classify.learned(first)), "known")
    now = F.to_timestamp(F.lit(tables.NOW))
    waiting = retry.deferred(first.where("verdict = 'unknown'"), now)
    out = cut(retry.retried(retry.due(waiting, now + F.expr("INTERVAL 1 MINUTE")), known, busy(1)), "retried")
    again = retry.deferred(out.where("verdict = 'unknown'"), now)
    out = out.where("verdict <> 'unknown'").unionByName(again.select(*out.columns))
    return out.select("event_id", "verdict", "via", "tier", "reason", "attempts", F.unix_seconds("next_at").alias("next_at"))


def pipeline_counters(spark, sf_dir):
    """Counters of the whole cascade."""
    out = cut(classify.with_classifier(verdicts._decided(spark, sf_dir).select(*classify.DECIDED)), "counted")
    return store.pipeline_counters(out, classify.learned(out))


QUERIES = {f.__name__: f for f in (
    trusted_networks, trusted_statements, rule_log, shed_findings, audit_rows, catch_all_statements, endpoint_statements, covered_containers, coverage_report, retried_events, pipeline_counters,
)}


# ---- the same in DuckDB SQL ----

_N = "list_sum(list_transform([1, 2, 3, 4], lambda i: split_part({c}, '.', i)::BIGINT << (32 - 8 * i)))::BIGINT"
_VALID = "regexp_matches(a, '" + http.IPV4.replace("(?:", "(") + "')"
_NET = "regexp_matches(cidr, '" + http.IPV4.replace("(?:", "(").removesuffix("$") + "/(3[0-2]|[12]?[0-9])$')"
_RULES = "r AS (SELECT source_name AS host, method AS http_method, status AS http_status, 'b' || user_id % 5 AS body_preview_hash, '/p' || event_id % 11 AS http_path, event_id, CASE WHEN event_id % 3 = 0 THEN 'mixed' ELSE 'benign' END AS verdict FROM l)"
_COVERED = """c AS (SELECT event_id::VARCHAR AS id, source_name || '-' || event_id % 3 AS host, 'app' || user_id % 40 AS name, CASE WHEN event_id % 6 = 0 THEN 'skipped' WHEN user_id % 40 = 7 THEN 'excluded' ELSE 'public' END AS class FROM l),
d AS (SELECT id, host, name, CASE WHEN class = 'public' AND row_number() OVER (PARTITION BY host, class ORDER BY name, id) > 16 THEN 'dropped_by_cap' ELSE class END AS class FROM c)"""
_LATER = ", ".join(f"({', '.join(repr(x) if isinstance(x, str) else str(x).lower() for x in row)})" for row in LATER)


def _with(rest: str) -> str:
    return f"WITH l AS ({LINES}), {rest}"


SQL = {
    "trusted_networks": _with(f"""n AS (SELECT DISTINCT {_N.format(c="ip")} AS n, 25 + user_id % 8 AS bits FROM l WHERE event_id % 7 = 1 AND event_id % 35 <> 1), w AS (SELECT n - n % (1::BIGINT << (32 - bits)) AS lo, n - n % (1::BIGINT << (32 - bits)) + (1::BIGINT << (32 - bits)) - 1 AS hi FROM n),
a AS (SELECT DISTINCT ip, {_N.format(c="ip")} AS n FROM l), y AS (SELECT DISTINCT ip FROM a JOIN w ON n BETWEEN lo AND hi) SELECT event_id, ip, ip IN (SELECT ip FROM y) AS trusted FROM l"""),
    "trusted_statements": _with(f"""o AS (SELECT DISTINCT ip FROM l WHERE event_id % 50 = 0), x AS (SELECT event_id AS id, CASE event_id % 4 WHEN 1 THEN 'x' || ip WHEN 2 THEN '' ELSE ip END AS a, CASE event_id % 3 WHEN 0 THEN ip || '/24' WHEN 1 THEN '' ELSE ip || '/' || event_id % 40 END AS cidr FROM l WHERE event_id % 50 <> 0),
y AS (SELECT *, CASE WHEN a = '' AND cidr = '' THEN 'either ip_address or cidr must be provided' WHEN cidr <> '' AND NOT {_NET} THEN 'invalid CIDR "' || cidr || '"' WHEN a <> '' AND NOT {_VALID} THEN 'invalid IP address "' || a || '"' END AS own FROM x),
ma AS (SELECT a, min(id) AS ia FROM y WHERE own IS NULL AND a <> '' GROUP BY 1), mc AS (SELECT cidr, min(id) AS ic FROM y WHERE own IS NULL AND cidr <> '' GROUP BY 1)
SELECT id, CASE WHEN own IS NOT NULL THEN own WHEN a IN (SELECT ip FROM o) OR ia < id THEN 'IP ' || a || ' already trusted' WHEN ic < id THEN 'CIDR ' || cidr || ' already trusted' END AS fault FROM y LEFT JOIN ma USING (a) LEFT JOIN mc USING (cidr)"""),
    "rule_log": _with("x AS (SELECT method AS http_method, path AS http_path, status AS http_status, event_id, source_name || '-' || user_id AS description FROM l QUALIFY row_number() OVER (PARTITION BY method, path, status ORDER BY event_id % 4 DESC, event_id DESC) = 1) SELECT * FROM x WHERE event_id % 7 <> 0"),
    "shed_findings": _with("f AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'malicious' WHEN 1 THEN 'alert' WHEN 2 THEN 'alert' WHEN 3 THEN 'recon' WHEN 4 THEN 'allow' ELSE 'suppress' END AS verdict, CASE WHEN event_id % 8 < 5 THEN 0 WHEN event_id % 8 < 7 THEN 1 ELSE 2 END::BIGINT AS batch FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS size, count(*) OVER () // 3 AS room FROM f) SELECT id, verdict, batch FROM n WHERE size <= room OR verdict IN ('malicious', 'alert')"),
    "audit_rows": _with("d AS (SELECT event_id AS id, event_id::VARCHAR AS event_id, 'T' || event_id % 3 AS tier FROM l) SELECT *, 'pending' AS review_status FROM d"),
    "catch_all_statements": _with(f"{_RULES}, t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY host, http_method, http_status, body_preview_hash ORDER BY event_id DESC) = 1) SELECT host, http_method, http_status, body_preview_hash, event_id FROM t WHERE verdict = 'benign' AND (host, http_method, http_status, body_preview_hash) NOT IN (SELECT (host, http_method, http_status, body_preview_hash) FROM r WHERE http_status = 404 AND event_id % 2 = 0)"),
    "endpoint_statements": _with(f"{_RULES}, t AS (SELECT host, http_method, http_path, http_status, body_preview_hash, max(event_id) AS event_id, bool_or(event_id % 9 = 2) AS gone FROM r GROUP BY 1, 2, 3, 4, 5) SELECT * EXCLUDE (gone) FROM t WHERE NOT gone"),
    "covered_containers": _with(f"{_COVERED} SELECT * FROM d"),
    "coverage_report": _with(f"{_COVERED} SELECT host, class, count(*) AS n FROM d GROUP BY 1, 2"),
    # undecided lines disclose nothing and hold no marks, so that the stand-in finds them safe
    "retried_events": with_norm(f""", {verdicts._DECIDED}, w AS (SELECT *, min(event_id) OVER (PARTITION BY scope, hash, disclosure) AS leader FROM dec WHERE verdict = 'unknown'), later(scope, bucket, tier, value, source, reason, revoked, ord) AS (VALUES {_LATER}),
m AS (SELECT w.event_id, leader, q.bucket, q.tier AS m_tier, q.reason AS m_reason, q.source FROM w LEFT JOIN later q ON q.scope = w.scope AND CASE q.tier WHEN 'prefix' THEN starts_with(w.normalized, q.value) ELSE contains(w.normalized, q.value) END WHERE leader % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY w.event_id ORDER BY q.bucket) = 1)
SELECT event_id, CASE WHEN bucket IS NOT NULL THEN bucket WHEN leader % 3 = 1 THEN 'allow' ELSE 'unknown' END AS verdict, CASE WHEN bucket IS NOT NULL THEN source || '_retry' WHEN leader % 3 = 1 THEN 'llm_retry' ELSE 'unknown' END AS via, m_tier AS tier, CASE WHEN bucket IS NOT NULL THEN m_reason WHEN leader % 3 = 1 THEN 'nothing of note' END AS reason,
  CASE WHEN bucket IS NULL AND leader % 3 = 2 THEN 2 ELSE 1 END AS attempts, epoch(TIMESTAMP '{tables.NOW}')::BIGINT + CASE WHEN bucket IS NULL AND leader % 3 = 2 THEN 120 ELSE 60 END AS next_at FROM m"""),
    "pipeline_counters": with_norm(f""", {verdicts._LLM}, one AS (SELECT count(*) AS processed, count(*) FILTER (tier IS NOT NULL) AS pattern_hits, count(*) FILTER (via = 'noise_filter') AS noise_suppressed, count(*) FILTER (via = 'policy') AS policy_hits, count(*) FILTER (got AND leader = event_id) AS llm_calls, count(*) FILTER (got AND leader = event_id AND NOT (verdict IN ('allow', 'suppress') AND (disclosure OR marked))) AS patterns_learned FROM cls)
UNPIVOT one ON COLUMNS(*) INTO NAME counter VALUE n"""),
}
