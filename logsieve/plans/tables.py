"""Queries on tables of findings, decisions, responses and counters, all derived from the log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import evidence, store
from logsieve.plans.lines import LINES
from logsieve.sources.log_lines import log_lines

# Both engines read these.
_FINDINGS = """
SELECT event_id AS id, concat('evt_', cast(event_id % 4000 AS STRING)) AS event_id, ts, source_type, source_name, ip AS source_ip, user_id,
  CASE event_id % 7 WHEN 0 THEN 'malicious' WHEN 1 THEN 'alert' WHEN 2 THEN 'alert' WHEN 3 THEN 'recon' WHEN 4 THEN 'allow' ELSE 'suppress' END AS verdict,
  CASE WHEN k < 8 THEN method ELSE '' END AS http_method, path AS http_path, status AS http_status,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'pending' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'evidence_unavailable' ELSE 'resolved' END END AS resolution_status,
  CASE event_id % 4 WHEN 2 THEN 'evidence' ELSE '' END AS resolution_method, event_id % 6 = 0 AS downgraded, event_id % 5 = 0 AS notified, 'seen' AS reason, '' AS previous_verdict, '' AS downgrade_reason
FROM {lines}
"""
_DECISIONS = """
SELECT event_id AS id, cast(event_id AS STRING) AS event_id, ts, concat(source_type, ':', source_name) AS source_scope, concat('T', cast(event_id % 3 AS STRING)) AS tier,
  CASE event_id % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'noise' WHEN 2 THEN 'recon_failed' WHEN 3 THEN 'suspicious' ELSE 'malicious' END AS classification,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'corrected' ELSE 'ignored' END AS review_status, (event_id % 100) / 100.0D AS confidence
FROM {lines}
"""
_IDS = ["id", "event_id", "verdict", "source_ip", "http_path"]
NOW = "2024-03-01 00:00:00"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FINDINGS, lines=log_lines(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DECISIONS, lines=log_lines(spark, sf_dir))


def _now() -> F.Column:
    return F.to_timestamp(F.lit(NOW))


def recent_findings(spark, sf_dir):
    return store.recent(findings(spark, sf_dir), 100).select(*_IDS)


def findings_by_ip(spark, sf_dir):
    return store.recent(findings(spark, sf_dir), 500, source_ip="10.1.1.2", open_only=True).select(*_IDS)


def findings_by_verdict(spark, sf_dir):
    return store.recent(findings(spark, sf_dir), 500, verdict="malicious", open_only=True).select(*_IDS)


def unresolved_findings(spark, sf_dir):
    return store.waiting(findings(spark, sf_dir), _now(), 50).select(*_IDS)


def verdict_counts(spark, sf_dir):
    return store.verdict_counts(findings(spark, sf_dir), _now() - F.expr("INTERVAL 60 DAYS"))


def latest_by_event(spark, sf_dir):
    return store.latest(findings(spark, sf_dir)).select(*_IDS)


def _changes(spark, sf_dir) -> DataFrame:
    rows = findings(spark, sf_dir).where("id % 3 = 0").groupBy("event_id").agg(F.min("id").alias("m"))
    status = F.when(F.col("m") % 4 == 0, "evidence_unavailable").otherwise("resolved")
    verdict = F.when(F.col("m") % 5 == 0, "downgraded").when(F.col("m") % 5 == 1, "recon_failed").when(F.col("m") % 5 == 2, "malicious").otherwise("")
    return rows.select("event_id", status.alias("new_status"), F.when(F.col("m") % 2 == 0, "human_review").otherwise("rec_evidence").alias("new_method"), verdict.alias("new_verdict"))


def resolve_findings(spark, sf_dir):
    """Findings after resolutions by evidence, people and time-outs."""
    out = store.resolve(findings(spark, sf_dir), _changes(spark, sf_dir))
    return out.select("id", "event_id", "verdict", "resolution_status", "resolution_method", "previous_verdict", "downgraded", "downgrade_reason")


def override_verdict(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return store.override(rows, rows.where("id % 10 = 7").select("event_id"), "suppress", "by hand").select("id", "verdict", "downgraded", "notified", "reason")


def prune_findings(spark, sf_dir):
    return store.prune(findings(spark, sf_dir), _now()).select("id", "verdict")


def list_decisions(spark, sf_dir):
    return store.decisions(decisions(spark, sf_dir), tier="T1", least=0.2, most=0.9, scope_like="DEMO_nginx", limit=100, offset=20).select("id", "tier", "confidence", "source_scope")


def decision_counts(spark, sf_dir):
    return store.decision_counts(decisions(spark, sf_dir))


def upsert_endpoints(spark, sf_dir):
    """The last row of each expected endpoint after many upserts."""
    rows = findings(spark, sf_dir).select("http_method", "http_path", "http_status", "id", "verdict")
    old, new = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    return store.upsert(store.upsert(old.limit(0), old, ["http_method", "http_path", "http_status"], "id"), new, ["http_method", "http_path", "http_status"], "id")


def catch_all_candidates(spark, sf_dir):
    rows = log_lines(spark, sf_dir).select(F.col("source_name").alias("host"), "method", "status", F.lit("b").alias("body_hash"), "path")
    return store.catch_alls(rows).select("host", "method", "status", "paths", "responses", F.array_join("sample", ",").alias("sample"))


def bytes_fit(spark, sf_dir):
    other = F.col("bytes") + (F.col("event_id") % 900) - 450
    return log_lines(spark, sf_dir).select("event_id", evidence.orphan_bytes_fit(F.col("bytes"), other).alias("orphan"), evidence.catch_all_bytes_fit(F.col("bytes"), other).alias("catch_all"))


def hint_consensus(spark, sf_dir):
    kind = F.when(F.col("event_id") % 10 < 7, "ip").otherwise("user")
    rows = log_lines(spark, sf_dir).select(F.concat_ws(":", "source_type", "source_name").alias("scope"), F.col("event_id").alias("seq"), F.array(F.struct(kind.alias("type"), F.col("ip").alias("token"))).alias("fields"))
    return store.hint_consensus(rows)


def counter_rates(spark, sf_dir):
    rows = log_lines(spark, sf_dir).groupBy(F.col("source_name").alias("source"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("events"))
    return store.rates(rows, ["bytes", "events"])


def capture_changes(spark, sf_dir):
    rows = log_lines(spark, sf_dir)
    want = rows.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("pid"))
    have = rows.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") + F.col("event_id") % 5 % 2).alias("pid"))
    return evidence.capture_changes(want, have)


QUERIES = {f.__name__: f for f in (
    recent_findings, findings_by_ip, findings_by_verdict, unresolved_findings, verdict_counts, latest_by_event, resolve_findings, override_verdict, prune_findings,
    list_decisions, decision_counts, upsert_endpoints, catch_all_candidates, bytes_fit, hint_consensus, counter_rates, capture_changes,
)}


# ---- the same in DuckDB SQL ----


def _with(rest: str) -> str:
    plain = lambda x: x.format(lines="l").replace("STRING", "VARCHAR").replace("100.0D", "100.0::DOUBLE")
    return f"WITH l AS ({LINES}), f AS ({plain(_FINDINGS)}), d AS ({plain(_DECISIONS)}) {rest}"


_OUT = ", ".join(_IDS)
_OPEN = "coalesce(resolution_status, '') IN ('', 'pending')"
_TAKE = f"(new_status IS NOT NULL AND ({_OPEN} OR (resolution_status = 'evidence_unavailable' AND new_status = 'resolved')))"
SQL = {
    "recent_findings": _with(f"SELECT {_OUT} FROM f ORDER BY ts DESC, id DESC LIMIT 100"),
    "findings_by_ip": _with(f"SELECT {_OUT} FROM f WHERE source_ip = '10.1.1.2' AND {_OPEN} ORDER BY ts DESC, id DESC LIMIT 500"),
    "findings_by_verdict": _with(f"SELECT {_OUT} FROM f WHERE verdict = 'malicious' AND {_OPEN} ORDER BY ts DESC, id DESC LIMIT 500"),
    "unresolved_findings": _with(f"SELECT {_OUT} FROM f WHERE {_OPEN} AND verdict IN ('alert', 'malicious') AND http_method <> '' AND NOT downgraded AND ts < TIMESTAMP '{NOW}' ORDER BY ts, id LIMIT 50"),
    "verdict_counts": _with(f"SELECT verdict, count(*) AS n FROM f WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY GROUP BY verdict"),
    "latest_by_event": _with(f"SELECT {_OUT} FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1"),
    "resolve_findings": _with(f""", c AS (SELECT event_id, CASE WHEN min(id) % 4 = 0 THEN 'evidence_unavailable' ELSE 'resolved' END AS new_status, CASE WHEN min(id) % 2 = 0 THEN 'human_review' ELSE 'rec_evidence' END AS new_method, CASE min(id) % 5 WHEN 0 THEN 'downgraded' WHEN 1 THEN 'recon_failed' WHEN 2 THEN 'malicious' ELSE '' END AS new_verdict FROM f WHERE id % 3 = 0 GROUP BY 1),
lv AS (SELECT event_id, arg_max(verdict, id) AS latest FROM f GROUP BY 1), y AS (SELECT f.*, c.* EXCLUDE (event_id), latest, {_TAKE} AS take, {_TAKE} AND new_status = 'resolved' AND new_verdict IN ('downgraded', 'recon_failed') AS down FROM f JOIN lv USING (event_id) LEFT JOIN c USING (event_id))
SELECT id, event_id, CASE WHEN take AND new_verdict <> '' THEN new_verdict ELSE verdict END AS verdict, CASE WHEN take THEN new_status ELSE resolution_status END AS resolution_status, CASE WHEN take THEN new_method ELSE resolution_method END AS resolution_method, CASE WHEN take THEN latest ELSE previous_verdict END AS previous_verdict,
  down OR downgraded AS downgraded, CASE WHEN down THEN new_method || ' resolution' ELSE downgrade_reason END AS downgrade_reason FROM y"""),
    "override_verdict": _with("SELECT id, CASE WHEN h THEN 'suppress' ELSE verdict END AS verdict, h OR downgraded AS downgraded, NOT h AND notified AS notified, CASE WHEN h THEN 'by hand' ELSE reason END AS reason FROM (SELECT *, event_id IN (SELECT event_id FROM f WHERE id % 10 = 7) AS h FROM f)"),
    "prune_findings": _with(f"SELECT id, verdict FROM f WHERE NOT ((verdict IN ('allow', 'suppress') AND ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) OR ((verdict = 'recon' OR downgraded) AND ts < TIMESTAMP '{NOW}' - INTERVAL 90 DAY))"),
    "list_decisions": _with("SELECT id, tier, confidence, source_scope FROM d WHERE tier = 'T1' AND confidence BETWEEN 0.2 AND 0.9 AND source_scope ILIKE '%DEMO_nginx%' ORDER BY id DESC LIMIT 100 OFFSET 20"),
    "decision_counts": _with("SELECT 'total' AS kind, '' AS value, count(*) AS n FROM d UNION ALL SELECT 'tier', tier, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'classification', classification, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'review_status', review_status, count(*) FROM d GROUP BY 2"),
    "upsert_endpoints": _with("SELECT http_method, http_path, http_status, id, verdict FROM f QUALIFY row_number() OVER (PARTITION BY http_method, http_path, http_status ORDER BY id % 2 DESC, id DESC) = 1"),
    "catch_all_candidates": _with(", g AS (SELECT source_name AS host, method, status, path, count(*) AS n FROM l WHERE method IN ('GET', 'HEAD') GROUP BY ALL) SELECT host, method, status, count(*) AS paths, sum(n)::BIGINT AS responses, array_to_string((list(path ORDER BY path))[1:10], ',') AS sample FROM g GROUP BY ALL HAVING count(*) >= 5"),
    "bytes_fit": _with(", b AS (SELECT event_id, bytes AS a, bytes + event_id % 900 - 450 AS o FROM l) SELECT event_id, NOT (a > 0 AND o > 0) OR abs(a - o) <= greatest(a // 10, 256) AS orphan, a > 0 AND o > 0 AND abs(a - o) <= greatest(o * 15 // 100, 256) AS catch_all FROM b"),
    "hint_consensus": _with(", h AS (SELECT source_type || ':' || source_name AS scope, event_id, CASE WHEN event_id % 10 < 7 THEN 'ip' ELSE 'user' END AS type, ip FROM l), s AS (SELECT scope, count(*) AS lines FROM h GROUP BY 1) SELECT scope, type, count(*) AS n, arg_max(ip, event_id) AS example, lines FROM h JOIN s USING (scope) GROUP BY scope, type, lines HAVING lines >= 20 AND count(*) >= floor(lines * 0.6)"),
    "counter_rates": _with(", s AS (SELECT source_name AS source, date_trunc('day', ts)::TIMESTAMP AS ts, sum(bytes)::BIGINT AS bytes, count(*) AS events FROM l GROUP BY 1, 2) SELECT source, ts, CASE WHEN bytes >= lag(bytes) OVER w THEN bytes - lag(bytes) OVER w ELSE bytes END AS bytes, CASE WHEN events >= lag(events) OVER w THEN events - lag(events) OVER w ELSE events END AS events FROM s WINDOW w AS (PARTITION BY source ORDER BY ts)"),
    "capture_changes": _with("SELECT coalesce(a.event_id, b.event_id) AS id, CASE WHEN b.event_id IS NULL THEN 'open' WHEN a.event_id IS NULL THEN 'close' WHEN a.user_id <> b.user_id + b.event_id % 5 % 2 THEN 'repair' ELSE 'keep' END AS action FROM (SELECT * FROM l WHERE event_id % 2 = 0) a FULL JOIN (SELECT * FROM l WHERE event_id % 3 = 0) b ON a.event_id = b.event_id"),
}
