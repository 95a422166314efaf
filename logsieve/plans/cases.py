"""Queries of investigation, review, learning, sources and notification, with their SQL. What they work on is rendered from the log lines by one template for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import alerts, answers, http, redact
from logsieve.functions import normalize as n
from logsieve.functions import text as t
from logsieve.operators import classify, evidence, investigate, patterns, policy, reviews, store
from logsieve.plans.lines import LINES, with_norm
from logsieve.sources import journal
from logsieve.sources.log_lines import log_lines
from logsieve.sources.tables import cut, spread

_NL = "chr(10)"
# Templates for both engines: @lines are the log lines, @sha(x@) is SHA-256 in hexadecimal, @sec(x) an interval of x seconds.
_BODY = f"""CASE event_id % 5 WHEN 0 THEN concat('DB_USER=app', {_NL}, 'API_KEY=k', CAST(event_id % 3 AS STRING))
  WHEN 1 THEN concat('root:x:0:0:root:/root:/bin/bash', {_NL}, 'u', CAST(event_id % 4 AS STRING), ':x:5:5:a:b:c') WHEN 2 THEN 'just words' WHEN 3 THEN '' ELSE concat('A_B=', CAST(event_id % 2 AS STRING), {_NL}, 'C_D=2') END"""
_RESPONSES = f"""
SELECT event_id * 2 + copy AS resp_seq, ts + @sec(event_id % 7) AS resp_ts, CASE WHEN event_id % 5 = 0 THEN '' ELSE method END AS resp_method, CASE WHEN event_id % 5 = 0 THEN '' ELSE path END AS resp_path,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('h', CAST(event_id % 4 AS STRING)) END AS resp_host, concat('agent', CAST(event_id % 2 AS STRING)) AS resp_agent, CASE WHEN event_id % 17 = 0 THEN NULL ELSE status END AS resp_status,
  CASE WHEN event_id % 11 = 0 THEN 36 WHEN event_id % 19 = 0 THEN 0 ELSE bytes END AS content_length, 'text/plain' AS content_type, {_BODY} AS body, @sha(concat({_BODY}, CAST(status AS STRING))@) AS body_hash,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + @sec(event_id % 7 - event_id % 6) END AS request_ts
FROM (SELECT l.*, c.copy FROM @lines l CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c WHERE k < 8 AND (c.copy = 0 OR event_id % 13 = 0)) r
"""
_ALERTS = """
SELECT event_id, ts, CASE WHEN event_id % 10 = 9 THEN '' ELSE method END AS method, path, CASE WHEN event_id % 6 = 5 THEN '' ELSE concat('h', CAST(event_id % 4 AS STRING)) END AS host, concat('agent', CAST(event_id % 3 AS STRING)) AS user_agent,
  CASE WHEN event_id % 8 = 4 THEN 0 ELSE status END AS status, CASE WHEN event_id % 9 = 8 THEN 0 ELSE bytes END AS bytes, CASE WHEN event_id % 2 = 0 THEN 'alert' ELSE 'malicious' END AS verdict,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'malicious' WHEN 2 THEN 'suspicious' ELSE 'recon_success' END AS classification, 'seen' AS reason
FROM @lines WHERE k < 8 AND event_id % 3 <> 1
"""
_FINDINGS = """
SELECT event_id AS id, concat('evt_', CAST(event_id - event_id % 3 AS STRING)) AS event_id, ts, source_type, source_name, ip AS source_ip, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('h', CAST(event_id % 4 AS STRING)) END AS dest_host,
  CASE WHEN k < 9 THEN method ELSE '' END AS http_method, CASE WHEN k < 9 THEN concat(path, '?a=1') ELSE '' END AS http_path, status AS http_status, bytes AS response_bytes,
  CASE event_id % 5 WHEN 0 THEN 'malicious' WHEN 1 THEN 'alert' WHEN 2 THEN 'recon' WHEN 3 THEN 'allow' ELSE 'suppress' END AS verdict, CASE WHEN event_id % 6 = 1 THEN '' ELSE @sha(line@) END AS normalized_hash,
  CASE WHEN event_id % 3 = 0 THEN concat('p', CAST(event_id % 11 AS STRING)) ELSE '' END AS matched_pattern_value, CASE WHEN event_id % 3 = 0 THEN 'allow' ELSE '' END AS matched_pattern_bucket, CASE WHEN event_id % 9 = 0 THEN 'docker:other' ELSE '' END AS matched_pattern_scope,
  CASE WHEN event_id % 4 = 0 THEN 200 ELSE 0 END AS evidence_status_code, CASE event_id % 4 WHEN 0 THEN @sha(concat('b', CAST(event_id % 13 AS STRING))@) WHEN 1 THEN 'short' ELSE '' END AS evidence_body_hash,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'pending' WHEN 2 THEN 'resolved' ELSE 'evidence_unavailable' END AS resolution_status, '' AS resolution_method, '' AS previous_verdict, event_id % 6 = 0 AS downgraded, '' AS downgrade_reason
FROM @lines
"""
_DECISIONS = """
SELECT event_id * 3 AS id, concat('evt_', CAST(event_id - event_id % 6 AS STRING)) AS event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'T1' ELSE 'reclassify' END AS tier, concat(source_type, ':', source_name) AS source_scope,
  @sha(concat(line, 'd')@) AS normalized_hash, @sha(concat('e', CAST(event_id % 5 AS STRING))@) AS evidence_hash, CASE WHEN event_id % 5 = 0 THEN 0 ELSE status END AS evidence_status, CASE WHEN event_id % 3 = 0 THEN 'odd' ELSE @sha(concat('c', CAST(event_id % 7 AS STRING))@) END AS cache_key,
  'allow' AS action, event_id % 5 < 2 AS pattern_learned, concat('q', CAST(event_id % 6 AS STRING)) AS pattern_value, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'suppress' END AS pattern_bucket,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE NULL END AS review_status, '' AS review_verdict, '' AS review_reason, event_id % 50 = 0 AS pattern_deleted
FROM @lines
"""
_CORRECTIONS = """
SELECT concat('evt_', CAST(event_id AS STRING)) AS event_id, CASE event_id % 11 % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'failed_probe' WHEN 2 THEN 'expected_endpoint' ELSE 'confirm' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'allow' WHEN event_id % 4 = 1 THEN 'suppress' ELSE 'alert' END AS target, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('r', CAST(event_id % 10 AS STRING)) END AS reason, ts AS at
FROM @lines WHERE event_id % 3 = 0
"""
_RULES = """
SELECT DISTINCT concat('h', CAST(event_id % 4 AS STRING)) AS host, method AS http_method, status AS http_status, @sha(concat(CAST(event_id % 4 AS STRING), CAST(status AS STRING))@) AS body_preview_hash,
  CASE WHEN status = 403 THEN 'rejected' WHEN event_id % 4 = 1 THEN 'benign' ELSE 'verified' END AS verdict, 'same page' AS reason, CAST(300 + event_id % 4 * 500 AS BIGINT) AS response_bytes, CAST(5 + event_id % 4 AS BIGINT) AS paths
FROM @lines WHERE k < 8
"""
# pages of three hosts that a decision may meet
_PAGES = f"""
SELECT DISTINCT concat('h', CAST(event_id % 4 AS STRING)) AS host, method AS http_method, status AS http_status, @sha(concat({_BODY}, CAST(status AS STRING))@) AS body_preview_hash,
  CASE WHEN status = 401 THEN 'rejected' WHEN event_id % 4 = 1 THEN 'benign' ELSE 'verified' END AS verdict, 'same page' AS reason, CAST(300 + event_id % 4 * 500 AS BIGINT) AS response_bytes, CAST(5 + event_id % 4 AS BIGINT) AS paths
FROM @lines WHERE k < 8 AND event_id % 4 < 3 AND event_id % 5 IN (1, 2, 3)
"""
_CHECKED = """
SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + @sec((event_id - event_id % 256) / 256) AS ts, concat('x', line, CASE WHEN event_id % 3 = 0 THEN concat('/v', token, 'f') ELSE '' END) AS line, token, TIMESTAMP '2024-01-01 00:00:00' + @sec((event_id - event_id % 256) / 256 - event_id % 13) AS minted
FROM (SELECT *, concat('OV-', substr(@sha(concat('t', CAST(event_id - event_id % 12 AS STRING))@), 1, 32)) AS token FROM @lines) x
"""
_ENTRIES = """
SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'no json' WHEN 1 THEN concat('{"MESSAGE":"","_COMM":"c', CAST(event_id AS STRING), '"}') WHEN 2 THEN concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","_SYSTEMD_UNIT":"cron.service"}')
  WHEN 3 THEN concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","_COMM":"bash","_UID":"0","PRIORITY":null}') WHEN 4 THEN concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","_SYSTEMD_UNIT":"own.service"}')
  WHEN 5 THEN '{"MESSAGE":[104,105],"_COMM":"x"}' WHEN 6 THEN concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","PRIORITY":6}') WHEN 7 THEN concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","_COMM":"x"') WHEN 8 THEN '[{"MESSAGE":"m"}]' WHEN 9 THEN '{"MESSAGE":"m","_UID":{"a":"b"}}'
  ELSE concat('{"MESSAGE":"m', CAST(event_id AS STRING), '","SYSLOG_IDENTIFIER":"sshd","_COMM":"x","_SYSTEMD_UNIT":"ssh.service","PRIORITY":"6","_TRANSPORT":"syslog","OTHER":[1],"__REALTIME_TIMESTAMP":"', CAST(1700000000000000 + event_id AS STRING), '"}') END AS value
FROM @lines
"""
_POLICY = """
SELECT event_id, ts, CASE WHEN event_id % 13 = 12 THEN 'docker' ELSE 'journal' END AS source_type, CASE event_id % 9 WHEN 4 THEN 'sudo' WHEN 8 THEN 'su' ELSE 'sshd' END AS source_name,
  CASE event_id % 5 WHEN 0 THEN 'ssh.service' WHEN 1 THEN 'sshd@x.service' WHEN 2 THEN 'SSH.socket' WHEN 3 THEN '' ELSE 'app.service' END AS unit, ip,
  CASE event_id % 9 WHEN 0 THEN concat('Accepted publickey for root from ', ip, ' port 22') WHEN 1 THEN concat('new user:  name=u', CAST(user_id AS STRING), ', UID=1') WHEN 2 THEN concat('add ''u', CAST(user_id AS STRING), ''' to group ''Sudo''')
    WHEN 3 THEN concat('usermod -x -aG docker,wheel u', CAST(user_id AS STRING)) WHEN 4 THEN 'pam: authentication failure; sudo' WHEN 5 THEN 'wrote /root/.ssh/Authorized_Keys' WHEN 6 THEN 'pam_unix(sshd:session): session opened for user bob'
    WHEN 7 THEN concat('Accepted password for ann from fe80::1 port ', CAST(event_id AS STRING)) ELSE 'u : incorrect password attempt' END AS line
FROM @lines
"""
NOW = "2024-03-01 00:00:00"
_MEANS = ["safe", "noise", "recon_failed", "recon_success", "suspicious", "malicious", "odd"]



def _table(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    sql = template.replace("@sha(", "sha2(").replace("@)", ", 256)").replace("@sec(", "make_interval(0, 0, 0, 0, 0, 0, ").replace("{", "{{").replace("}", "}}").replace("@lines", "{lines}")
    return spark.sql(sql, lines=log_lines(spark, sf_dir))


def _with(rest: str, **tables: str) -> str:
    """A DuckDB query with the log lines as l and templates under the given names."""
    plain = lambda x: x.replace("@sha(", "sha256(").replace("@)", ")").replace("@sec(", "to_seconds(").replace("@lines", "l").replace("AS STRING)", "AS VARCHAR)")
    return "WITH " + ", ".join([f"l AS ({LINES})", *(f"{k} AS ({plain(v)})" for k, v in tables.items())]) + f" {rest}"


# ---- scalars ----


def log_unescape(spark, sf_dir):
    slash = F.lit("\\")
    path = F.concat("path", slash, F.lit("x22b"), slash, F.lit("x5Cx5C"), slash, F.lit("xZZ"), slash, F.lit("xc3"), slash, F.lit("xA9"), slash)
    return log_lines(spark, sf_dir).select("event_id", t.log_unescape(path).alias("decoded"))


def text_scalars(spark, sf_dir):
    rows = log_lines(spark, sf_dir)
    phone, url, tag = F.concat(F.lit("+49"), "event_id"), F.concat(F.lit("https://example.com/a/very/long/way/to/go"), "path"), F.concat(F.lit("<a href='"), "path", F.lit("'>&amp;</a>"))
    pairs = F.concat(F.lit("A = 1, B=x=y ,none,A="), "event_id")
    return rows.select(
        "event_id", t.mask_phone(phone).alias("phone"), t.short_url(url).alias("url"), t.html_escape(tag).alias("escaped"), t.truncate(F.col("line"), 40).alias("cut"), t.header_map(pairs)["A"].alias("a"), t.header_map(pairs)["B"].alias("b"),
        F.array_join(t.csv_set(F.concat(F.lit(" Cron, ,sshd,CRON,"), "source_name")), "+").alias("names"), n.short_id(F.sha2("line", 256)).alias("short"), F.lower(n.container_base(F.concat(F.lit("/App.1."), "source_name"))).alias("base"),
    )


# ---- a model's answers and what is learned from them ----


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _MEANS)), (F.col("event_id") % 7 + 1).cast("int"))
    plain = F.concat(F.lit('{"classification":"'), kind, F.lit('","action":"allow","confidence":0.'), F.col("event_id") % 10, F.lit(',"reason":"r","pattern_type":"prefix","pattern":"p'), "event_id", F.lit('"}'))
    regex = F.concat(F.lit('{"classification":"'), kind, F.lit('","reason":"a\\d+\\-b \\"q\\"","pattern":"^x\\s"}'))
    at = F.col("event_id") % 6
    text = F.when(at == 0, plain).when(at == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(at == 2, F.concat(F.lit("  ```\n"), regex, F.lit("\n```  "))).when(at == 3, F.lit("I think it is safe")).when(at == 4, regex).otherwise(F.lit('["safe"]'))
    return log_lines(spark, sf_dir).select("event_id", kind.alias("kind"), text.alias("content"))


def parse_answers(spark, sf_dir):
    return answers.with_parsed(_answers(spark, sf_dir), "content", "a").select("event_id", "a.*")


def severity_moves(spark, sf_dir):
    after = F.element_at(F.array(*map(F.lit, _MEANS)), (F.floor(F.col("event_id") / 7) % 7 + 1).cast("int"))
    rows = _answers(spark, sf_dir)
    return rows.select("event_id", answers.downgrades(F.col("kind"), after).alias("down"), answers.escalates(F.col("kind"), after).alias("up"), answers.action(F.col("kind")).alias("action"))


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 12
    tier = F.when(at < 2, "hash").when(at < 6, "prefix").when(at < 9, "regex").when(at < 11, "contains").otherwise("odd")
    value = (
        F.when(at == 0, F.sha2("line", 256)).when(at == 1, "abc").when(at == 2, F.substring("line", 1, 25)).when(at == 3, F.substring("line", 1, 8)).when(at == 4, "GET / <TS>           <NUM>").when(at == 5, F.concat(F.lit("not the start of the line "), "event_id"))
        .when(at == 6, "^[0-9]+[.][0-9]+").when(at == 7, ".*").when(at == 8, "^.*abcdefgh").when(at == 9, "abcdefghijk").otherwise("short")
    )
    line = F.when(at == 4, "GET / <TS>           <NUM> x").otherwise(F.col("line"))
    return log_lines(spark, sf_dir).select("event_id", tier.alias("tier"), value.alias("value"), F.when(F.col("user_id") % 2 == 0, "human").otherwise("llm").alias("source"), line.alias("original_line"))


def pattern_faults(spark, sf_dir):
    return patterns.faults(_offered(spark, sf_dir)).select("event_id", "tier", "source", "fault")


def _store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_lines(spark, sf_dir).where("event_id % 3 = 0")
    return rows.select(F.concat(F.lit("s"), F.col("event_id") % 5).alias("scope"), F.when(F.col("event_id") % 2 == 0, "allow").otherwise("alert").alias("bucket"), F.lit("hash").alias("tier"), F.concat(F.lit("v"), F.col("event_id") % 1009).alias("value"), F.lit("llm").alias("source"), F.lit("").alias("reason"), F.lit(False).alias("revoked"), F.col("event_id").cast("long").alias("ord"))


def pattern_changes(spark, sf_dir):
    """Patterns of a store after some were deleted, revoked and validated."""
    rows = _store_rows(spark, sf_dir)
    some = lambda m, k: rows.where(f"ord % {m} = {k}").select("scope", F.when(F.col("ord") % 10 != 3, F.col("bucket")).alias("bucket"), "value")
    out = patterns.delete(rows, some(12, 4).where("bucket IS NOT NULL"))
    return patterns.validate(patterns.revoke(out, some(8, 6).where("bucket IS NOT NULL")), some(6, 3)).select("ord", "scope", "bucket", "value", "source", "revoked")


# ---- policy ----


def policy_all_rules(spark, sf_dir):
    """Policy on journal lines that meet each of its rules, and some that look like it."""
    out = policy.evaluate(_table(spark, sf_dir, _POLICY))
    return out.select("event_id", "rule", "action", "username", F.col("source_ip").alias("from_ip"), "auth_method", "reason")


# ---- evidence ----


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigate.evidence(_table(spark, sf_dir, _ALERTS), _table(spark, sf_dir, _RESPONSES), 5)


def evidence_structs(spark, sf_dir):
    """What the captured responses say on every alert."""
    return _evidence(spark, sf_dir).select("event_id", *[F.col(f"evidence.{c}").alias(c) for c in ("status", "candidates", "status_code", "content_length", "body_hash", "capture_mode", "duration_ms", "format", "redactions", "preview")])


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.sha2(F.lit("DB_USER=[REDACTED]\nAPI_KEY=[REDACTED]"), 256)
    return _table(spark, sf_dir, _ALERTS).where("event_id % 4 = 2").select("host", F.col("method").alias("http_method"), F.col("path").alias("http_path"), F.col("status").alias("http_status"), shape.alias("body_preview_hash"), F.lit("by design").alias("description")).distinct()


def expected_endpoint_matches(spark, sf_dir):
    """Alerts whose answer a person expects. The query is no part of an endpoint, nor is the method's case."""
    rows = _table(spark, sf_dir, _ALERTS)
    shape = F.when(F.col("event_id") % 5 < 4, F.sha2(F.lit("DB_USER=[REDACTED]\nAPI_KEY=[REDACTED]"), 256)).otherwise("")
    rows = rows.withColumns({"method": F.lower("method"), "path": F.concat("path", F.lit("?x=1")), "shape": shape})
    return investigate.with_endpoints(rows, _endpoints(spark, sf_dir), F.col("status"), F.col("shape")).select("event_id", "expected")


def verified_catch_alls(spark, sf_dir):
    rows = _table(spark, sf_dir, _ALERTS).withColumn("body_hash", F.sha2(F.concat(F.col("event_id") % 4, F.col("status")), 256))
    return investigate.with_catch_alls(rows.withColumn("method", F.lower("method")), _table(spark, sf_dir, _RULES)).select("event_id", "catch_all")


def catch_all_fallback(spark, sf_dir):
    """Alerts without a captured response whose length is that of a known catch-all page, and why."""
    return investigate.catch_all_by_bytes(_table(spark, sf_dir, _ALERTS), _table(spark, sf_dir, _RULES)).select("event_id", "by_bytes")


def _judge(groups: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: account files are malicious, settings recon that failed."""
    bad = F.contains("preview", F.lit("root:"))
    return groups.withColumns({"classification": F.when(bad, "malicious").otherwise("recon_failed"), "generic": ~bad, "reason": F.when(bad, "accounts").otherwise("settings")})


def _cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A_B=[REDACTED]\nC_D=[REDACTED]", "downgraded", "noise", "seen before")], "p string, outcome string, classification string, reason string").select(F.sha2("p", 256).alias("body_hash"), "outcome", "classification", "reason")


def _evidence_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigate.decisions(_evidence(spark, sf_dir), _endpoints(spark, sf_dir), _cache(spark), _judge, catch_alls=_table(spark, sf_dir, _PAGES))


def evidence_decisions(spark, sf_dir):
    """What is decided on every alert from its evidence."""
    return _evidence_decided(spark, sf_dir).select("event_id", "step", "outcome", "new_classification", "decision_reason")


def final_findings(spark, sf_dir):
    """The finding that comes of every alert."""
    out = investigate.final_findings(_evidence_decided(spark, sf_dir))
    return out.select("event_id", "verdict", "classification", "reason", "evidence_status", "evidence_status_code", "downgraded", "notify", "resolution_status", "resolution_method", "previous_verdict")


def merged_events(spark, sf_dir):
    """Events of one request put together."""
    named = lambda m: F.when(F.col("event_id") % m == 0, "").otherwise(F.concat(F.lit("v"), F.col("event_id") % 50))
    rows = log_lines(spark, sf_dir).select(
        F.concat(F.lit("k"), F.col("event_id") % 1000).alias("key"), F.col("event_id").alias("seq"), named(3).alias("http_method"), F.when(F.col("event_id") % 3 == 0, "/a/<NUM>").otherwise(named(4)).alias("http_path"), named(2).alias("host"), named(5).alias("user_agent"),
        F.when(F.col("event_id") % 4 < 2, 0).otherwise(F.col("bytes")).alias("response_bytes"), "line", named(7).alias("normalized"), "source_name", named(3).alias("classification"), named(2).alias("pattern"),
    )
    return investigate.merged_events(rows)


def flow_pairs(spark, sf_dir):
    """Requests and responses of each flow, paired in their order."""
    rows = log_lines(spark, sf_dir).select((F.col("event_id") % 500).alias("flow"), F.col("event_id").alias("seq"))
    return evidence.pair_in_flow(rows.where("seq % 3 > 0"), rows.where("seq % 3 = 0"))


# ---- reviews ----


def _review_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_table(spark, sf_dir, x) for x in (_CORRECTIONS, _FINDINGS, _DECISIONS)]


def _reviews(decisions: DataFrame) -> DataFrame:
    status = F.when(F.col("id") % 4 == 0, "pending").when(F.col("id") % 4 == 1, "confirmed").otherwise("corrected")
    return decisions.where("id % 7 = 0").select("id", status.alias("status"), F.lit("allow").alias("verdict"), F.concat(F.lit("r"), "id").alias("reason"), (F.col("id") % 2 == 0).alias("pattern_deleted"))


def review_decisions(spark, sf_dir):
    rows = _table(spark, sf_dir, _DECISIONS)
    return reviews.review(rows, _reviews(rows)).select("id", "review_status", "review_verdict", "review_reason", "pattern_deleted", "action")


def reviewed_findings(spark, sf_dir):
    """Findings resolved by reviews of the decisions on their events."""
    _, f, d = _review_tables(spark, sf_dir)
    return reviews.reviewed_findings(f, d, _reviews(d)).select("id", "verdict", "resolution_status", "resolution_method", "previous_verdict", "downgraded")


def correction_patterns(spark, sf_dir):
    """Patterns that corrections teach, make wrong and confirm."""
    c, f, d = _review_tables(spark, sf_dir)
    taught = reviews.noise(c, f, d).select(F.lit("taught").alias("what"), "scope", "bucket", "value")
    stale = reviews.stale_patterns(c, f, d).select(F.lit("stale").alias("what"), "scope", "bucket", "value")
    return taught.unionByName(stale).unionByName(reviews.confirmed_patterns(c, f, d).select(F.lit("confirmed").alias("what"), "scope", "bucket", "value"))


def correction_catch_alls(spark, sf_dir):
    """Catch-all rules that people's corrections make."""
    return reviews.failed_probes(*_review_tables(spark, sf_dir))


def correction_endpoints(spark, sf_dir):
    return reviews.expected_endpoints(*_review_tables(spark, sf_dir))


def timed_out_findings(spark, sf_dir):
    """All findings after those that waited longest for evidence were given up."""
    rows = _table(spark, sf_dir, _FINDINGS)
    return store.resolve(rows, store.timed_out(rows, F.to_timestamp(F.lit(NOW)))).select("id", "verdict", "resolution_status", "resolution_method", "previous_verdict")


def kept_decisions(spark, sf_dir):
    return store.prune_decisions(_table(spark, sf_dir, _DECISIONS), F.to_timestamp(F.lit(NOW))).select("id", "review_status")


def scanner_sessions(spark, sf_dir):
    """Runs of one address against one host with one body, and those that retention keeps."""
    out = store.scanner_sessions(_table(spark, sf_dir, _FINDINGS), "2 hours")
    return store.prune_sessions(out, F.to_timestamp(F.lit(NOW))).select("source_ip", "dest_host", "body_hash", "first_seen", "last_seen", "probes", F.array_join("sample_paths", " ").alias("paths"))


# ---- sources ----


def journal_entries(spark, sf_dir):
    """Log lines out of a journal export."""
    out = journal.entries(_table(spark, sf_dir, _ENTRIES).select("value"), "own.service")
    return out.select("source_name", "unit", "stream", "line", F.unix_micros("ts").alias("us"), F.col("metadata")["uid"].alias("uid"), F.col("metadata")["priority"].alias("priority"))


def container_times(spark, sf_dir):
    """Lines of a container stream with the time at their head taken off."""
    head = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z  "))).when(F.col("event_id") % 3 == 1, F.lit("2024-13-01T00:00:00Z "))
    rows = log_lines(spark, sf_dir).select("event_id", F.concat(F.coalesce(head, F.lit(" ")), F.when(F.col("event_id") % 10 == 2, "").otherwise(F.col("line"))).alias("line"))
    return journal.with_time(rows).select("event_id", "line", F.unix_millis("ts").alias("ms"))


def discovered_containers(spark, sf_dir):
    """Containers by how they publish their ports."""
    e = F.col("event_id")
    port = lambda ip, public, kind: F.struct(ip.alias("ip"), F.lit(80).alias("private"), public.cast("int").alias("public"), kind.alias("type"), F.lit("ingress").alias("publish_mode"))
    first = port(F.when(e % 4 == 0, "127.0.0.1").when(e % 4 == 1, "0.0.0.0").otherwise(""), F.when(e % 5 == 0, 0).otherwise(8080), F.when(e % 3 == 0, "udp").otherwise("TCP"))
    ports = F.when(e % 7 == 0, F.array().cast("array<struct<ip: string, private: int, public: int, type: string, publish_mode: string>>")).when(e % 7 == 1, F.array(first, port(F.lit("::1"), F.lit(9000), F.lit("tcp")))).otherwise(F.array(first))
    rows = log_lines(spark, sf_dir).select(e.cast("string").alias("id"), F.array(F.concat(F.lit("/App"), e % 6, F.lit(".1.x"))).alias("names"), ports.alias("ports"))
    return journal.discovered(rows, ["/app2.7", "APP4"]).select("id", "name", "class", "reason")


def own_checks(spark, sf_dir):
    """Lines that our own checks have not caused. Tokens are minted faster than they are taken, so that some give way."""
    rows = _table(spark, sf_dir, _CHECKED)
    return journal.without_own_checks(rows.select("event_id", "ts", "line"), rows.where("event_id % 12 = 0").select("token", "minted")).select("event_id")


def _judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with verdicts, ways and classes that do not depend on what they say, half of the requests on a bare address."""
    said = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    # both identities are read several times from the lines
    rows = cut(n.with_normalized(log_lines(spark, sf_dir)), "judged-lines")
    host = F.when((F.col("k") < 8) & (F.floor(F.col("event_id") / 16) % 2 == 0), F.concat(F.lit("10.0.0."), F.col("event_id") % 9, F.lit(" "), F.col("normalized"))).otherwise(F.col("normalized"))
    return rows.withColumns({"normalized": host, "verdict": said("alert", "malicious", "allow", "alert", "malicious"), "via": said("llm", "seed", "policy"), "classification": said("recon_failed", "suspicious", "", "malicious", "recon_success", "safe", "noise"), "reason": F.lit("seen")})


def alert_destinations(spark, sf_dir):
    """What becomes of every line, whatever the verdict on it."""
    return classify.routed(_judged_lines(spark, sf_dir)).select("event_id", "route", "notify", "http_status")


def recon_findings(spark, sf_dir):
    """Findings of attempts that are known to have failed."""
    return classify.recon_findings(classify.routed(_judged_lines(spark, sf_dir)))


# ---- notification ----


def alert_routes(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("malicious", "suspicious", "alert", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return alerts.routed(log_lines(spark, sf_dir).select("event_id", kind.alias("severity"))).select("event_id", "channel")


def alert_texts(spark, sf_dir):
    rows = log_lines(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, "malicious").when(F.col("event_id") % 3 == 1, "alert").otherwise("suspicious")
    host = F.when(F.col("event_id") % 2 == 0, "").otherwise("box-1")
    long = F.concat("line", F.repeat(F.lit("x"), (F.col("event_id") % 2 * 600).cast("int")))
    return rows.select("event_id", alerts.title(kind, F.col("source_name"), F.lit("seen"), host).alias("title"), alerts.body(kind, F.col("source_name"), F.sha2("ip", 256), F.lit("seen"), long, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("body"))


def redact_html(spark, sf_dir):
    """Previews of all pages: their heads, and how much went."""
    rows = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").select("page_id", redact.redact_html(F.col("html")).alias("r"))
    return rows.select("page_id", F.substring("r.preview", 1, 1000).alias("head"), "r.redactions")


QUERIES = {f.__name__: f for f in (
    log_unescape, text_scalars, parse_answers, severity_moves, pattern_faults, pattern_changes, policy_all_rules, evidence_structs, expected_endpoint_matches, verified_catch_alls,
    catch_all_fallback, evidence_decisions, final_findings, merged_events, flow_pairs, review_decisions, reviewed_findings, correction_patterns, correction_catch_alls,
    correction_endpoints, timed_out_findings, kept_decisions, scanner_sessions, journal_entries, own_checks, alert_destinations, recon_findings, container_times, discovered_containers, alert_routes, alert_texts, redact_html,
)}


# ---- the same in DuckDB SQL ----

_BS = "chr(92)"
_HEX2 = r"\\x[0-9A-Fa-f]{2}"
_ODD = f"path || {_BS} || 'x22b' || {_BS} || 'x5Cx5C' || {_BS} || 'xZZ' || {_BS} || 'xc3' || {_BS} || 'xA9' || {_BS}"
_PIECES = f"regexp_extract_all({_ODD}, {t.q(_HEX2 + '|[^' + chr(92) * 2 + ']+|' + chr(92) * 2)})"
_UNESCAPED = f"decode(unhex(array_to_string(list_transform({_PIECES}, lambda x: CASE WHEN regexp_full_match(x, {t.q(_HEX2)}) THEN upper(substr(x, 3, 2)) ELSE hex(x) END), '')))"
_KIND = f"[{', '.join(map(t.q, _MEANS))}]"
_PLAIN = """'{"classification":"' || kind || '","action":"allow","confidence":0.' || event_id % 10 || ',"reason":"r","pattern_type":"prefix","pattern":"p' || event_id || '"}'"""
_REGEX = f"""'{{"classification":"' || kind || '","reason":"a' || {_BS} || 'd+' || {_BS} || '-b ' || {_BS} || '"q' || {_BS} || '"","pattern":"^x' || {_BS} || 's"}}'"""
_CONTENT = f"CASE event_id % 6 WHEN 0 THEN {_PLAIN} WHEN 1 THEN '```json' || chr(10) || {_PLAIN} || chr(10) || '```' WHEN 2 THEN '  ```' || chr(10) || {_REGEX} || chr(10) || '```  ' WHEN 3 THEN 'I think it is safe' WHEN 4 THEN {_REGEX} ELSE '[\"safe\"]' END"
_ANSWERS = f", k AS (SELECT event_id, {_KIND}[event_id % 7 + 1] AS kind, {_KIND}[event_id // 7 % 7 + 1] AS after_ FROM l), c AS (SELECT *, {_CONTENT} AS content FROM k)"
_JSON = f""", b AS (SELECT event_id, content, {answers.sql_bare("content")} AS bare FROM c), m AS (SELECT *, {answers.sql_mended("bare")} AS mended FROM b),
j AS (SELECT event_id, CASE WHEN json_valid(content) THEN content WHEN json_valid(bare) THEN bare WHEN json_valid(mended) THEN mended END AS j FROM m), o AS (SELECT event_id, CASE WHEN json_type(j::JSON) = 'OBJECT' THEN j::JSON END AS j FROM j),
f AS (SELECT event_id, j IS NOT NULL AS readable, coalesce(j ->> 'classification', '') AS classification, coalesce((j ->> 'confidence')::DOUBLE, 0.0) AS confidence, coalesce(j ->> 'reason', '') AS reason, coalesce(j ->> 'pattern_type', '') AS pt, coalesce(j ->> 'pattern', '') AS pa FROM o),
g AS (SELECT *, CASE WHEN readable THEN {answers.sql_action("classification")} ELSE '' END AS action FROM f)"""
_NONE = "'malicious', 'alert'"
_AT = "event_id % 12"
_OFFERED = f"""(SELECT *, CASE WHEN at_ < 2 THEN 'hash' WHEN at_ < 6 THEN 'prefix' WHEN at_ < 9 THEN 'regex' WHEN at_ < 11 THEN 'contains' ELSE 'odd' END AS tier, CASE WHEN user_id % 2 = 0 THEN 'human' ELSE 'llm' END AS source,
  CASE at_ WHEN 0 THEN sha256(line) WHEN 1 THEN 'abc' WHEN 2 THEN substr(line, 1, 25) WHEN 3 THEN substr(line, 1, 8) WHEN 4 THEN 'GET / <TS>           <NUM>' WHEN 5 THEN 'not the start of the line ' || event_id WHEN 6 THEN '^[0-9]+[.][0-9]+' WHEN 7 THEN '.*' WHEN 8 THEN '^.*abcdefgh' WHEN 9 THEN 'abcdefghijk' ELSE 'short' END AS value
FROM (SELECT event_id, user_id, {_AT} AS at_, CASE WHEN {_AT} = 4 THEN 'GET / <TS>           <NUM> x' ELSE line END AS line FROM l))"""
_HUMAN, _LEN = "source = 'human'", "strlen(value)"
_BANNED = ", ".join(sorted({t.q(g.lower().replace(" ", "")) for g in patterns.GENERIC_PREFIXES}))
_FAULT = f"""CASE tier WHEN 'hash' THEN CASE WHEN {_LEN} <> 64 THEN 'hash must be 64 hex characters' END
  WHEN 'prefix' THEN CASE WHEN {_LEN} < CASE WHEN {_HUMAN} THEN 5 ELSE 20 END THEN 'prefix too short (' || {_LEN} || ' chars), minimum ' || CASE WHEN {_HUMAN} THEN 5 ELSE 20 END WHEN NOT {_HUMAN} AND NOT starts_with(line, value) THEN 'auto-learned prefix does not literally prefix the original line'
    WHEN NOT {_HUMAN} AND lower(regexp_replace(regexp_replace(value, '<[^>]*>', '', 'g'), '[ ]', '', 'g')) IN ({_BANNED}) THEN 'auto-learned prefix is structurally just a generic token' END
  WHEN 'regex' THEN CASE WHEN NOT regexp_matches(line, value) THEN 'regex does not match the original line it was generated from' WHEN value = '.*' THEN 'regex is too broad' WHEN NOT {_HUMAN} AND value[1] <> '^' THEN 'auto-learned regex must be anchored with ^' WHEN NOT {_HUMAN} AND starts_with(value, '^.*') THEN 'auto-learned regex begins with ^.*' WHEN NOT {_HUMAN} AND {_LEN} < 10 THEN 'auto-learned regex too short' END
  WHEN 'contains' THEN CASE WHEN NOT {_HUMAN} THEN 'auto-learned contains patterns are forbidden' WHEN {_LEN} < 10 THEN 'contains pattern too short' END ELSE 'unknown pattern type' END"""
_STORE = "(SELECT event_id AS ord, 's' || event_id % 5 AS scope, CASE WHEN event_id % 2 = 0 THEN 'allow' ELSE 'alert' END AS bucket, 'v' || event_id % 1009 AS value FROM l WHERE event_id % 3 = 0)"
_POLICY_RULES = [(r["id"], r["pattern"]) for r in policy.RULES]
_UNIT = "lower(regexp_replace(regexp_replace(unit, '\\.[^.]*$', ''), '@.*$', ''))"
_MET = {"ssh_login": f"{_UNIT} IN ('ssh', 'sshd')", "sudo_failure": "source_name = 'sudo'"}
_G = lambda rule, i: f"regexp_extract(line, {t.q(dict(_POLICY_RULES)[rule])}, {i})"
_EITHER = lambda a, b: f"coalesce(nullif({a}, ''), {b})"
_WHO = f"CASE rule WHEN 'ssh_login' THEN {_G('ssh_login', 2)} WHEN 'useradd' THEN {_G('useradd', 1)} WHEN 'privilege_grant' THEN {_EITHER(_G('privilege_grant', 1), _G('privilege_grant', 4))} WHEN 'pam_session' THEN {_G('pam_session', 2)} WHEN 'authorized_keys' THEN '' WHEN 'sudo_failure' THEN '' END"
_SAID = f"""CASE rule WHEN 'ssh_login' THEN 'Successful SSH login from unknown IP ' || {_G('ssh_login', 3)} || ' as ' || {_G('ssh_login', 2)} || ' (' || {_G('ssh_login', 1)} || ')' WHEN 'useradd' THEN 'New user created: ' || {_G('useradd', 1)}
  WHEN 'privilege_grant' THEN 'Privilege escalation: user ' || {_EITHER(_G('privilege_grant', 1), _G('privilege_grant', 4))} || ' added to ' || {_EITHER(_G('privilege_grant', 2), _G('privilege_grant', 3))} WHEN 'authorized_keys' THEN 'SSH authorized_keys file accessed or modified'
  WHEN 'sudo_failure' THEN 'Failed sudo attempt - possible privilege escalation' WHEN 'pam_session' THEN 'PAM session ' || {_G('pam_session', 1)} || ' for ' || {_G('pam_session', 2)} || ' (handled by SSH policy)' END"""
# evidence: every pair within the window by the rules as they are written down, without bins or classes
_NEAR = f"""c AS (SELECT a.*, r.* FROM a JOIN r ON abs(epoch(r.resp_ts) - epoch(a.ts)) <= 5 AND CASE WHEN r.resp_method <> '' THEN r.resp_method = a.method AND r.resp_path = a.path
    ELSE NOT (a.bytes > 0 AND r.content_length > 0) OR abs(a.bytes - r.content_length) <= greatest(a.bytes // 10, 256) END
  AND (a.status = 0 OR a.status IS NOT DISTINCT FROM r.resp_status) AND (a.host = '' OR r.resp_host = '' OR a.host = r.resp_host)),
w AS (SELECT *, abs(epoch(resp_ts) - epoch(ts)) + CASE WHEN bytes > 0 AND content_length > 0 AND abs(bytes - content_length) > greatest(bytes // 5, 2048) THEN 3600 ELSE 0 END AS score FROM c),
g AS (SELECT event_id, count(*) AS candidates, count(DISTINCT (body_hash, content_length, content_type)) AS bodies FROM w GROUP BY 1),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score, resp_agent <> user_agent, resp_seq DESC) = 1)"""
_SHAPE = f"""v AS (SELECT b.*, g.candidates, g.candidates = 1 OR g.bodies = 1 AS high, CASE WHEN content_type = '' OR body IN ('', 'just words') THEN 'unknown' WHEN contains(body, 'root:') THEN 'passwd' ELSE 'dotenv' END AS format,
  CASE WHEN contains(body, 'root:') THEN 'root:[REDACTED]:0:0:[REDACTED]:[REDACTED]:/bin/bash' || chr(10) || regexp_extract(body, '(u[0-9]+):x:5:5:a:b:c', 1) || ':[REDACTED]:5:5:[REDACTED]:[REDACTED]:c' WHEN body IN ('', 'just words') THEN '' ELSE regexp_replace(body, '=[^\n]*', '=[REDACTED]', 'g') END AS shown,
  CASE WHEN contains(body, 'root:') THEN 6 WHEN body IN ('', 'just words') THEN 0 ELSE 2 END AS redactions, round((epoch_us(resp_ts) - epoch_us(request_ts)) / 1000)::BIGINT AS took FROM b JOIN g USING (event_id)),
e AS (SELECT a.*, v.event_id IS NOT NULL AS seen, coalesce(CASE WHEN v.high THEN 'available_high_confidence' ELSE 'available_low_confidence' END, '') AS ev, v.candidates, v.resp_status AS status_code, v.content_length, v.body_hash, CASE WHEN v.resp_method = '' THEN 'single_segment_preview_orphan' WHEN v.event_id IS NOT NULL THEN 'single_segment_preview' END AS capture_mode,
  CASE WHEN v.took > 0 THEN v.took END AS duration_ms, v.format, v.redactions, CASE WHEN v.high THEN v.shown ELSE '' END AS preview FROM a LEFT JOIN v USING (event_id)),
x AS (SELECT * REPLACE (CASE WHEN seen THEN ev ELSE 'not_available_no_match' END AS ev, coalesce(candidates, 0) AS candidates, coalesce(preview, '') AS preview) FROM e)"""
_ENV = "'DB_USER=[REDACTED]' || chr(10) || 'API_KEY=[REDACTED]'"
_ENDPOINT = f"p AS (SELECT DISTINCT host AS p_host, method AS p_method, split_part(path, '?', 1) AS p_path, status AS p_status FROM a WHERE event_id % 4 = 2 AND host <> '')"
_EXPECTED = "'Expected endpoint: operator confirmed ' || upper(method) || ' ' || host || split_part(path, '?', 1) || ' [status ' || {s} || '] returns sensitive-looking response by design (shape hash ' || substr({h}, 1, 16) || ') - by design'"
_STATE = "CASE WHEN coalesce(status_code, 0) > 0 THEN status_code ELSE status END"
_STEPS = f"""{_ENDPOINT}, s AS (SELECT x.*, sha256(preview) AS shape, p_host IS NOT NULL AND preview = {_ENV} AS expected, {_STATE} AS state,
  CASE WHEN verdict = 'alert' AND q = 'malicious' THEN 'suspicious' ELSE q END AS before_ FROM (SELECT *, CASE WHEN classification <> '' THEN classification WHEN verdict = 'malicious' THEN 'malicious' ELSE 'suspicious' END AS q FROM x) x
  LEFT JOIN p ON p_host = host AND p_method = method AND p_path = split_part(path, '?', 1) AND p_status = {_STATE}),
t AS (SELECT *, CASE WHEN method = '' THEN 'no_request' WHEN status_code IN (403, 404, 405, 410) AND NOT coalesce(duration_ms, 0) >= 3000 THEN 'transport' WHEN NOT seen THEN 'no_evidence' WHEN preview = '' THEN 'no_preview' WHEN expected THEN 'endpoint'
  WHEN preview = 'A_B=[REDACTED]' || chr(10) || 'C_D=[REDACTED]' THEN 'cached' ELSE 'judged' END AS step FROM s),
u AS (SELECT shape, min(event_id) AS leader, arg_min(before_, event_id) AS first_ FROM t WHERE step = 'judged' GROUP BY 1),
z AS (SELECT t.*, leader, CASE WHEN step IN ('transport', 'endpoint', 'cached') THEN 'downgraded' WHEN step = 'judged' THEN CASE WHEN contains(preview, 'root:') THEN CASE WHEN {answers.sql_severity("first_")} < 5 THEN 'escalated' ELSE 'kept' END WHEN {answers.sql_severity("first_")} > 1 THEN 'downgraded' ELSE 'kept' END ELSE 'kept' END AS outcome,
  CASE step WHEN 'cached' THEN 'noise' WHEN 'judged' THEN CASE WHEN contains(preview, 'root:') THEN 'malicious' ELSE 'recon_failed' END END AS new_classification,
  CASE step WHEN 'transport' THEN 'Transport evidence confirms attack failed (HTTP ' || status_code || ') - payload was rejected/ignored by the server' WHEN 'endpoint' THEN {_EXPECTED.format(s="state", h="t.shape")} WHEN 'cached' THEN 'seen before'
    WHEN 'judged' THEN CASE WHEN contains(preview, 'root:') THEN 'accounts' ELSE 'settings' END || CASE WHEN leader <> event_id THEN ' (coalesced with ' || leader || ')' ELSE '' END ELSE '' END AS decision_reason FROM t LEFT JOIN u ON t.step = 'judged' AND t.shape = u.shape)"""
# what no step has changed, by the rules on catch-all pages; z is what the steps say
_PAGED = f"""{_STEPS}, ok AS (SELECT * FROM pg WHERE verdict <> 'rejected'),
n AS (SELECT z.event_id, bool_or(pg.verdict = 'rejected') AS veto, arg_min('Catch-all fallback (REC-miss): verified pattern exists for ' || http_method || ' ' || z.host || ' ' || z.status || ' (hash ' || left(body_preview_hash, 16) || ', ' || paths || ' prior paths, verified bytes=' || response_bytes || ') - log responseBytes=' || z.bytes || ' within tolerance', body_preview_hash)
  FILTER (pg.verdict <> 'rejected' AND abs(z.bytes - response_bytes) <= greatest(response_bytes * 15 // 100, 256)) AS why FROM z JOIN pg ON pg.host = z.host AND http_method = z.method AND http_status = z.status WHERE z.bytes BETWEEN 1 AND 10000 AND z.method IN ('GET', 'HEAD') AND NOT z.seen GROUP BY 1),
zz AS (SELECT z.* REPLACE (CASE WHEN outcome = 'kept' AND ok.host IS NOT NULL THEN 'catch_all' WHEN outcome = 'kept' AND NOT veto AND why IS NOT NULL THEN 'catch_all_bytes' ELSE step END AS step, CASE WHEN outcome = 'kept' AND (ok.host IS NOT NULL OR NOT veto AND why IS NOT NULL) THEN 'downgraded' ELSE outcome END AS outcome,
  CASE WHEN outcome = 'kept' AND (ok.host IS NOT NULL OR NOT veto AND why IS NOT NULL) THEN NULL ELSE new_classification END AS new_classification,
  CASE WHEN outcome = 'kept' AND ok.host IS NOT NULL THEN 'Verified catch-all: ' || ok.paths || ' distinct paths on ' || z.host || ' all returned identical ' || http_method || ' ' || z.status || ' response (body hash ' || left(body_preview_hash, 16) || ') - same page' WHEN outcome = 'kept' AND NOT veto AND why IS NOT NULL THEN why ELSE decision_reason END AS decision_reason)
  FROM z LEFT JOIN ok ON ok.host = z.host AND z.host <> '' AND http_method = z.method AND http_status = z.status AND body_preview_hash = z.body_hash LEFT JOIN n ON n.event_id = z.event_id)"""
_V = lambda m: f"CASE WHEN event_id % {m} = 0 THEN '' ELSE 'v' || event_id % 50 END"
_FIRST = lambda c: f"arg_min(nullif({c}, ''), seq) FILTER (nullif({c}, '') IS NOT NULL)"
_LAST = lambda c: f"arg_max(nullif({c}, ''), seq) FILTER (nullif({c}, '') IS NOT NULL)"
_ASKED = """c AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY co."at" DESC) = 1), lf AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1),
ld AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1), lr AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier = 'reclassify' DESC, id DESC) = 1),
q AS (SELECT lf.*, c.kind, c.target, c.reason AS why, lf.source_type || ':' || lf.source_name AS own, d.id AS d_id, d.tier, d.source_scope, d.normalized_hash AS d_hash, d.evidence_hash, d.evidence_status, d.cache_key, d.action, d.pattern_learned, d.pattern_value, d.pattern_bucket
  FROM lf JOIN c USING (event_id) LEFT JOIN (SELECT 'expected_endpoint' AS k, lr.* FROM lr UNION ALL SELECT o.k, ld.* FROM ld, (VALUES ('noise'), ('failed_probe'), ('confirm')) o(k)) d ON d.event_id = lf.event_id AND d.k = c.kind)"""
_OR = lambda a, b: f"coalesce(nullif({a}, ''), {b}, '')"
_TAUGHT, _MATCHED = "coalesce(pattern_learned AND pattern_value <> '', false)", "matched_pattern_value <> '' AND matched_pattern_bucket <> ''"
_OPEN = "resolution_status IN ('', 'pending')"
_REVIEW = "rv AS (SELECT id AS r_id, CASE WHEN id % 4 = 0 THEN 'pending' WHEN id % 4 = 1 THEN 'confirmed' ELSE 'corrected' END AS st FROM d WHERE id % 7 = 0)"
_LATEST = "lv AS (SELECT event_id, arg_max(verdict, id) AS latest FROM f GROUP BY 1)"
_STAMP = "CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250Z  ' WHEN 1 THEN '2024-13-01T00:00:00Z ' ELSE ' ' END || CASE WHEN event_id % 10 = 2 THEN '' ELSE line END"
_SEVERITY3 = "CASE event_id % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'alert' ELSE 'suspicious' END"
_ICON = "CASE event_id % 3 WHEN 0 THEN '🚨' WHEN 1 THEN 'ℹ️' ELSE '⚠️' END"
_SAYS = lambda *names: f"[{', '.join(map(t.q, names))}][event_id % {len(names)} + 1]"
_ROUTED = f""", jl AS (SELECT * REPLACE (CASE WHEN k < 8 AND event_id // 16 % 2 = 0 THEN '10.0.0.' || event_id % 9 || ' ' || normalized ELSE normalized END AS normalized), {_SAYS("alert", "malicious", "allow", "alert", "malicious")} AS verdict, {_SAYS("llm", "seed", "policy")} AS via, {_SAYS("recon_failed", "suspicious", "", "malicious", "recon_success", "safe", "noise")} AS classification FROM norm),
jp AS (SELECT *, {", ".join(f"{http.sql_part('line', http.RAW_SHAPES, c)} AS r_{c}, {http.sql_part('normalized', http.NORMALIZED_SHAPES, c)} AS n_{c}" for c in ("method", "path", "status", "host") if c != "host")}, {http.sql_part('normalized', http.NORMALIZED_SHAPES, 'host')} AS n_host FROM jl),
jr AS (SELECT *, CASE WHEN r_method <> '' THEN r_method ELSE n_method END AS http_method, CASE WHEN r_method <> '' THEN r_path ELSE n_path END AS http_path, coalesce(nullif(CASE WHEN r_method <> '' THEN r_status ELSE n_status END, '')::INT, 0) AS http_status FROM jp),
jd AS (SELECT *, CASE WHEN verdict = 'allow' THEN 'none' WHEN via = 'policy' THEN 'policy' WHEN classification = 'recon_failed' THEN 'recon' WHEN http_method = '' THEN 'finding' WHEN via <> 'llm' AND http_status IN (403, 404, 405, 410) THEN 'recon_status' WHEN starts_with(n_host, '10.0.0.') AND http_status = 200 THEN 'edge_inferred' ELSE 'coordinator' END AS route FROM jr)"""
_EVIDENCE = {"a": _ALERTS, "r": _RESPONSES}
_DECIDED = {**_EVIDENCE, "pg": _PAGES}

SQL = {
    "log_unescape": _with(f"SELECT event_id, {_UNESCAPED} AS decoded FROM l"),
    "text_scalars": _with("""SELECT event_id, '+49' || CASE WHEN length(event_id::VARCHAR) >= 4 THEN left(event_id::VARCHAR, -4) || '****' END AS phone, CASE WHEN length(u) <= 50 THEN u ELSE left(u, 47) || '...' END AS url,
      '&lt;a href=&#39;' || replace(path, '&', '&amp;') || '&#39;&gt;&amp;amp;&lt;/a&gt;' AS escaped, CASE WHEN strlen(line) > 40 THEN left(line, 40) || '...' ELSE line END AS cut, event_id::VARCHAR AS a, 'x=y' AS b, 'cron+sshd+' || source_name AS names, left(sha256(line), 12) AS short, 'app' AS base
      FROM (SELECT *, 'https://example.com/a/very/long/way/to/go' || path AS u FROM l)""").replace("'+49' || CASE WHEN length(event_id::VARCHAR) >= 4 THEN left(event_id::VARCHAR, -4) || '****' END", "left('+49' || event_id, length('+49' || event_id) - 4) || CASE WHEN length('+49' || event_id) > 4 THEN '****' ELSE right('+49' || event_id, 4) END").replace("'cron+sshd+' || source_name", "'cron+sshd' || CASE WHEN source_name = 'sshd' THEN '' ELSE '+' || source_name END"),
    "parse_answers": _with(f"SELECT event_id, readable, classification, action, confidence, reason, CASE WHEN action IN ({_NONE}) THEN '' ELSE pt END AS pattern_type, CASE WHEN action IN ({_NONE}) THEN '' ELSE pa END AS pattern FROM g").replace(" SELECT event_id, readable", _ANSWERS + _JSON + " SELECT event_id, readable", 1),
    "severity_moves": _with(f"SELECT event_id, coalesce({answers.sql_severity('after_')} < {answers.sql_severity('kind')}, false) AS down, coalesce({answers.sql_severity('after_')} > {answers.sql_severity('kind')}, false) AS up, {answers.sql_action('kind')} AS action FROM k").replace(" SELECT event_id, coalesce", _ANSWERS + " SELECT event_id, coalesce", 1),
    "pattern_faults": _with(f"SELECT event_id, tier, source, {_FAULT} AS fault FROM {_OFFERED}"),
    "pattern_changes": _with(f""", s AS {_STORE}, gone AS (SELECT scope, bucket, value FROM s WHERE ord % 12 = 4 AND ord % 10 <> 3), off AS (SELECT scope, bucket, value FROM s WHERE ord % 8 = 6 AND ord % 10 <> 3), ok AS (SELECT scope, bucket, value FROM s WHERE ord % 6 = 3 AND ord % 10 <> 3), anyb AS (SELECT scope, value FROM s WHERE ord % 6 = 3 AND ord % 10 = 3)
SELECT ord, scope, bucket, value, CASE WHEN (scope, bucket, value) IN (SELECT (scope, bucket, value) FROM ok) OR (scope, value) IN (SELECT (scope, value) FROM anyb) THEN 'human_validated' ELSE 'llm' END AS source, (scope, bucket, value) IN (SELECT (scope, bucket, value) FROM off) AS revoked FROM s WHERE (scope, bucket, value) NOT IN (SELECT (scope, bucket, value) FROM gone)"""),
    "policy_all_rules": _with(f""", e AS (SELECT *, CASE {' '.join(f"WHEN source_type = 'journal' AND regexp_matches(line, {t.q(x)}) AND {_MET.get(r, 'true')} THEN '{r}'" for r, x in _POLICY_RULES)} END AS rule FROM j)
SELECT event_id, rule, CASE WHEN rule = 'sudo_failure' THEN 'alert' WHEN rule = 'pam_session' THEN 'allow' WHEN rule IS NOT NULL THEN 'escalate' END AS action, {_WHO} AS username, CASE WHEN rule = 'ssh_login' THEN {_G('ssh_login', 3)} WHEN rule IS NOT NULL THEN '' END AS from_ip, CASE WHEN rule = 'ssh_login' THEN {_G('ssh_login', 1)} WHEN rule IS NOT NULL THEN '' END AS auth_method, {_SAID} AS reason FROM e""", j=_POLICY),
    "evidence_structs": _with(f", {_NEAR}, {_SHAPE} SELECT event_id, ev AS status, candidates, status_code, content_length, body_hash, capture_mode, duration_ms, format, redactions, preview FROM x", **_EVIDENCE),
    "expected_endpoint_matches": _with(f", {_ENDPOINT}, i AS (SELECT *, CASE WHEN event_id % 5 < 4 THEN sha256({_ENV}) ELSE '' END AS shape FROM a) SELECT event_id, CASE WHEN p_host IS NOT NULL THEN {_EXPECTED.format(s='status', h='shape')} END AS expected FROM i LEFT JOIN p ON p_host = host AND p_method = method AND p_path = split_part(path, '?', 1) AND p_status = status AND shape <> ''", a=_ALERTS),
    "verified_catch_alls": _with(""", v AS (SELECT * FROM ru WHERE verdict IN ('benign', 'verified')) SELECT a.event_id, CASE WHEN v.host IS NOT NULL THEN 'Verified catch-all: ' || paths || ' distinct paths on ' || a.host || ' all returned identical ' || http_method || ' ' || status || ' response (body hash ' || substr(body_preview_hash, 1, 16) || ') - same page' END AS catch_all
FROM a LEFT JOIN v ON v.host = a.host AND v.http_method = upper(a.method) AND v.http_status = a.status AND v.body_preview_hash = sha256((a.event_id % 4)::VARCHAR || a.status)""", a=_ALERTS, ru=_RULES),
    "catch_all_fallback": _with(""", n AS (SELECT a.event_id, bool_or(ru.verdict = 'rejected') AS veto, arg_min('Catch-all fallback (REC-miss): verified pattern exists for ' || ru.http_method || ' ' || a.host || ' ' || a.status || ' (hash ' || left(body_preview_hash, 16) || ', ' || paths || ' prior paths, verified bytes=' || ru.response_bytes || ') - log responseBytes=' || a.bytes || ' within tolerance', body_preview_hash)
  FILTER (ru.verdict <> 'rejected' AND abs(a.bytes - ru.response_bytes) <= greatest(ru.response_bytes * 15 // 100, 256)) AS why FROM a JOIN ru ON ru.host = a.host AND a.host <> '' AND ru.http_method = upper(a.method) AND ru.http_status = a.status WHERE a.bytes BETWEEN 1 AND 10000 AND a.method IN ('GET', 'HEAD') GROUP BY a.event_id)
SELECT a.event_id, CASE WHEN NOT veto THEN why END AS by_bytes FROM a LEFT JOIN n USING (event_id)""", a=_ALERTS, ru=_RULES),
    "evidence_decisions": _with(f", {_NEAR}, {_SHAPE}, {_PAGED} SELECT event_id, step, outcome, new_classification, decision_reason FROM zz", **_DECIDED),
    "final_findings": _with(f""", {_NEAR}, {_SHAPE}, {_PAGED} SELECT event_id, CASE outcome WHEN 'downgraded' THEN 'downgraded' WHEN 'escalated' THEN 'malicious' ELSE verdict END AS verdict, CASE WHEN outcome = 'kept' AND verdict = 'alert' OR outcome = 'downgraded' AND verdict = 'alert' THEN 'suspicious' ELSE 'malicious' END AS classification,
  CASE WHEN outcome = 'escalated' THEN decision_reason ELSE reason END AS reason, ev AS evidence_status, coalesce(status_code, 0) AS evidence_status_code, outcome = 'downgraded' AS downgraded, outcome = 'escalated' AS notify, CASE WHEN outcome = 'kept' THEN 'pending' ELSE 'resolved' END AS resolution_status,
  CASE WHEN outcome = 'kept' THEN '' ELSE 'rec_evidence' END AS resolution_method, CASE outcome WHEN 'downgraded' THEN verdict WHEN 'escalated' THEN 'alert' ELSE '' END AS previous_verdict FROM zz""", **_DECIDED),
    "merged_events": _with(f""", m AS (SELECT 'k' || event_id % 1000 AS key, event_id AS seq, {_V(3)} AS http_method, CASE WHEN event_id % 3 = 0 THEN '/a/<NUM>' ELSE {_V(4)} END AS http_path, {_V(2)} AS host, {_V(5)} AS user_agent, CASE WHEN event_id % 4 < 2 THEN 0 ELSE bytes END AS response_bytes, line, {_V(7)} AS normalized, source_name, {_V(3)} AS classification, {_V(2)} AS pattern FROM l)
SELECT key, count(*) AS events, {_FIRST('http_method')} AS http_method, {_FIRST('host')} AS host, {_FIRST('user_agent')} AS user_agent, coalesce(arg_min(response_bytes, seq) FILTER (response_bytes > 0), arg_min(response_bytes, seq)) AS response_bytes, {_LAST('line')} AS line, {_LAST('normalized')} AS normalized, {_LAST('source_name')} AS source_name, {_LAST('classification')} AS classification, {_LAST('pattern')} AS pattern,
  coalesce(arg_min(http_path, seq) FILTER (http_path <> '' AND NOT contains(http_path, '<NUM>')), {_FIRST('http_path')}) AS http_path FROM m GROUP BY key"""),
    "flow_pairs": _with(""", x AS (SELECT event_id % 500 AS flow, event_id AS seq FROM l), q AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY seq) AS n FROM x WHERE seq % 3 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY seq) AS n FROM x WHERE seq % 3 = 0)
SELECT r.flow, r.seq AS response_seq, CASE WHEN q.seq < r.seq THEN q.seq END AS request_seq FROM r LEFT JOIN q USING (flow, n)"""),
    "review_decisions": _with(f", {_REVIEW} SELECT id, CASE WHEN r_id IS NOT NULL THEN st ELSE review_status END AS review_status, CASE WHEN r_id IS NOT NULL THEN 'allow' ELSE review_verdict END AS review_verdict, CASE WHEN r_id IS NOT NULL THEN 'r' || id ELSE review_reason END AS review_reason, CASE WHEN r_id IS NOT NULL THEN id % 2 = 0 ELSE pattern_deleted END AS pattern_deleted, action FROM d LEFT JOIN rv ON r_id = id", d=_DECISIONS),
    "reviewed_findings": _with(f""", {_REVIEW}, {_LATEST}, h AS (SELECT DISTINCT event_id FROM d JOIN rv ON r_id = id WHERE st <> 'pending'), y AS (SELECT f.*, latest, h.event_id IS NOT NULL AND f.resolution_status IN ('', 'pending', 'evidence_unavailable') AS take FROM f JOIN lv USING (event_id) LEFT JOIN h USING (event_id))
SELECT id, verdict, CASE WHEN take THEN 'resolved' ELSE resolution_status END AS resolution_status, CASE WHEN take THEN 'human_review' ELSE resolution_method END AS resolution_method, CASE WHEN take THEN latest ELSE previous_verdict END AS previous_verdict, downgraded FROM y""", f=_FINDINGS, d=_DECISIONS),
    "correction_patterns": _with(f""", {_ASKED}, st AS (SELECT {_OR('source_scope', 'own')} AS scope, {_OR('pattern_bucket', 'action')} AS bucket, pattern_value AS value FROM q WHERE kind IN ('noise', 'expected_endpoint') AND {_TAUGHT} UNION SELECT {_OR('matched_pattern_scope', 'own')}, matched_pattern_bucket, matched_pattern_value FROM q WHERE kind IN ('noise', 'expected_endpoint') AND {_MATCHED}),
ok AS (SELECT DISTINCT CASE WHEN {_TAUGHT} THEN {_OR('source_scope', 'own')} WHEN {_MATCHED} THEN {_OR('matched_pattern_scope', 'own')} ELSE own END AS scope, CASE WHEN {_TAUGHT} THEN {_OR('pattern_bucket', 'action')} WHEN {_MATCHED} THEN matched_pattern_bucket END AS bucket, CASE WHEN {_TAUGHT} THEN pattern_value WHEN {_MATCHED} THEN matched_pattern_value ELSE normalized_hash END AS value FROM q WHERE kind = 'confirm')
SELECT 'taught' AS what, own AS scope, target AS bucket, {_OR('normalized_hash', 'd_hash')} AS value FROM q WHERE kind = 'noise' AND target IN ('suppress', 'allow') AND {_OR('normalized_hash', 'd_hash')} <> '' UNION ALL SELECT 'stale', * FROM st UNION ALL SELECT 'confirmed', * FROM ok WHERE value <> ''""", co=_CORRECTIONS, f=_FINDINGS, d=_DECISIONS),
    "correction_catch_alls": _with(f""", {_ASKED}, z AS (SELECT dest_host AS host, http_method, coalesce(nullif(evidence_status_code, 0), nullif(http_status, 0), nullif(evidence_status, 0)) AS http_status, {_OR('evidence_body_hash', 'evidence_hash')} AS body_preview_hash, 'human: ' || CASE WHEN why <> '' THEN why ELSE 'marked as failed probe (no observable impact)' END AS reason, response_bytes, event_id AS verified_by, 'benign' AS verdict FROM q WHERE kind = 'failed_probe')
SELECT * FROM z WHERE host <> '' AND http_method <> '' AND http_status IS NOT NULL AND body_preview_hash <> ''""", co=_CORRECTIONS, f=_FINDINGS, d=_DECISIONS),
    "correction_endpoints": _with(f""", {_ASKED}, z AS (SELECT dest_host AS host, upper(http_method) AS http_method, split_part(http_path, '?', 1) AS http_path, CASE WHEN coalesce(evidence_status, 0) > 0 THEN evidence_status WHEN evidence_status_code > 0 THEN evidence_status_code WHEN http_status > 0 THEN http_status END AS http_status,
  CASE WHEN coalesce(tier = 'reclassify' AND length(cache_key) = 64, false) THEN cache_key WHEN length(evidence_body_hash) = 64 THEN evidence_body_hash END AS body_preview_hash, 'human: ' || CASE WHEN why <> '' THEN why ELSE 'endpoint expected to return sensitive-looking response by design' END AS description, event_id AS created_by_event_id FROM q WHERE kind = 'expected_endpoint')
SELECT * FROM z WHERE host <> '' AND http_method <> '' AND http_path <> '' AND http_status IS NOT NULL AND body_preview_hash IS NOT NULL""", co=_CORRECTIONS, f=_FINDINGS, d=_DECISIONS),
    "timed_out_findings": _with(f""", {_LATEST}, h AS (SELECT DISTINCT event_id AS h FROM (SELECT * FROM f WHERE {_OPEN} AND verdict IN ('alert', 'malicious') AND http_method <> '' AND NOT downgraded AND ts < TIMESTAMP '{NOW}' ORDER BY ts, id LIMIT 50)), y AS (SELECT f.*, latest, h IS NOT NULL AND {_OPEN} AS take FROM f JOIN lv USING (event_id) LEFT JOIN h ON h = event_id)
SELECT id, verdict, CASE WHEN take THEN 'evidence_unavailable' ELSE resolution_status END AS resolution_status, CASE WHEN take THEN 'timeout' ELSE resolution_method END AS resolution_method, CASE WHEN take THEN latest ELSE previous_verdict END AS previous_verdict FROM y""", f=_FINDINGS),
    "kept_decisions": _with(f"SELECT id, review_status FROM d WHERE NOT (coalesce(review_status, 'pending') = 'pending' AND ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)", d=_DECISIONS),
    "scanner_sessions": _with(f""", g AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL AS opens FROM f WHERE source_ip <> '' WINDOW w AS (PARTITION BY source_ip, dest_host, evidence_body_hash ORDER BY ts, id)), n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY source_ip, dest_host, evidence_body_hash ORDER BY ts, id) AS s FROM g),
o AS (SELECT source_ip, dest_host, evidence_body_hash AS body_hash, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS probes, arg_min(http_path, (ts, id)) AS p, arg_max(http_path, (ts, id)) AS z FROM n GROUP BY source_ip, dest_host, evidence_body_hash, s)
SELECT source_ip, dest_host, body_hash, first_seen, last_seen, probes, CASE WHEN p = z THEN p ELSE p || ' ' || z END AS paths FROM o WHERE NOT last_seen < TIMESTAMP '{NOW}' - INTERVAL 90 DAY""", f=_FINDINGS),
    "journal_entries": _with("""SELECT CASE event_id % 13 WHEN 3 THEN 'bash' ELSE 'sshd' END AS source_name, CASE event_id % 13 WHEN 3 THEN '' ELSE 'ssh.service' END AS unit, CASE event_id % 13 WHEN 3 THEN 'journal' ELSE 'syslog' END AS stream, value::JSON ->> 'MESSAGE' AS line, (value::JSON ->> '__REALTIME_TIMESTAMP')::BIGINT AS us, coalesce(value::JSON ->> '_UID', '') AS uid, coalesce(value::JSON ->> 'PRIORITY', '') AS priority
FROM j WHERE event_id % 13 IN (3, 10, 11, 12)""", j=_ENTRIES),
    "own_checks": _with(""", mt AS (SELECT token, min(minted) AS minted FROM ck WHERE event_id % 12 = 0 GROUP BY 1), tk AS (SELECT mt.token, mt.minted, min(ck.ts) AS taken, arg_min(ck.event_id, (ck.ts, ck.event_id)) AS by_ FROM mt LEFT JOIN ck ON contains(ck.line, mt.token) AND ck.token = mt.token AND ck.ts BETWEEN mt.minted AND mt.minted + INTERVAL 10 SECOND GROUP BY ALL),
nx AS (SELECT i.token, j.token AS next_, j.minted AS at_ FROM tk i JOIN tk j ON (j.minted, j.token) > (i.minted, i.token) AND j.minted <= i.minted + INTERVAL 10 SECOND AND j.minted <= coalesce(i.taken, TIMESTAMP '2999-01-01')),
gone AS (SELECT DISTINCT a.token FROM nx a JOIN nx b ON b.token = a.token AND (b.at_, b.next_) < (a.at_, a.next_) JOIN tk k ON k.token = b.next_ WHERE coalesce(k.taken, TIMESTAMP '2999-01-01') >= a.at_ GROUP BY a.token, a.next_ HAVING count(*) >= 49)
SELECT event_id FROM l WHERE event_id NOT IN (SELECT by_ FROM tk WHERE taken IS NOT NULL AND token NOT IN (SELECT token FROM gone))""", ck=_CHECKED),
    "alert_destinations": with_norm(f"{_ROUTED} SELECT event_id, route, CASE WHEN via = 'policy' THEN verdict = 'malicious' ELSE route = 'finding' AND verdict = 'malicious' END AS notify, http_status FROM jd"),
    "recon_findings": with_norm(f"""{_ROUTED}, jf AS (SELECT *, CASE route WHEN 'recon_status' THEN 'Known attack pattern (via:' || via || ') rejected by server - HTTP ' || http_status || ' confirms failure' WHEN 'edge_inferred' THEN 'Attack probe hit bare-IP default server (' || n_host || ') - HTTP 200 is the default page, no backend application involved' ELSE '' END AS why FROM jd WHERE route IN ('recon', 'recon_status', 'edge_inferred'))
SELECT event_id, 'recon' AS verdict, CASE route WHEN 'recon' THEN classification WHEN 'recon_status' THEN 'recon_failed_status' ELSE route END AS classification, CASE route WHEN 'recon' THEN 'seen' ELSE why END AS reason, http_method, http_path, http_status, route <> 'recon' AS downgraded, why AS downgrade_reason, CASE WHEN route <> 'recon' THEN 'resolved' ELSE '' END AS resolution_status,
  CASE route WHEN 'recon_status' THEN 'status_only' WHEN 'edge_inferred' THEN 'bare_ip_default_server' ELSE '' END AS resolution_method, CASE WHEN route <> 'recon' THEN verdict ELSE '' END AS previous_verdict, false AS notify FROM jf"""),
    "container_times": _with(f", v AS (SELECT event_id, event_id % 3 = 0 AS dated, epoch_us(ts) // 1000 AS ms, {t.sql_trim(_STAMP)} AS s FROM l) SELECT event_id, CASE WHEN dated THEN ltrim(regexp_replace(s, '^[^ ]*', '')) ELSE s END AS line, CASE WHEN dated THEN ms // 1000 * 1000 + 250 END AS ms FROM v WHERE s <> ''"),
    "discovered_containers": _with("""SELECT event_id::VARCHAR AS id, 'App' || event_id % 6 AS name, CASE WHEN tcp AND NOT lo THEN CASE WHEN event_id % 6 IN (2, 4) THEN 'excluded' ELSE 'public' END ELSE 'skipped' END AS class, CASE WHEN tcp AND NOT lo THEN '' WHEN tcp OR two THEN 'loopback-only publish' ELSE 'no published TCP ports' END AS reason
FROM (SELECT event_id, event_id % 7 = 1 AS two, event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 AS tcp, event_id % 4 = 0 AS lo FROM l)"""),
    "alert_routes": _with("SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['webhook', 'email', 'sms', 'push/ios', 'push/fcm'] WHEN 1 THEN ['webhook', 'email'] ELSE ['webhook'] END) AS channel FROM l"),
    "alert_texts": _with(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE '[box-1] ' END || {_ICON} || ' [' || {_SEVERITY3} || '] ' || source_name || ': seen' AS title, 'Severity: ' || {_SEVERITY3} || chr(10) || 'Container: ' || source_name || ' (' || left(sha256(ip), 12) || ')' || chr(10) || 'Reason: seen' || chr(10) || 'Log line: ' || CASE WHEN event_id % 2 = 1 THEN left(line || repeat('x', 600), 500) || '...' ELSE line END || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS body FROM l"""),
    "redact_html": """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '<script>[STRIPPED]</script>', 'g'), '(?s)<style[^>]*>.*?</style>', '<style>[STRIPPED]</style>', 'g') AS x FROM pages)
SELECT page_id, substr(regexp_replace(x, '(<a href=)"[^"]*"', '\\1"[REDACTED]"', 'g'), 1, 1000) AS head, len(regexp_extract_all(x, '<a href="')) AS redactions FROM s""",
}
