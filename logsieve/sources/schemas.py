"""Columns of the tables that queries and changes work on, as DDL: for ``spark.read.schema`` and ``createDataFrame``."""

from __future__ import annotations

FINDINGS = """
id BIGINT, event_id STRING, ts TIMESTAMP, source_type STRING, source_name STRING, source_ip STRING, dest_host STRING, http_method STRING, http_path STRING, http_status INT,
response_bytes BIGINT, verdict STRING, classification STRING, confidence DOUBLE, reason STRING, matched_via STRING, matched_pattern_scope STRING, matched_pattern_bucket STRING,
matched_pattern_value STRING, origin_event_id STRING, raw_line STRING, normalized_line STRING, normalized_hash STRING, coordinator_key STRING, coordinator_events INT,
evidence_status STRING, evidence_status_code INT, evidence_content_type STRING, evidence_body_hash STRING, evidence_capture_mode STRING, downgraded BOOLEAN, downgrade_reason STRING,
notified BOOLEAN, resolution_status STRING, resolved_at TIMESTAMP, resolution_method STRING, previous_verdict STRING
"""
DECISIONS = """
id BIGINT, event_id STRING, ts TIMESTAMP, tier STRING, model STRING, prompt_tokens INT, completion_tokens INT, latency_ms BIGINT, source_scope STRING, raw_line STRING,
normalized_line STRING, normalized_hash STRING, evidence_preview STRING, evidence_status INT, evidence_type STRING, evidence_hash STRING, response_raw STRING, classification STRING,
action STRING, confidence DOUBLE, reason STRING, cache_key STRING, pattern_learned BOOLEAN, pattern_bucket STRING, pattern_value STRING, final_verdict STRING, escalated BOOLEAN,
downgraded BOOLEAN, review_status STRING, review_verdict STRING, review_reason STRING, pattern_deleted BOOLEAN
"""
STATS = "ts TIMESTAMP, source STRING, events BIGINT, allowed BIGINT, suppressed BIGINT, alerts BIGINT, malicious BIGINT, model_calls BIGINT"
TRUSTED_IPS = "id BIGINT, ip_address STRING, cidr STRING, description STRING, added_by STRING, created_at TIMESTAMP"
CATCH_ALLS = "host STRING, http_method STRING, http_status INT, body_preview_hash STRING, content_type STRING, verdict STRING, reason STRING, response_bytes BIGINT, paths BIGINT, verified_at TIMESTAMP"
ENDPOINTS = "host STRING, http_method STRING, http_path STRING, http_status INT, body_preview_hash STRING, created_at TIMESTAMP, created_by_event_id STRING, description STRING"
SESSIONS = "source_ip STRING, dest_host STRING, body_hash STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, probes BIGINT, sample_paths ARRAY<STRING>"
