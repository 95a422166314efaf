"""What people decide: reviews of decisions and corrections of findings, with the patterns, rules and verdicts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.operators import store

#: Rows of a correction: which finding, what kind (noise, failed_probe, expected_endpoint, confirm), the verdict asked for (noise), a reason.
CORRECTIONS = "event_id string, kind string, target string, reason string, at timestamp"
# Reasons where a person gives none.
REASONS = {"failed_probe": "marked as failed probe (no observable impact)", "expected_endpoint": "endpoint expected to return sensitive-looking response by design"}


def audit(decisions: DataFrame) -> DataFrame:
    """``decisions`` as they enter the audit table: whatever they say, nobody has reviewed them yet."""
    return decisions.withColumn("review_status", F.lit("pending"))


def is_hash(c: Column) -> Column:
    """Whether a text is 64 hexadecimal digits."""
    return F.coalesce(c.rlike("^[0-9a-fA-F]{64}\\z"), F.lit(False))


def review(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """``decisions`` after ``reviews`` (id, status, verdict, reason, pattern_deleted; one for each decision). Only the columns of the review change."""
    new = reviews.select("id", F.col("status").alias("_s"), F.col("verdict").alias("_v"), F.col("reason").alias("_r"), F.col("pattern_deleted").alias("_d"))
    out = decisions.join(new, "id", "left")
    hit = F.col("_s").isNotNull()
    take = {"review_status": "_s", "review_verdict": "_v", "review_reason": "_r", "pattern_deleted": "_d"}
    return out.select(*[F.when(hit, F.col(take[c])).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in decisions.columns])


def reviewed_findings(findings: DataFrame, decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """``findings`` after reviews of decisions: any review but ``pending`` resolves the decision's finding, its verdict as it is."""
    hit = decisions.select("id", "event_id").join(reviews.where("status <> 'pending'").select("id"), "id", "left_semi").select("event_id").distinct()
    change = hit.select("event_id", F.lit("resolved").alias("new_status"), F.lit("human_review").alias("new_method"), F.lit("").alias("new_verdict"))
    return store.resolve(findings, change)


def with_decision(findings: DataFrame, decisions: DataFrame, prefer: str | None = None) -> DataFrame:
    """``findings`` with ``decision``, the latest of their event, one of tier ``prefer`` before all others; null where there is none."""
    rest = [c for c in decisions.columns if c != "event_id"]
    first = F.lit(False) if prefer is None else F.col("tier") == prefer
    latest = decisions.groupBy("event_id").agg(F.max_by(F.struct(*rest), F.struct(first, "id")).alias("decision"))
    return findings.join(latest, "event_id", "left")


def _asked(corrections: DataFrame, findings: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """Corrections of a kind with their latest finding and its decision; of several on one event the latest counts."""
    mine = corrections.where(F.col("kind") == kind).groupBy("event_id").agg(F.max_by(F.struct("target", F.col("reason").alias("why")), "at").alias("c"))
    rows = store.latest(findings).join(mine, "event_id")
    default = F.coalesce(F.lit(REASONS[kind]) if kind in REASONS else F.concat(F.lit("marked as "), "c.target"), F.lit(""))
    out = with_decision(rows, decisions, "reclassify" if kind == "expected_endpoint" else None)
    return out.withColumn("human_reason", F.concat(F.lit("human: "), F.coalesce(F.nullif("c.why", F.lit("")), default)))


def _or(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def noise(corrections: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patterns that corrections of kind ``noise`` ask for: the line's hash as allowed or suppressed, from a person. scope, bucket, tier, value, source, reason, revoked, ord."""
    rows = _asked(corrections, findings, decisions, "noise").where(F.col("c.target").isin("suppress", "allow"))
    rows = rows.withColumn("value", _or(F.col("normalized_hash"), F.col("decision.normalized_hash"))).where("value <> ''")
    scope = F.concat_ws(":", "source_type", "source_name")
    return rows.select(scope.alias("scope"), F.col("c.target").alias("bucket"), F.lit("hash").alias("tier"), "value", F.lit("human").alias("source"), F.col("human_reason").alias("reason"), F.lit(False).alias("revoked"), F.col("id").cast("long").alias("ord"))


def stale_patterns(corrections: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patterns that corrections of kinds ``noise`` and ``expected_endpoint`` make wrong: those that the decision taught and that the finding matched. scope, bucket, value."""
    parts = []
    for kind in ("noise", "expected_endpoint"):
        rows = _asked(corrections, findings, decisions, kind)
        own = F.concat_ws(":", "source_type", "source_name")
        taught = rows.where("decision.pattern_learned AND coalesce(decision.pattern_value, '') <> ''")
        parts.append(taught.select(_or(F.col("decision.source_scope"), own).alias("scope"), _or(F.col("decision.pattern_bucket"), F.col("decision.action")).alias("bucket"), F.col("decision.pattern_value").alias("value")))
        met = rows.where("coalesce(matched_pattern_value, '') <> '' AND coalesce(matched_pattern_bucket, '') <> ''")
        parts.append(met.select(_or(F.col("matched_pattern_scope"), own).alias("scope"), F.col("matched_pattern_bucket").alias("bucket"), F.col("matched_pattern_value").alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def confirmed_patterns(corrections: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patterns that corrections of kind ``confirm`` validate: that which the decision taught, else that which the finding matched, else the line's hash in any bucket (null). scope, bucket, value."""
    rows = _asked(corrections, findings, decisions, "confirm")
    own = F.concat_ws(":", "source_type", "source_name")
    taught = F.coalesce(F.col("decision.pattern_learned") & (F.coalesce("decision.pattern_value", F.lit("")) != ""), F.lit(False))
    met = F.coalesce((F.col("matched_pattern_value") != "") & (F.col("matched_pattern_bucket") != ""), F.lit(False))
    scope = F.when(taught, _or(F.col("decision.source_scope"), own)).when(met, _or(F.col("matched_pattern_scope"), own)).otherwise(own)
    bucket = F.when(taught, _or(F.col("decision.pattern_bucket"), F.col("decision.action"))).when(met, F.col("matched_pattern_bucket"))
    value = F.when(taught, F.col("decision.pattern_value")).when(met, F.col("matched_pattern_value")).otherwise(F.col("normalized_hash"))
    return rows.select(scope.alias("scope"), bucket.alias("bucket"), value.alias("value")).where("coalesce(value, '') <> ''").distinct()


def failed_probes(corrections: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Catch-all rules that corrections of kind ``failed_probe`` ask for, of findings with a host, a method, a status and a captured body. host, http_method, http_status, body_preview_hash, verdict, reason, response_bytes, verified_by."""
    rows = _asked(corrections, findings, decisions, "failed_probe")
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) != 0, F.col(c))
    status = F.coalesce(some("evidence_status_code"), some("http_status"), some("decision.evidence_status"))
    out = rows.select(F.col("dest_host").alias("host"), "http_method", status.alias("http_status"), _or(F.col("evidence_body_hash"), F.col("decision.evidence_hash")).alias("body_preview_hash"), F.lit("benign").alias("verdict"), F.col("human_reason").alias("reason"), "response_bytes", F.col("event_id").alias("verified_by"))
    return out.where("coalesce(host, '') <> '' AND coalesce(http_method, '') <> '' AND http_status IS NOT NULL AND body_preview_hash <> ''")


def expected_endpoints(corrections: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Expected endpoints that corrections of that kind ask for: the body's shape is what the decision on its evidence was kept by, else the hash of the captured body. host, http_method, http_path, http_status, body_preview_hash, description, created_by_event_id."""
    rows = _asked(corrections, findings, decisions, "expected_endpoint")
    judged = F.coalesce((F.col("decision.tier") == "reclassify") & is_hash(F.col("decision.cache_key")), F.lit(False))
    shape = F.when(judged, F.col("decision.cache_key")).when(is_hash(F.col("evidence_body_hash")), F.col("evidence_body_hash"))
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.col(c))
    status = F.coalesce(some("decision.evidence_status"), some("evidence_status_code"), some("http_status"))
    out = rows.select(F.col("dest_host").alias("host"), F.upper("http_method").alias("http_method"), F.substring_index("http_path", "?", 1).alias("http_path"), status.alias("http_status"), shape.alias("body_preview_hash"), F.col("human_reason").alias("description"), F.col("event_id").alias("created_by_event_id"))
    return out.where("coalesce(host, '') <> '' AND coalesce(http_method, '') <> '' AND coalesce(http_path, '') <> '' AND http_status IS NOT NULL AND body_preview_hash IS NOT NULL")


def without_unreviewed(decisions: DataFrame, before: Column) -> DataFrame:
    """``decisions`` without those that nobody reviewed and that are from before a time."""
    return decisions.where(~((F.coalesce("review_status", F.lit("pending")) == "pending") & (F.col("ts") < before)))
