"""Verdicts on log events: policy, noise, failed probes, patterns, and a pluggable classifier for the rest; then routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import filters, http
from logsieve.functions import normalize as n
from logsieve.operators import patterns as p
from logsieve.operators import policy
from logsieve.sources.tables import apart, cut, held

NOISE_REASON = "Deterministic: application stack trace or framework noise"
#: What a classifier adds to (scope, hash, disclosure, normalized, line): an action of allow, suppress, alert or malicious.
CLASSIFIED = ["classification", "action", "confidence", "reason"]
Classifier = Callable[[DataFrame], DataFrame]
#: Columns of decided events that ``with_classifier`` and ``learned`` read. What else an event has is written at each cut point.
DECIDED = ["event_id", "scope", "hash", "disclosure", "normalized", "line", "verdict", "tier", "reason", "via"]


def prepared(events: DataFrame) -> DataFrame:
    """``events`` (source_type, source_name, line, ...) with scope, normalized, hash and disclosure."""
    out = n.with_normalized(events.withColumn("scope", F.concat_ws(":", "source_type", "source_name")))
    return out.withColumns({"hash": n.line_hash(F.col("normalized")), "disclosure": filters.disclosure(F.col("line")) | filters.disclosure(F.col("normalized"))})


def deterministic(events: DataFrame, known: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """``events`` with verdict, tier, reason and via of the first that speaks: policy, noise, failed probe, pattern; verdict unknown where none does.

    A line that discloses secrets is never suppressed or allowed: neither as noise or probe nor by a pattern.
    Each step is a column that is computed once, and only for lines that no step before it has decided. Steps are
    compiled apart, as all of them exceed what one generated method may hold.
    """
    out = policy.evaluate(apart(prepared(events)), trusted).withColumnRenamed("reason", "_policy_reason")
    out = apart(out)
    ruled = F.col("rule").isNotNull()
    quiet = ~ruled & ~F.col("disclosure")
    out = apart(out.withColumn("_noise", F.when(quiet & filters.operational_noise(F.col("line")), NOISE_REASON)))
    out = filters.with_failed_probe(out, "normalized", "_probe", quiet & F.col("_noise").isNull())
    out = out.withColumn("_noise", F.coalesce("_noise", "_probe")).drop("_probe")
    noise = F.col("_noise").isNotNull()
    out = p.match(apart(out), known, ~ruled & ~noise)
    hit = F.col("match").isNotNull() & ~(F.col("disclosure") & F.col("match.bucket").isin("allow", "suppress"))
    by_rule = F.when(F.col("action") == "escalate", "malicious").otherwise(F.col("action"))
    return out.withColumns({
        "via": F.when(ruled, "policy").when(noise, "noise_filter").when(hit, F.col("match.source")).otherwise("unknown"),
        "verdict": F.when(ruled, by_rule).when(noise, "suppress").when(hit, F.col("match.bucket")).otherwise("unknown"),
        "tier": F.when(hit, F.col("match.tier")),
        "reason": F.when(ruled, F.col("_policy_reason")).when(noise, F.col("_noise")).when(hit, F.col("match.reason")),
    }).drop("_policy_reason", "_noise", "match")


def _with_marks(rows: DataFrame) -> DataFrame:
    """``rows`` (normalized) with ``_marked``: whether the request's path has marks of an attack. The request is searched for once and apart."""
    rows = apart(rows.withColumn("_words", http.words(F.col("normalized"))))
    rows = apart(rows.withColumn("_path", http.part_of(F.col("_words"), "path")))
    return apart(rows.withColumn("_marked", (F.col("_path") != "") & filters.attack_marks(F.col("_path")))).drop("_words", "_path")


def by_rules(groups: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: disclosures are malicious, requests with attack marks suspicious, all else safe."""
    groups = _with_marks(groups)
    marked = F.col("_marked")
    return groups.withColumns({
        "classification": F.when(F.col("disclosure"), "malicious").when(marked, "suspicious").otherwise("safe"),
        "action": F.when(F.col("disclosure"), "malicious").when(marked, "alert").otherwise("allow"),
        "confidence": F.lit(0.9),
        "reason": F.when(F.col("disclosure"), "discloses secrets").when(marked, "attack marks in the request").otherwise("nothing of note"),
    })


def with_classifier(decided: DataFrame, classifier: Classifier = by_rules) -> DataFrame:
    """``decided`` with its unknown rows classified, one call for each (scope, hash, disclosure).

    A group's line is that of its smallest event_id, its leader. A malicious verdict on a line with an HTTP
    request becomes an alert, as only its response shows whether it had an effect. Verdicts are cut first, so
    that they are computed once; only unknown rows are joined to the answers, which are broadcast if they are
    few, so that a line that recurs a million times stays spread.
    """
    key = ["scope", "hash", "disclosure"]
    decided = cut(decided, "decided")
    unknown = decided.where("verdict = 'unknown'")
    groups = unknown.groupBy(*key).agg(F.min_by(F.struct("normalized", "line"), "event_id").alias("l"), F.min("event_id").alias("leader"))
    answers = classifier(groups.select(*key, "l.normalized", "l.line", "leader")).select(*key, "leader", *[F.col(c).alias(f"_{c}") for c in CLASSIFIED])
    out = unknown.join(p.small(cut(answers, "answers")), key, "left")
    got = F.col("_action").isNotNull()
    out = http.with_identity(http.with_identity(out, "normalized", "_norm"), "line", "_raw", http.RAW_SHAPES)
    request = (F.col("_norm.method") != "") | (F.col("_raw.method") != "")
    applied = F.when((F.col("_action") == "malicious") & request, "alert").otherwise(F.col("_action"))
    new = {
        "verdict": F.when(got, applied).otherwise(F.col("verdict")), "via": F.when(got, "llm").otherwise(F.col("via")), "reason": F.when(got, F.col("_reason")).otherwise(F.col("reason")),
        "classification": F.when(got, F.col("_classification")), "confidence": F.when(got, F.col("_confidence")), "leads": got & (F.col("leader") == F.col("event_id")),
    }
    columns = [*decided.columns, "classification", "confidence", "leads"]
    known = decided.where("verdict <> 'unknown'").withColumns({"classification": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "leads": F.lit(False)})
    return known.select(*columns).unionByName(out.select(*[new.get(c, F.col(c)).alias(c) for c in columns]))


def learned(classified: DataFrame) -> DataFrame:
    """New patterns from a classifier's verdicts (one row for each group's leader): the line's hash in the verdict's bucket, from a confidence of 0.7.

    Lines that disclose secrets or have attack marks are never learned as allowed or suppressed. From a
    confidence of 0.85, an allowed or suppressed line also teaches the wider pattern that the classifier names
    (columns pattern_type and pattern, if there are any), unless it has a fault.
    """
    quiet = F.col("verdict").isin("allow", "suppress")
    rows = _with_marks(classified.where(F.col("leads") & (F.col("confidence") >= 0.7)))
    # held, as a filter that is moved below would search for the request once more, in one method with all else
    rows = rows.where(held(~(quiet & (F.col("disclosure") | F.col("_marked")))))
    common = ["scope", F.col("verdict").alias("bucket")]
    rest = [F.lit("llm").alias("source"), "reason", F.lit(False).alias("revoked"), F.col("event_id").cast("long").alias("ord")]
    out = rows.select(*common, F.lit("hash").alias("tier"), F.col("hash").alias("value"), *rest)
    if "pattern" not in classified.columns:
        return out
    wide = rows.where(quiet & (F.col("confidence") >= 0.85) & F.col("pattern_type").isin("prefix", "regex", "contains") & (F.coalesce("pattern", F.lit("")) != ""))
    wide = p.faults(wide.select(*common, F.col("pattern_type").alias("tier"), F.col("pattern").alias("value"), *rest, F.col("normalized").alias("original_line"))).where("fault IS NULL")
    return out.unionByName(wide.select(*out.columns))


def routed(classified: DataFrame) -> DataFrame:
    """``classified`` with route and notify: what becomes of each event.

    none: allowed, suppressed or unknown; policy: a finding by policy; recon: the classifier saw that the attempt
    failed; recon_status: the server turned the request away; edge_inferred: a bare address that answered 200;
    coordinator: wait for the response; finding: at once. ``http_path`` is the request's own path where the raw line
    shows it, ``key_path`` the normalised one, by which the events of one request are joined; method and status are
    the raw line's where it has them.
    """
    out = http.with_identity(http.with_identity(classified, "line", "_raw", http.RAW_SHAPES), "normalized", "_norm")
    raw, norm = F.col("_raw"), F.col("_norm")
    first: Callable[[str], Column] = lambda c: F.when(raw["method"] != "", raw[c]).otherwise(norm[c])
    out = out.withColumns({
        "http_method": first("method"), "http_path": first("path"), "http_status": first("status"), "http_host": norm["host"],
        "key_path": F.when(norm["path"] != "", norm["path"]).otherwise(raw["path"]),
    }).drop("_raw", "_norm")
    is_http = F.col("http_method") != ""
    route = (
        F.when(~F.col("verdict").isin("alert", "malicious"), "none").when(F.col("via") == "policy", "policy").when(F.coalesce("classification", F.lit("")) == "recon_failed", "recon")
        .when((F.col("via") != "llm") & is_http & http.rejects(F.col("http_status")), "recon_status")
        .when(is_http & http.bare_ip(F.col("http_host")) & (F.col("http_status") == 200), "edge_inferred")
        .when(is_http, "coordinator").otherwise("finding")
    )
    notify = F.when(F.col("via") == "policy", F.col("verdict") == "malicious").otherwise((F.col("route") == "finding") & (F.col("verdict") == "malicious"))
    return out.withColumn("route", route).withColumn("notify", notify)


def recon_findings(rows: DataFrame) -> DataFrame:
    """Findings of verdict ``recon`` for rows of ``routed`` whose route is recon, recon_status or edge_inferred: classification, reason, downgraded, resolution and the verdict before."""
    rows = rows.where(F.col("route").isin("recon", "recon_status", "edge_inferred"))
    plain, status = F.col("route") == "recon", F.col("route") == "recon_status"
    why = F.when(status, F.format_string("Known attack pattern (via:%s) rejected by server - HTTP %d confirms failure", F.col("via"), F.col("http_status")))
    why = why.when(~plain, F.format_string("Attack probe hit bare-IP default server (%s) - HTTP 200 is the default page, no backend application involved", F.col("http_host")))
    return rows.select(
        "event_id", F.lit("recon").alias("verdict"), F.when(plain, F.col("classification")).when(status, "recon_failed_status").otherwise("edge_inferred").alias("classification"), F.when(plain, F.col("reason")).otherwise(why).alias("reason"),
        "http_method", "http_path", "http_status", (~plain).alias("downgraded"), F.when(plain, "").otherwise(why).alias("downgrade_reason"), F.when(plain, "").otherwise("resolved").alias("resolution_status"),
        F.when(plain, "").when(status, "status_only").otherwise("bare_ip_default_server").alias("resolution_method"), F.when(plain, "").otherwise(F.col("verdict")).alias("previous_verdict"), F.lit(False).alias("notify"),
    )
