"""What evidence says on an alert, what is decided from it, and the finding that comes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import answers, redact
from logsieve.functions import text as t
from logsieve.operators import evidence as ev
from logsieve.operators import sweep
from logsieve.operators.patterns import small
from logsieve.sources.tables import cut

#: Seconds between an alert and its response, at most.
WINDOW = 10
# Statuses by which a server turned an attack away, the milliseconds from which such an answer is too slow to trust, and the most bytes of a page that stands for a catch-all.
TURNED_AWAY = [403, 404, 405, 410]
SLOW_MS = 3000
CATCH_ALL_BYTES = 10_000
# Stored verdicts of a page that make it a catch-all, and the distinct paths that make one a candidate.
VERIFIED = ["benign", "verified"]
PATHS = 5
_TRANSPORT = ["resp_status", "content_type", "resp_method", "resp_ts", "request_ts", "body"]
#: What a classifier says on evidence: adds classification, generic (whether the answer is one for everybody), reason.
Judge = Callable[[DataFrame], DataFrame]


def evidence(alerts: DataFrame, responses: DataFrame, window: int = WINDOW) -> DataFrame:
    """``alerts`` with ``evidence``, a struct on the best captured response of each: status, confidence, candidates, status_code, content_type, content_length, body_hash, capture_mode, duration_ms, format, redactions, summary, preview.

    ``responses`` as ``evidence.candidates`` takes them, with request_ts and body. A path out of an access log is
    compared with its escapes decoded. The preview is empty unless both the correlation and the redaction are of
    high confidence. The duration is that between request and response, where both were seen in this order.
    """
    asked = alerts.withColumn("path", t.log_unescape(F.col("path")))
    found = sweep.best(asked, responses, window, _TRANSPORT)
    found = redact.with_disclosure(found, "body", "content_type", "_d")
    high = F.col("confidence") == "HIGH"
    took = ((F.col("resp_ts").cast("double") - F.col("request_ts").cast("double")) * 1000).cast("long")
    lone = F.coalesce("resp_method", F.lit("")) == ""
    seen = F.struct(
        F.when(high, "available_high_confidence").otherwise("available_low_confidence").alias("status"), F.lower("confidence").alias("confidence"), "candidates",
        F.col("resp_status").alias("status_code"), "content_type", "content_length", "body_hash", F.when(lone, "single_segment_preview_orphan").otherwise("single_segment_preview").alias("capture_mode"),
        F.when(took > 0, took).alias("duration_ms"), "_d.format", "_d.redactions", "_d.summary", F.when(high & (F.col("_d.confidence") == "high"), F.col("_d.preview")).otherwise("").alias("preview"),
    )
    out = alerts.join(found.select("event_id", seen.alias("evidence")), "event_id", "left")
    none = F.struct(F.lit("not_available_no_match").alias("status"), F.lit("none").alias("confidence"), F.lit(0).cast("long").alias("candidates"), *[F.lit(None).cast(k).alias(c) for c, k in (
        ("status_code", "int"), ("content_type", "string"), ("content_length", "long"), ("body_hash", "string"), ("capture_mode", "string"), ("duration_ms", "long"), ("format", "string"), ("redactions", "int"), ("summary", "string"))], F.lit("").alias("preview"))
    return out.withColumn("evidence", F.coalesce("evidence", none))


def evidence_columns(evidence_: Column) -> list[Column]:
    """The five columns of a finding that evidence fills."""
    names = {"status": "evidence_status", "status_code": "evidence_status_code", "content_type": "evidence_content_type", "body_hash": "evidence_body_hash", "capture_mode": "evidence_capture_mode"}
    empty = {"status_code": F.lit(0)}
    return [F.coalesce(evidence_[k], empty.get(k, F.lit(""))).alias(v) for k, v in names.items()]


def endpoint_key(host: str, method: str, path: str, status: Column, body_hash: Column) -> list[Column]:
    """What an expected endpoint is known by: host, method in upper case, path without query, status, hash of the redacted body."""
    return [F.col(host).alias("_host"), F.upper(method).alias("_method"), F.substring_index(path, "?", 1).alias("_path"), status.alias("_status"), body_hash.alias("_shape")]


def with_endpoints(alerts: DataFrame, endpoints: DataFrame, status: Column, shape: Column) -> DataFrame:
    """``alerts`` (host, method, path) with ``expected``: why a person said that this endpoint answers like that; null where nobody did. ``endpoints``: host, http_method, http_path, http_status, body_preview_hash, description."""
    rules = endpoints.select(*endpoint_key("host", "http_method", "http_path", F.col("http_status"), F.col("body_preview_hash")), F.col("description").alias("_why"))
    rules = rules.where("_host <> '' AND _shape <> ''").groupBy("_host", "_method", "_path", "_status", "_shape").agg(F.max("_why").alias("_why"))
    keys = ["_host", "_method", "_path", "_status", "_shape"]
    out = alerts.select("*", *endpoint_key("host", "method", "path", status, shape)).join(small(rules), keys, "left")
    reason = F.format_string("Expected endpoint: operator confirmed %s %s%s [status %d] returns sensitive-looking response by design (shape hash %s) - %s", F.col("_method"), F.col("_host"), F.col("_path"), F.col("_status"), F.substring("_shape", 1, 16), F.col("_why"))
    return out.withColumn("expected", F.when(F.col("_why").isNotNull(), reason)).drop(*keys, "_why")


def rules_of(seen: DataFrame) -> DataFrame:
    """Catch-all rules out of what the pages' state machine said (key: host|method|status|hash, at, event_id, state, paths, reason), as ``decisions`` takes them: pages that were verified or rejected. Lengths of pages are not known here (0), so none stands for an alert by its length."""
    last = seen.groupBy("key").agg(F.max_by(F.struct("state", "paths"), F.struct("at", "event_id")).alias("l"), F.max("reason").alias("reason"))
    part = lambda i: F.substring_index(F.substring_index("key", "|", i), "|", -1)
    return last.where(F.col("l.state").isin("verified", "rejected")).select(part(1).alias("host"), part(2).alias("http_method"), part(3).cast("int").alias("http_status"), part(4).alias("body_preview_hash"), F.col("l.state").alias("verdict"), "reason", F.lit(0).cast("long").alias("response_bytes"), "l.paths")


def known_rules(stored: DataFrame) -> DataFrame:
    """Catch-all rules as decisions use them: host, _method, status, body_hash, state (verified or rejected), _why, _length, _paths; one for each page of a host.

    A stored verdict ``benign`` makes a rule verified, whoever gave it; ``rejected`` vetoes. A rule without a number
    of paths stands for as many as make a page a candidate. Of two rules on one page the veto counts, then the larger.
    """
    paths = F.coalesce("paths", F.lit(PATHS)) if "paths" in stored.columns else F.lit(PATHS)
    state = F.when(F.col("verdict").isin(VERIFIED), "verified").when(F.col("verdict") == "rejected", "rejected")
    rows = stored.select("host", F.upper("http_method").alias("_method"), F.col("http_status").alias("status"), F.coalesce("body_preview_hash", F.lit("")).alias("body_hash"), state.alias("state"), F.coalesce("reason", F.lit("")).alias("_why"), F.coalesce("response_bytes", F.lit(0)).cast("long").alias("_length"), paths.cast("long").alias("_paths"))
    rows = rows.where("state IS NOT NULL AND coalesce(host, '') <> ''")
    best = F.max_by(F.struct("state", "_why", "_length", "_paths"), F.struct(F.col("state") == "rejected", "_paths", "_length", "_why"))
    return rows.groupBy("host", "_method", "status", "body_hash").agg(best.alias("r")).select("host", "_method", "status", "body_hash", "r.*")


def with_catch_alls(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """``responses`` (host, method, status, body_hash) with ``catch_all``: why their page stands for all paths of a host; null where it does not. ``rules``: host, http_method, http_status, body_preview_hash, verdict, reason, response_bytes and, if there are any, paths."""
    known = known_rules(rules).where("state = 'verified' AND body_hash <> ''").select("host", "_method", "status", "body_hash", "_why", "_paths")
    out = responses.withColumn("_method", F.upper("method")).join(small(known), ["host", "_method", "status", "body_hash"], "left")
    reason = F.format_string("Verified catch-all: %d distinct paths on %s all returned identical %s %d response (body hash %s) - %s", F.col("_paths"), F.col("host"), F.col("_method"), F.col("status"), F.substring("body_hash", 1, 16), F.col("_why"))
    return out.withColumn("catch_all", F.when(F.col("_why").isNotNull(), reason)).select(*responses.columns, "catch_all")


def catch_all_by_bytes(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """``alerts`` (host, method, status, bytes; no captured response) with ``by_bytes``: why a verified catch-all page of their host, method and status, of nearly their length, stands for them; null where none does.

    Only GET and HEAD answers of at most CATCH_ALL_BYTES count. One rejected page of a host, method and status
    vetoes all of them. Of several pages that fit, the one with the smallest hash is named. A host's verified pages
    of one method and status are one sorted array, so that an alert stays one row.
    """
    key = ["host", "_method", "status"]
    page = F.when((F.col("state") == "verified") & (F.col("_length") > 0), F.struct("body_hash", "_length", "_paths"))
    known = known_rules(rules).groupBy(*key).agg(F.max((F.col("state") == "rejected").cast("int")).alias("_veto"), F.sort_array(F.collect_list(page)).alias("_pages"))
    known = known.where("_veto = 0 AND size(_pages) > 0").drop("_veto")
    out = alerts.withColumn("_method", F.upper("method")).join(small(known), key, "left")
    can = F.col("bytes").between(1, CATCH_ALL_BYTES) & F.col("_method").isin("GET", "HEAD")
    out = out.withColumn("_page", F.when(can, F.get(F.filter("_pages", lambda v: ev.catch_all_bytes_fit(F.col("bytes"), v["_length"])), F.lit(0))))
    reason = F.format_string(
        "Catch-all fallback (REC-miss): verified pattern exists for %s %s %d (hash %s, %d prior paths, verified bytes=%d) - log responseBytes=%d within tolerance",
        F.col("_method"), F.col("host"), F.col("status"), F.substring("_page.body_hash", 1, 16), F.col("_page._paths"), F.col("_page._length"), F.col("bytes"),
    )
    return out.withColumn("by_bytes", F.when(F.col("_page").isNotNull(), reason)).select(*alerts.columns, "by_bytes")


def decisions(alerts: DataFrame, endpoints: DataFrame, cache: DataFrame, judge: Judge, slow_ms: int = SLOW_MS, catch_alls: DataFrame | None = None) -> DataFrame:
    """``alerts`` (event_id, host, method, path, status, bytes, verdict, classification, evidence) with ``step``, ``outcome`` (downgraded, escalated or kept), ``new_classification``, ``decision_reason`` and ``leader``.

    The first step that applies decides: no_request; transport (the server turned the request away, unless it took
    too long over it); no_evidence; no_preview; endpoint (expected by a person); cached (``cache``: body_hash,
    classification, outcome, reason); judged. The judge sees each redacted body once, with the alert of the
    smallest event_id, its leader; the others' reasons name that one. What no step has changed is then held against
    ``catch_alls`` (as for ``with_catch_alls``): catch_all by the captured body's hash, or, where no body was seen,
    catch_all_bytes by the length. An alert that brings a ``body_hash`` of its own is held against them before all else.
    """
    e = F.col("evidence")
    turned = e["status_code"].isin(TURNED_AWAY) & ~((F.lit(slow_ms) > 0) & (F.coalesce(e["duration_ms"], F.lit(0)) >= slow_ms))
    status = F.when(F.coalesce(e["status_code"], F.lit(0)) > 0, e["status_code"]).otherwise(F.col("status"))
    shape = F.when(e["preview"] != "", F.sha2(e["preview"], 256))
    # rules are counted and joined, those on pages three times, and may be made from all lines
    endpoints = cut(endpoints, "endpoints")
    catch_alls = None if catch_alls is None else cut(catch_alls, "catch-alls")
    out = with_endpoints(alerts, endpoints, status, shape).withColumn("_shape", shape)
    known = cache.select(F.col("body_hash").alias("_shape"), F.struct("outcome", "classification", "reason").alias("_cached")).groupBy("_shape").agg(F.max("_cached").alias("_cached"))
    out = out.join(small(known), "_shape", "left")
    step = (
        F.when(F.coalesce("method", F.lit("")) == "", "no_request").when(F.coalesce(turned, F.lit(False)), "transport").when(e["candidates"] == 0, "no_evidence").when(e["preview"] == "", "no_preview")
        .when(F.col("expected").isNotNull(), "endpoint").when(F.col("_cached").isNotNull(), "cached").otherwise("judged")
    )
    assumed = F.when(F.coalesce("classification", F.lit("")) != "", F.col("classification")).when(F.col("verdict") == "malicious", "malicious").otherwise("suspicious")
    assumed = F.when((F.col("verdict") == "alert") & (assumed == "malicious"), "suspicious").otherwise(assumed)
    out = out.withColumn("step", step).withColumn("_before", assumed)
    if catch_alls is not None:
        own = F.nullif("body_hash", F.lit("")) if "body_hash" in alerts.columns else F.lit(None).cast("string")
        out = out.withColumn("_own", own)
        out = _caught(out, F.col("_own"), catch_alls, "_first_caught")
        out = out.withColumn("step", F.when(F.col("_first_caught").isNotNull(), "catch_all").otherwise(F.col("step")))
        out = _caught(out, F.coalesce("_own", F.nullif(e["body_hash"], F.lit(""))), catch_alls, "_caught")
        out = _rules_by_bytes(out, F.coalesce("_own", F.nullif(e["body_hash"], F.lit(""))), catch_alls)
    # both the judge's questions and the decisions read this
    out = cut(out, "evidence")
    first = out.where("step = 'judged'").groupBy("_shape").agg(F.min_by(F.struct(F.col("_before").alias("before"), "evidence.preview", "evidence.status_code", "evidence.redactions"), "event_id").alias("q"), F.min("event_id").alias("leader"))
    said = judge(first.select("_shape", "leader", "q.*")).select("_shape", "leader", F.col("before").alias("_first"), F.col("classification").alias("_new"), F.col("generic").alias("_generic"), F.col("reason").alias("_said"))
    # only judged rows are joined, as most others have no shape
    asked = out.where("step = 'judged'").join(said, "_shape", "left")
    out = asked.unionByName(out.where("step <> 'judged'"), allowMissingColumns=True)
    # one body has one answer, that on its leader's alert
    judged = F.when(answers.downgrades(F.col("_first"), F.col("_new")), "downgraded").when(answers.escalates(F.col("_first"), F.col("_new")), "escalated").otherwise("kept")
    by_status = F.format_string("Transport evidence confirms attack failed (HTTP %d) - payload was rejected/ignored by the server", e["status_code"])
    follows = F.when(F.col("leader") != F.col("event_id"), F.concat(F.col("_said"), F.lit(" (coalesced with "), F.col("leader").cast("string"), F.lit(")"))).otherwise(F.col("_said"))
    s = F.col("step")
    new = {
        "outcome": F.when(s.isin("transport", "endpoint", "catch_all"), "downgraded").when(s == "cached", F.col("_cached.outcome")).when(s == "judged", judged).otherwise("kept"),
        "new_classification": F.when(s == "cached", F.col("_cached.classification")).when(s == "judged", F.col("_new")),
        "decision_reason": F.when(s == "transport", by_status).when(s == "endpoint", F.col("expected")).when(s == "cached", F.col("_cached.reason")).when(s == "judged", follows).otherwise(""),
        "generic": F.coalesce((s == "judged") & F.col("_generic"), F.lit(False)),
    }
    out = out.withColumns(new)
    if catch_alls is not None:
        first, later, length = (F.col(c).isNotNull() for c in ("_first_caught", "_caught", "_by_bytes"))
        kept = F.col("outcome") == "kept"
        late = {"catch_all": kept & later, "catch_all_bytes": kept & ~later & length}
        hit = late["catch_all"] | late["catch_all_bytes"]
        out = out.withColumns({
            "step": F.when(late["catch_all"], "catch_all").when(late["catch_all_bytes"], "catch_all_bytes").otherwise(s), "outcome": F.when(hit, "downgraded").otherwise(F.col("outcome")),
            "new_classification": F.when(~hit, F.col("new_classification")), "generic": ~hit & F.col("generic"),
            "decision_reason": F.when(first, F.col("_first_caught")).when(late["catch_all"], F.col("_caught")).when(late["catch_all_bytes"], F.col("_by_bytes")).otherwise(F.col("decision_reason")),
        }).drop("_own", "_first_caught", "_caught", "_by_bytes")
    return out.drop("_before", "_first", "_new", "_generic", "_said", "_cached", "expected").withColumnRenamed("_shape", "shape")


def _caught(rows: DataFrame, body_hash: Column, rules: DataFrame, name: str) -> DataFrame:
    """``rows`` with the reason of ``with_catch_alls`` for a body's hash as the column ``name``."""
    kept = rows.columns
    seen = rows.withColumn("_row_hash", F.col("body_hash") if "body_hash" in kept else F.lit(None)).withColumn("body_hash", body_hash)
    out = with_catch_alls(seen, rules)
    return out.select(*[F.col("_row_hash").alias(c) if c == "body_hash" else F.col(c) for c in kept], F.col("catch_all").alias(name))


def _rules_by_bytes(rows: DataFrame, body_hash: Column, rules: DataFrame) -> DataFrame:
    """``rows`` with the reason of ``catch_all_by_bytes`` as ``_by_bytes``, where no body was seen."""
    out = catch_all_by_bytes(rows, rules)
    return out.select(*rows.columns, F.when(body_hash.isNull(), F.col("by_bytes")).alias("_by_bytes"))


def cacheable(decided: DataFrame) -> DataFrame:
    """Judgements that hold for the next alert with the same redacted body: downgrades of generic answers from which nothing was redacted. body_hash, outcome, classification, reason."""
    rows = decided.where("step = 'judged' AND leader = event_id AND outcome = 'downgraded' AND generic AND evidence.redactions = 0")
    return rows.select(F.col("shape").alias("body_hash"), "outcome", F.col("new_classification").alias("classification"), F.col("decision_reason").alias("reason"))


#: Columns of an alert that its finding takes over, if the alert has them.
CARRIED = ["source_type", "source_name", "response_bytes", "matched_via", "matched_pattern_scope", "matched_pattern_bucket", "matched_pattern_value", "origin_event_id", "raw_line", "normalized_hash", "coordinator_key", "coordinator_events"]


def severity(verdict: Column) -> Column:
    """The severity at which an alert of this verdict is handled."""
    return F.when(verdict == "alert", "suspicious").otherwise("malicious")


def final_findings(decided: DataFrame) -> DataFrame:
    """Findings of alerts after ``decisions``: verdict, classification (the alert's severity, which only an escalation changes), reason, downgraded, previous_verdict, notify and the resolution, with the columns of evidence and those of CARRIED that there are."""
    down, up = F.col("outcome") == "downgraded", F.col("outcome") == "escalated"
    return decided.select(
        "event_id", "ts", F.col("host").alias("dest_host"), F.col("method").alias("http_method"), F.col("path").alias("http_path"), F.col("status").alias("http_status"),
        F.when(down, "downgraded").when(up, "malicious").otherwise(F.col("verdict")).alias("verdict"),
        F.when(up, "malicious").otherwise(severity(F.col("verdict"))).alias("classification"),
        F.when(up, F.col("decision_reason")).otherwise(F.col("reason")).alias("reason"), *evidence_columns(F.col("evidence")),
        down.alias("downgraded"), F.when(down, F.col("decision_reason")).otherwise("").alias("downgrade_reason"), up.alias("notify"),
        F.when(down | up, "resolved").otherwise("pending").alias("resolution_status"), F.when(down | up, "rec_evidence").otherwise("").alias("resolution_method"),
        F.when(down, F.col("verdict")).when(up, "alert").otherwise("").alias("previous_verdict"), *[c for c in CARRIED if c in decided.columns],
    )


def merged_events(events: DataFrame) -> DataFrame:
    """One row for each investigation (key): its number of events and what they say together.

    ``events``: key, seq (order of arrival), http_method, http_path, host, user_agent, response_bytes, line,
    normalized, source_name, classification, pattern. The first that is not empty counts for the request, a path
    without placeholders before one that has some; the last that is not empty for the rest.
    """
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    raw = F.when(~F.contains("http_path", F.lit("<NUM>")), named("http_path"))
    # null and empty values rank behind all others
    first = lambda value, name: F.min_by(value, F.struct(value.isNull(), "seq")).alias(name)
    last = lambda value, name: F.max_by(value, F.struct(value.isNotNull(), "seq")).alias(name)
    out = events.groupBy("key").agg(
        F.count("*").alias("events"), *[first(named(c), c) for c in ("http_method", "host", "user_agent")], first(raw, "_raw"), first(named("http_path"), "_any"),
        F.min_by("response_bytes", F.struct(~(F.coalesce("response_bytes", F.lit(0)) > 0), "seq")).alias("response_bytes"), *[last(named(c), c) for c in ("line", "normalized", "source_name", "classification", "pattern")],
    )
    return out.withColumn("http_path", F.coalesce("_raw", "_any")).drop("_raw", "_any")
