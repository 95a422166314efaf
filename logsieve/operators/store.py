"""Queries and changes on the tables of findings, decisions and rules. A change is a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = "resolution_status"


def unresolved() -> Column:
    return F.coalesce(RESOLUTION, F.lit("")).isin("", "pending")


def recent(findings: DataFrame, limit: int = 50, *, event_id: str | None = None, source_ip: str | None = None, verdict: str | None = None, open_only: bool = False) -> DataFrame:
    """The latest findings, 1 to 500 of them; of an event, an address or a verdict if given (the first of these wins); of equal times the larger id comes first."""
    for column, value in (("event_id", event_id), ("source_ip", source_ip), ("verdict", verdict)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
            break
    if open_only:
        findings = findings.where(unresolved())
    return findings.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(500, limit)))


def waiting(findings: DataFrame, before: Column, limit: int = 50) -> DataFrame:
    """The oldest open HTTP findings of alert or malicious verdict from before a time, not downgraded."""
    rows = findings.where(unresolved() & F.col("verdict").isin("alert", "malicious") & (F.coalesce("http_method", F.lit("")) != "") & ~F.coalesce("downgraded", F.lit(False)) & (F.col("ts") < before))
    return rows.orderBy("ts", "id").limit(limit)


def verdict_counts(findings: DataFrame, since: Column | None = None) -> DataFrame:
    rows = findings if since is None else findings.where(F.col("ts") >= since)
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def latest(findings: DataFrame) -> DataFrame:
    """The row with the largest id of each event_id."""
    rest = [c for c in findings.columns if c != "event_id"]
    return findings.groupBy("event_id").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("event_id", "r.*")


def resolve(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """``findings`` after ``changes`` (event_id, new_status, new_method, new_verdict, and new_at if times are to be set; one for each event).

    Only open findings take a change; to ``resolved``, those without evidence in time do, too. An empty new
    verdict keeps the old one, and the latest finding's verdict before the change is kept as the previous one. A
    resolution as downgraded or failed recon marks the finding as downgraded. Columns that ``findings`` lacks are
    left out.
    """
    old = findings.groupBy("event_id").agg(F.max_by("verdict", "id").alias("_latest"))
    out = findings.join(changes.join(old, "event_id"), "event_id", "left")
    late = (F.coalesce(RESOLUTION, F.lit("")) == "evidence_unavailable") & (F.col("new_status") == "resolved")
    take = F.col("new_status").isNotNull() & (unresolved() | late)
    down = take & (F.col("new_status") == "resolved") & F.col("new_verdict").isin("downgraded", "recon_failed")
    put = lambda c, when, value: F.when(when, value).otherwise(F.col(c))
    rules = {
        RESOLUTION: (take, F.col("new_status")), "resolution_method": (take, F.col("new_method")), "previous_verdict": (take, F.col("_latest")),
        "verdict": (take & (F.coalesce("new_verdict", F.lit("")) != ""), F.col("new_verdict")), "downgraded": (down, F.lit(True)), "downgrade_reason": (down, F.concat("new_method", F.lit(" resolution"))),
    }
    if "new_at" in changes.columns:
        rules["resolved_at"] = (take, F.col("new_at"))
    return out.select(*[put(c, *rules[c]).alias(c) if c in rules else F.col(c) for c in findings.columns])


def timed_out(findings: DataFrame, before: Column, limit: int = 50) -> DataFrame:
    """Changes for ``resolve`` that give up on the oldest findings that still wait for evidence."""
    rows = waiting(findings, before, limit).select("event_id").distinct()
    return rows.select("event_id", F.lit("evidence_unavailable").alias("new_status"), F.lit("timeout").alias("new_method"), F.lit("").alias("new_verdict"))


def override(findings: DataFrame, events: DataFrame, verdict: str, reason: str) -> DataFrame:
    """``findings`` with the verdict of all rows of ``events`` (event_id) set by a person; one below alert is a downgrade and not notified."""
    hit = F.col("_hit").isNotNull()
    down = hit & F.lit(verdict not in ("alert", "malicious"))
    out = findings.join(events.select("event_id").distinct().withColumn("_hit", F.lit(1)), "event_id", "left")
    new = {"verdict": F.when(hit, verdict).otherwise(F.col("verdict")), "downgraded": F.when(down, True).otherwise(F.col("downgraded")), "reason": F.when(hit, reason).otherwise(F.col("reason")), "notified": F.when(down, False).otherwise(F.col("notified"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in findings.columns])


def _days(now: Column, n: int) -> Column:
    return now - F.make_dt_interval(F.lit(n))


def prune(findings: DataFrame, now: Column) -> DataFrame:
    """What retention keeps: allowed and suppressed findings for 7 days, recon and downgraded ones for 90, others for good."""
    short = F.col("verdict").isin("allow", "suppress") & (F.col("ts") < _days(now, 7))
    long = ((F.col("verdict") == "recon") | F.coalesce("downgraded", F.lit(False))) & (F.col("ts") < _days(now, 90))
    return findings.where(~(short | long))


def prune_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Scanner sessions that were last seen in the last 90 days."""
    return sessions.where(~(F.col("last_seen") < _days(now, 90)))


def prune_stats(stats: DataFrame, now: Column) -> DataFrame:
    """Snapshots of counters of the last 90 days."""
    return stats.where(~(F.col("ts") < _days(now, 90)))


def prune_decisions(decisions_: DataFrame, now: Column) -> DataFrame:
    """Decisions without those that nobody reviewed in 7 days."""
    return decisions_.where(~((F.coalesce("review_status", F.lit("pending")) == "pending") & (F.col("ts") < _days(now, 7))))


def scanner_sessions(findings: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of findings of one address, host and body, with at most ``gap`` between two: first and last seen, probes, and the first and last path."""
    rows = findings.where("coalesce(source_ip, '') <> ''").withColumn("body_hash", F.coalesce("evidence_body_hash", F.lit("")))
    ends = F.array_distinct(F.array(F.min_by("http_path", F.struct("ts", "id")), F.max_by("http_path", F.struct("ts", "id"))))
    out = rows.groupBy("source_ip", "dest_host", "body_hash", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("probes"), ends.alias("sample_paths"))
    return out.drop("w")


def decisions(table: DataFrame, *, tier=None, event_id=None, classification=None, review_status=None, least=0.0, most=0.0, scope_like=None, since=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of decisions, newest first. Filters that are given combine; ``scope_like`` is a part of the scope, whatever the case, in which % and _ are wildcards."""
    equal = {"tier": tier, "event_id": event_id, "classification": classification, "review_status": review_status}
    for column, value in equal.items():
        if value is not None:
            table = table.where(F.col(column) == value)
    if least > 0:
        table = table.where(F.col("confidence") >= least)
    if most > 0:
        table = table.where(F.col("confidence") <= most)
    if scope_like:
        table = table.where(F.col("source_scope").ilike(f"%{scope_like}%"))
    if since is not None:
        table = table.where(F.col("ts") > since)
    return table.orderBy(F.desc("id")).offset(offset).limit(max(1, min(500, limit)))


def decision_counts(table: DataFrame) -> DataFrame:
    """Counts of decisions by review status, tier and classification, and of all, in one pass: kind, value, n."""
    sets = table.groupingSets([("review_status",), ("tier",), ("classification",), ()], "review_status", "tier", "classification")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "review_status").when(F.col("g") == 5, "tier").when(F.col("g") == 6, "classification").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("review_status", "tier", "classification", F.lit("")).alias("value"), "n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``table`` with the rows of ``changes`` put in place of those of the same keys; of several the last by ``order``."""
    rest = [c for c in table.columns if c not in keys]
    rows = table.select(*table.columns, F.lit(0).alias("_new")).unionByName(changes.select(*table.columns, F.lit(1).alias("_new")))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("r")).select(*keys, "r.*").select(*table.columns)


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without the rows whose keys are in ``gone``; null keys are keys like others."""
    out = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
    return table.join(out, same, "left_anti")


def loaded_catch_alls(rules: DataFrame) -> DataFrame:
    """Stored catch-all rules that decisions start with: the benign ones, the last verified first."""
    return rules.where(F.col("verdict") == "benign").orderBy(F.desc("verified_at"))


def pipeline_counters(classified: DataFrame, learned: DataFrame) -> DataFrame:
    """What the cascade did with ``classified`` (of ``with_classifier``) and how many patterns it ``learned``: counter, n."""
    counts = {
        "processed": F.count("*"), "pattern_hits": F.count("tier"), "noise_suppressed": F.count_if(F.col("via") == "noise_filter"), "policy_hits": F.count_if(F.col("via") == "policy"), "llm_calls": F.count_if("leads"),
    }
    one = classified.agg(*[c.alias(k) for k, c in counts.items()]).unpivot([], list(counts), "counter", "n")
    return one.unionByName(learned.agg(F.count("*").alias("n")).withColumn("counter", F.lit("patterns_learned")))


def catch_alls(responses: DataFrame, paths: int = 5) -> DataFrame:
    """Fingerprints (host, method, status, body_hash) of GET and HEAD responses that at least ``paths`` different paths share, with up to ten of these paths."""
    rows = responses.where(F.col("method").isin("GET", "HEAD")).groupBy("host", "method", "status", "body_hash", "path").agg(F.count("*").alias("n"))
    key = ["host", "method", "status", "body_hash"]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    out = ranked.groupBy(*key).agg(F.count("*").alias("paths"), F.sum("n").alias("responses"), F.sort_array(F.collect_list(F.when(F.col("_r") <= 10, F.col("path")))).alias("sample"))
    return out.where(F.col("paths") >= paths)


def hint_consensus(hints: DataFrame, lines: int = 20, share: float = 0.6) -> DataFrame:
    """Kinds of variable fields that classifiers name in enough lines of a scope. ``hints``: scope, seq, fields array<struct<type, token>>; a line that names a kind twice counts twice."""
    all_ = hints.groupBy("scope").agg(F.count("*").alias("lines"))
    named = hints.select("scope", "seq", F.explode("fields").alias("f")).groupBy("scope", F.col("f.type").alias("type")).agg(F.count("*").alias("n"), F.max_by("f.token", "seq").alias("example"))
    return named.join(all_, "scope").where((F.col("lines") >= lines) & (F.col("n") >= F.floor(F.col("lines") * share)))


def rates(stats: DataFrame, counters: list[str]) -> DataFrame:
    """Increase of cumulative counters since the snapshot before, by ``source`` and time; a counter that fell began anew."""
    order = Window.partitionBy("source").orderBy("ts")
    step = lambda c: F.when(F.col(c) >= F.lag(c).over(order), F.col(c) - F.lag(c).over(order)).otherwise(F.col(c))
    return stats.select("source", "ts", *[step(c).alias(c) for c in counters])
