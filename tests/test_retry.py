"""Undecided events are tried again: by new patterns, by the classifier, with growing waits."""

import datetime as dt

from pyspark.sql import functions as F

from logsieve.operators import classify, retry
from logsieve.operators import patterns as p
from logsieve.sources import journal

COLUMNS = "event_id long, scope string, hash string, normalized string, line string, disclosure boolean, verdict string, via string, tier string, reason string, classification string, confidence double, leads boolean"


def row(i, line, disclosure=False):
    return (i, "docker:x", f"h{line}", line, line, disclosure, "unknown", "unknown", None, None, None, None, False)


def test_patterns_come_first_and_disclosures_are_not_allowed(spark):
    rows = spark.createDataFrame([row(1, "seen before"), row(2, "seen before, a key", True), row(3, "new"), row(4, "busy")], COLUMNS)
    known = p.patterns(spark, [("docker:x", "allow", "prefix", "seen", "llm", "known", False, 1)])
    got = {r.event_id: r for r in retry.retried(rows, known, lambda g: classify.by_rules(g.where("leader <> 4"))).collect()}
    assert (got[1].verdict, got[1].via, got[1].tier) == ("allow", "llm_retry", "prefix")
    assert (got[2].verdict, got[2].via, got[2].classification) == ("malicious", "llm_retry", "malicious")
    assert (got[3].verdict, got[3].via, got[3].leads) == ("allow", "llm_retry", True)
    assert (got[4].verdict, got[4].via) == ("unknown", "unknown")


def test_waits_grow_to_a_bound(spark):
    now = F.timestamp_seconds(F.lit(1000))
    rows = spark.createDataFrame([(None,), (0,), (1,), (3,), (40,)], "attempts int")
    got = sorted((r.attempts, r.s) for r in retry.deferred(rows, now).select("attempts", F.unix_seconds("next_at").alias("s")).collect())
    assert got == [(1, 1060), (1, 1060), (2, 1120), (4, 1480), (41, 4600)]
    at = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None)], "i int, next_at timestamp")
    assert {r.i for r in retry.due(at, F.lit(dt.datetime(2024, 1, 2))).collect()} == {1, 3}


def test_a_host_watches_the_first_containers_by_name(spark):
    found = spark.createDataFrame([(f"{i:03}", f"n{i % 5}", "h" if i % 2 else None, "public") for i in range(80)] + [("x", "a", "h", "skipped")] + [("001", "n1", "h", "public")], "id string, name string, host string, class string")
    got = journal.covered(found, 7)
    assert got.count() == 82
    for host in ("h", None):
        names = sorted({(f"n{i % 5}", f"{i:03}") for i in range(80) if (i % 2 == 1) == (host == "h")})
        assert {(r.name, r.id) for r in got.where("class = 'public'").where(F.col("host").eqNullSafe(host)).collect()} == set(names[:7])
    assert got.where("class = 'skipped'").count() == 1
