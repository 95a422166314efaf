"""Another try for events that a classifier left without an answer, as its slots were taken.

Waiting rows carry ``attempts`` and ``next_at``; what is due is matched against the patterns first, which may have
been learned in the meantime, and only the rest is asked again. Nothing is given up: an event waits until it is answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.operators import classify
from logsieve.operators import patterns as p
from logsieve.sources.tables import cut

#: Seconds before the second attempt; each further wait is twice as long, up to the most.
WAIT, MOST_WAIT = 60, 3600


def deferred(undecided: DataFrame, now: Column) -> DataFrame:
    """Rows without a verdict with one more of ``attempts`` (0 where there were none) and ``next_at``, when they are due again."""
    before = F.coalesce("attempts", F.lit(0)) if "attempts" in undecided.columns else F.lit(0)
    wait = F.least(F.lit(float(MOST_WAIT)), WAIT * F.pow(F.lit(2.0), before))
    return undecided.withColumns({"next_at": F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + wait), "attempts": (before + 1).cast("int")})


def due(waiting: DataFrame, now: Column) -> DataFrame:
    """Waiting rows whose time has come; those without a time are due."""
    return waiting.where(F.coalesce(F.col("next_at") <= now, F.lit(True)))


def retried(undecided: DataFrame, known: DataFrame, classifier: classify.Classifier = classify.by_rules) -> DataFrame:
    """Rows that ``with_classifier`` left unknown (in its columns), tried again: by the patterns first, then by the classifier.

    What answers is named with ``_retry``. As before, no pattern allows or suppresses a line that discloses secrets.
    Rows that get no answer again keep the verdict unknown.
    """
    hit = F.coalesce(F.col("match").isNotNull() & ~(F.col("disclosure") & F.col("match.bucket").isin("allow", "suppress")), F.lit(False))
    # both ways read what was matched
    rows = cut(p.match(undecided, known).withColumn("_hit", hit), "matched")
    found = rows.where("_hit").withColumns({"verdict": F.col("match.bucket"), "tier": F.col("match.tier"), "reason": F.col("match.reason"), "via": F.concat("match.source", F.lit("_retry"))})
    asked = classify.with_classifier(rows.where("NOT _hit").drop("match", "_hit", *classify.CLASSIFIED[::2], "leads"), classifier)
    asked = asked.withColumn("via", F.when(F.col("via") == "llm", "llm_retry").otherwise(F.col("via")))
    return found.select(*undecided.columns).unionByName(asked.select(*undecided.columns))
