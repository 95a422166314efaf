"""Notifications: which channels an alert goes to, and its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import text as t

# Channels of each severity; others go where alerts go.
ROUTES = {"malicious": ["webhook", "email", "sms", "push/ios", "push/fcm"], "suspicious": ["webhook", "email"], "alert": ["webhook"]}
# Signs before the title of each severity; others have that of suspicious ones.
ICONS = {"malicious": "🚨", "suspicious": "⚠️", "alert": "ℹ️"}


def routed(alerts: DataFrame, routes: dict[str, list[str]] | None = None) -> DataFrame:
    """``alerts`` (severity, ...) once for each channel that takes them, as ``channel``; ``routes`` that lack a severity send it nowhere."""
    routes = ROUTES if routes is None else routes
    sets = {k: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for k, v in {"alert": [], **routes}.items()}
    channels = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in sets.items()], *([F.when(F.col("severity").isin("malicious", "suspicious"), F.array().cast("array<string>"))]), sets["alert"])
    return alerts.withColumn("channel", F.explode(channels))


def title(severity: Column, container: Column, reason: Column, hostname: Column) -> Column:
    icon = F.coalesce(*[F.when(severity == k, v) for k, v in ICONS.items()], F.lit(ICONS["suspicious"]))
    text = F.concat(icon, F.lit(" ["), severity, F.lit("] "), container, F.lit(": "), reason)
    return F.when(F.coalesce(hostname, F.lit("")) != "", F.concat(F.lit("["), hostname, F.lit("] "), text)).otherwise(text)


def body(severity: Column, container: Column, container_id: Column, reason: Column, line: Column, at: Column) -> Column:
    """The plain text of an alert; ``at`` is its time as text."""
    rows = [("Severity: ", severity), ("Container: ", F.concat(container, F.lit(" ("), F.substring(container_id, 1, 12), F.lit(")"))), ("Reason: ", reason), ("Log line: ", t.truncate(line, 500)), ("Time: ", at)]
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in rows])


def journal(evidence: Column) -> Column:
    """One line on a piece of evidence (a struct as ``investigate.evidence`` gives it) for the journal."""
    e = lambda c: evidence[c]
    first = F.concat(F.lit("EvidenceStatus="), e("status"), F.lit(" Correlation="), e("confidence"))
    seen = F.concat(
        F.lit(" StatusCode="), e("status_code").cast("string"), F.lit(" ContentLength="), e("content_length").cast("string"), F.lit(" BodyPreviewHash=sha256:"), F.substring(e("body_hash"), 1, 16),
        F.lit(" CaptureMode="), e("capture_mode"), F.lit(" Format="), e("format"), F.lit(' Disclosure="'), e("summary"), F.lit('"'), F.when(e("preview") != "", " HasPreview=true").otherwise(""),
    )
    return F.when(e("status_code").isNotNull(), F.concat(first, seen)).otherwise(first)
