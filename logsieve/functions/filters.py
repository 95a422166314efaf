"""Predicates on log lines that need no learned rule: disclosure, noise, failed probes, attack marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import http
from logsieve.functions import text as t
from logsieve.functions.normalize import drop_timestamp, sql_drop_timestamp, unit_stem
from logsieve.sources.tables import apart

# Parts of a line that disclose secrets; nothing that has one is ever suppressed.
DISCLOSURE = [
    "root:x:0:0:root",
    "BEGIN RSA PRIVATE KEY",
    "BEGIN OPENSSH PRIVATE KEY",
    "BEGIN EC PRIVATE KEY",
    "BEGIN PRIVATE KEY",
    "BEGIN DSA PRIVATE KEY",
    "AWS_SECRET_ACCESS_KEY",
    "aws_secret_access_key",
    "uid=0(root)",
]
# Marks of an attack in a request; case does not count.
ATTACK = [
    "UNION", "SELECT", "DROP", "INSERT", "UPDATE", "DELETE",
    "../", "..\\",
    "%00", "%0a", "%0d", "%27", "%22",
    "<script", "javascript:",
    ";ls", ";cat", ";rm", ";wget", ";curl",
    "|", "`", "$(", "${",
    "php://", "data://", "file://",
    "eval(", "exec(", "system(",
    "call_user_func", "invokefunction",
]
# Paths of credentials, configuration and debugging.
SENSITIVE = [
    "/.env", "/.git", "/.aws", "/.ssh", "/.docker", "/.htaccess", "/.htpasswd",
    "/wp-admin", "/wp-login", "/wp-config", "/actuator", "/_ignition", "/debug",
    "/phpinfo", "/server-status", "/server-info", "/elmah.axd", "/web.config",
    "/config.php", "/config.json", "/credentials", "/containers/json",
]
# Journal units whose lines are noise.
NOISE_UNITS = [
    "systemd-resolved", "systemd-timesyncd", "systemd-networkd", "systemd-logind", "systemd-journald",
    "systemd-udevd", "snapd", "cron", "anacron", "dbus-daemon", "polkitd", "udisksd",
    "networkd-dispatcher", "multipathd", "irqbalance", "fwupd", "thermald", "dockerd", "containerd",
]
FILE_NOT_FOUND = r'open\(\)\s+"[^"]*"\s+failed\s+\(2:\s*No such file or directory\)'
NOT_FOUND_REASON = "Deterministic: nginx file not found - failed probe"
STATUS_REASON = ("Deterministic: HTTP ", " - failed probe, no exfiltration possible")
# A frame, or the head, of a stack trace, after a timestamp is dropped; all but the first kind after white space.
STACK_TRACE = [
    r"^[ \t](?:[ \t]+at |at [\s\S])",
    rf"^[{t.BLANKS}]*(?:Traceback \(most recent call last\)|Caused by: (?=[\s\S]*[^{t.BLANKS}])|File \"[\s\S]*, line [\s\S]*[^{t.BLANKS}]|(?=goroutine )[\s\S]* \[|at (?=[\s\S]*\()[\s\S]*\.java:)",
]


def disclosure(line: Column) -> Column:
    return t.contains_any(line, DISCLOSURE)


def operational_noise(line: Column) -> Column:
    """Whether a raw line is a frame or head of a stack trace."""
    return ~disclosure(line) & drop_timestamp(line, 30).rlike("|".join(STACK_TRACE))


def with_failed_probe(df: DataFrame, normalized: str, into: str, when: Column | None = None) -> DataFrame:
    """``df`` with ``into``: why a normalised line is a probe that found nothing; null where it is not, or ``when`` does not hold. Its request is searched for once and apart."""
    line = F.col(normalized) if when is None else F.when(when, F.col(normalized))
    df = apart(df.withColumn("_words", http.words(line)))
    df = apart(df.withColumn("_status", http.part_of(F.col("_words"), "status")))
    return df.withColumn(into, failed_probe(line, F.col("_status"))).drop("_words", "_status")


def failed_probe(normalized: Column, status: Column | None = None) -> Column:
    """Why a normalised line is a probe that found nothing; null where it is not. ``status`` is that of its request, if it is known."""
    status = http.part(normalized, http.NORMALIZED_SHAPES, "status") if status is None else status
    found = F.when(t.matches(normalized, FILE_NOT_FOUND), NOT_FOUND_REASON).when(status.isin(http.FAILED), F.concat(F.lit(STATUS_REASON[0]), status, F.lit(STATUS_REASON[1])))
    return F.when(~disclosure(normalized), found)


def decoded(request: Column) -> Column:
    """A request as it is, decoded once, and decoded twice."""
    once = t.url_decode(request)
    return F.array_distinct(F.array(request, once, t.url_decode(once)))


def attack_marks(request: Column) -> Column:
    """Whether a request has a mark of an attack, encoded or not."""
    once = t.url_decode(request)
    marks = lambda c: t.has_any(F.upper(c), [a.upper() for a in ATTACK])
    return marks(request) | (request.rlike("[%+]") & (marks(once) | marks(t.url_decode(once))))


def sensitive_path(request: Column) -> Column:
    return t.has_any(F.lower(request), SENSITIVE)


def noise_unit(unit: Column, more: list[str] | None = None) -> Column:
    """Whether a trusted unit is one whose lines are dropped; an empty unit never is."""
    names = [*NOISE_UNITS, *[m.lower() for m in more or []]]
    return F.coalesce(F.lower(unit_stem(unit)).isin(names), F.lit(False))


# ---- the same in DuckDB SQL ----


def sql_disclosure(line: str) -> str:
    return t.sql_contains_any(line, DISCLOSURE)


def sql_noise(line: str) -> str:
    x = sql_drop_timestamp(line, 30)
    y = t.sql_trim(f"({x})")
    return (
        f"(NOT {sql_disclosure(line)} AND ((regexp_matches({x}, '^[ \\t]+at ') AND strlen({x}) > 4) OR starts_with({y}, 'Traceback (most recent call last)') OR "
        f"(starts_with({y}, 'File \"') AND contains({y}, ', line ')) OR (starts_with({y}, 'goroutine ') AND contains({y}, ' [')) OR "
        f"(starts_with({y}, 'at ') AND contains({y}, '(') AND contains({y}, '.java:')) OR starts_with({y}, 'Caused by: ')))"
    )


def sql_failed_probe(n: str) -> str:
    status = http.sql_part(n, http.NORMALIZED_SHAPES, "status")
    codes = ", ".join(t.q(c) for c in http.FAILED)
    return f"CASE WHEN {sql_disclosure(n)} THEN NULL WHEN regexp_matches({n}, {t.q(FILE_NOT_FOUND)}) THEN {t.q(NOT_FOUND_REASON)} WHEN {status} IN ({codes}) THEN {t.q(STATUS_REASON[0])} || {status} || {t.q(STATUS_REASON[1])} END"
