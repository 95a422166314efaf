"""Deterministic identity policy on journal lines, with trusted addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import http
from logsieve.functions import text as t
from logsieve.functions.normalize import unit_base
from logsieve.operators import networks
from logsieve.sources.tables import apart

# The rules in the order in which they are tried. pattern: RE2. action: what a match means.
RULES = [
    {"id": "ssh_login", "units": ["ssh", "sshd"], "pattern": r"Accepted\s+(password|publickey|keyboard-interactive)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)", "action": "escalate", "trust": True},
    {"id": "useradd", "pattern": r"new user:\s+name=(\S+)", "action": "escalate"},
    {"id": "privilege_grant", "pattern": r"(?i)(?:add\s+'?(\S+?)'?\s+to\s+group\s+'?(sudo|wheel|root|admin)'?|usermod\s+.*-aG\s+.*(sudo|wheel|root|admin)\s+(\S+))", "action": "escalate"},
    {"id": "authorized_keys", "pattern": r"(?i)authorized_keys", "action": "escalate"},
    {"id": "sudo_failure", "source": "sudo", "pattern": r"(?:NOT in sudoers|incorrect password attempt|authentication failure.*sudo)", "action": "alert"},
    {"id": "pam_session", "pattern": r"pam_unix\(\S+:session\):\s+session\s+(opened|closed)\s+for\s+user\s+(\S+)", "action": "allow"},
]


def _applies(rule: dict) -> Column:
    found = (F.col("source_type") == "journal") & t.matches(F.col("line"), rule["pattern"])
    if "units" in rule:
        found = found & unit_base(F.coalesce("unit", F.lit(""))).isin(rule["units"])
    if "source" in rule:
        found = found & (F.col("source_name") == rule["source"])
    return F.coalesce(found, F.lit(False))


def _reason(rule: str, g: list[Column]) -> Column:
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return {
        "ssh_login": F.concat(F.lit("Successful SSH login from unknown IP "), g[3], F.lit(" as "), g[2], F.lit(" ("), g[1], F.lit(")")),
        "useradd": F.concat(F.lit("New user created: "), g[1]),
        "privilege_grant": F.concat(F.lit("Privilege escalation: user "), either(g[1], g[4]), F.lit(" added to "), either(g[2], g[3])),
        "authorized_keys": F.lit("SSH authorized_keys file accessed or modified"),
        "sudo_failure": F.lit("Failed sudo attempt - possible privilege escalation"),
        "pam_session": F.concat(F.lit("PAM session "), g[1], F.lit(" for "), g[2], F.lit(" (handled by SSH policy)")),
    }[rule]


def evaluate(events: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """``events`` (source_type, source_name, unit, line, ...) with rule, action, username, source_ip, auth_method and reason of the first rule that matches; null where none does.

    ``trusted`` (ip_address, cidr) makes the action of rules that ask for trust ``allow``.
    """
    chain = lambda value: F.coalesce(*[F.when(_applies(r), value(r)) for r in RULES])
    out = apart(events.withColumn("rule", chain(lambda r: F.lit(r["id"]))))
    groups = {r["id"]: [t.extract(F.col("line"), r["pattern"], i) if i <= re.compile(r["pattern"]).groups else F.lit("") for i in range(5)] for r in RULES}
    pick = lambda value: F.coalesce(*[F.when(F.col("rule") == r["id"], value(r["id"])) for r in RULES])
    users = {"ssh_login": 2, "useradd": 1, "pam_session": 2}
    user = lambda r: F.coalesce(F.nullif(groups[r][1], F.lit("")), groups[r][4]) if r == "privilege_grant" else groups[r][users[r]] if r in users else F.lit("")
    out = out.withColumns({
        "action": pick(lambda r: F.lit(next(x["action"] for x in RULES if x["id"] == r))),
        "username": pick(user),
        "source_ip": pick(lambda r: groups[r][3] if r == "ssh_login" else F.lit("")),
        "auth_method": pick(lambda r: groups[r][1] if r == "ssh_login" else F.lit("")),
    })
    out = apart(apart(out).withColumn("reason", pick(lambda r: _reason(r, groups[r]))))
    if trusted is not None:
        out = networks.with_trust(out, trusted, "source_ip")
        needs = F.col("rule").isin([r["id"] for r in RULES if r.get("trust")])
        out = out.withColumn("action", F.when(needs & F.col("trusted"), "allow").otherwise(F.col("action"))).drop("trusted")
    return out


def findings(evaluated: DataFrame) -> DataFrame:
    """Findings of policy outcomes: none for allow, alerts as they are, escalations as malicious."""
    rows = evaluated.where(F.col("rule").isNotNull() & (F.col("action") != "allow"))
    alert = F.col("action") == "alert"
    return rows.select(
        "event_id", "ts", "source_type", "source_name", "source_ip", "username", "reason",
        F.when(alert, "alert").otherwise("malicious").alias("verdict"),
        F.when(alert, "policy_alert").otherwise("policy_escalated").alias("classification"),
        F.lit(1.0).alias("confidence"), F.concat(F.lit("policy:"), "rule").alias("matched_via"), F.col("line").alias("raw_line"),
        (~alert).alias("notify"),
    )
