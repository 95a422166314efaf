"""Queries of the keyed state machines, folded over the log lines, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import investigate
from logsieve.plans.lines import LINES
from logsieve.sources.log_lines import log_lines
from logsieve.streaming import keyed

# Templates for both engines; @lines are the log lines. Eight events of a key come within four seconds, and again after 160.
_HUDDLES = """
SELECT concat('k', CAST((event_id - event_id % 8) / 8 % 40 AS BIGINT)) AS key, event_id * 0.5e0 AS at, CASE WHEN event_id % 8 = 5 THEN 'evidence' ELSE 'alert' END AS kind, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE method END AS http_method,
  CASE WHEN event_id % 8 < 2 THEN '/a/<NUM>' WHEN event_id % 5 = 0 THEN '' ELSE path END AS http_path, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('h', CAST(event_id % 7 AS STRING)) END AS host, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'ua' END AS user_agent,
  CASE WHEN event_id % 4 < 2 THEN 0 ELSE bytes END AS response_bytes, line, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('c', CAST(event_id % 5 AS STRING)) END AS classification,
  CASE WHEN event_id % 8 <> 5 THEN '' WHEN event_id % 3 = 0 THEN 'downgraded' WHEN event_id % 3 = 1 THEN 'escalated' ELSE '' END AS outcome, concat('r', CAST(event_id % 3 AS STRING)) AS reason
FROM @lines
"""
_SIGHTS = """
SELECT concat('h', CAST(event_id % 4 AS STRING), '|', method, '|', CAST(status AS STRING), '|b', CAST(event_id % 3 AS STRING)) AS key, event_id * 1.0e0 AS at, CASE WHEN event_id % 40 < 8 AND event_id % 3 = 1 THEN 'verdict' ELSE 'seen' END AS kind, event_id, method,
  concat(path, '/', CAST(CAST((event_id - event_id % 16) / 16 % 13 AS BIGINT) AS STRING), '?q=', CAST(event_id AS STRING)) AS path, CASE WHEN event_id % 5 = 0 THEN 'rejected' ELSE 'verified' END AS outcome, concat('page ', CAST(event_id % 9 AS STRING)) AS reason
FROM @lines WHERE k < 8
"""
_PINNED = """
SELECT concat(method, ' ', CASE WHEN k IN (2, 3) THEN '/' ELSE path END, ' ', CAST(CAST((event_id - event_id % 16) / 16 % 50 AS BIGINT) AS STRING)) AS key, event_id * 0.25e0 AS at, CASE WHEN event_id % 3 = 0 THEN 'pin' ELSE 'response' END AS kind, event_id, CASE WHEN event_id % 4 = 1 THEN 0 ELSE status END AS status
FROM @lines WHERE k < 8 AND event_id % 7 <> 2
"""


def _table(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return spark.sql(template.replace("@lines", "{lines}"), lines=log_lines(spark, sf_dir))


def ended_investigations(spark, sf_dir):
    """Every investigation with what its events say together, and how it ended."""
    return keyed.folded(_table(spark, sf_dir, _HUDDLES), keyed.Investigations())


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.folded(_table(spark, sf_dir, _SIGHTS), keyed.CatchAlls())


def catch_all_sights(spark, sf_dir):
    """What every sight of a page says of it."""
    return _seen(spark, sf_dir).select("event_id", "key", "state", "paths", "caught", "reason")


def catch_all_states(spark, sf_dir):
    """Pages by state."""
    return keyed.catch_all_states(_seen(spark, sf_dir))


def catch_all_rules(spark, sf_dir):
    """Rules for decisions, out of the pages that were settled."""
    return investigate.rules_of(_seen(spark, sf_dir))


def pinned_lookups(spark, sf_dir):
    """Every pinned look-up with the response that answered it."""
    return keyed.folded(_table(spark, sf_dir, _PINNED), keyed.Pins())


QUERIES = {f.__name__: f for f in (ended_investigations, catch_all_sights, catch_all_states, catch_all_rules, pinned_lookups)}


def _with(template: str, rest: str) -> str:
    rows = template.replace("@lines", "l").replace("AS STRING)", "AS VARCHAR)")
    quoted = lambda x: re.sub(r"\bat\b", '"at"', x)  # noqa: E731  (a word of DuckDB's)
    return f"WITH RECURSIVE l AS ({LINES}), x AS ({quoted(rows)}), {quoted(rest)}"


# one row of a key after another: what it finds (a due end comes first), and the state that it leaves
_FIRST = lambda c: f"coalesce(nullif(p.{c}, ''), nullif(n.{c}, ''))"
_LAST = lambda c: f"coalesce(nullif(n.{c}, ''), nullif(p.{c}, ''))"
_MERGED = [(c, _FIRST(c)) for c in ("http_method", "host", "user_agent")] + [(c, _LAST(c)) for c in ("line", "classification")]
_MERGED += [("http_path", "CASE WHEN nullif(n.http_path, '') IS NULL THEN p.http_path WHEN p.http_path IS NULL OR contains(p.http_path, '<NUM>') AND NOT contains(n.http_path, '<NUM>') THEN n.http_path ELSE p.http_path END"), ("response_bytes", "coalesce(nullif(p.response_bytes, 0), nullif(n.response_bytes, 0))")]
_NAMES = [c for c, _ in _MERGED]
_ENDED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at, kind, event_id) AS i FROM x),
r AS (
  SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS opened, NULL::DOUBLE AS closes, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, 0::BIGINT AS events, -1e18::DOUBLE AS silent, -1e18::DOUBLE AS seen, NULL::VARCHAR AS seen_outcome, NULL::VARCHAR AS seen_reason, {", ".join(f"NULL::{'BIGINT' if c == 'response_bytes' else 'VARCHAR'} AS {c}" for c in _NAMES)},
    NULL::STRUCT(event_id BIGINT, opened DOUBLE, closed DOUBLE, outcome VARCHAR, reason VARCHAR, events BIGINT, {", ".join(f"{c} {'BIGINT' if c == 'response_bytes' else 'VARCHAR'}" for c in _NAMES)}) AS done FROM (SELECT DISTINCT key FROM x)
  UNION ALL
  SELECT n.key, n.i, CASE WHEN opens THEN n.event_id WHEN open_ THEN p.event_id END, CASE WHEN opens THEN n.at WHEN open_ THEN p.opened END,
    CASE WHEN opens THEN CASE WHEN n.at - seen_ <= 10 THEN n.at + 0.5 ELSE n.at + 10 END WHEN looks THEN look WHEN open_ THEN p.closes END,
    CASE WHEN opens THEN CASE WHEN n.at - seen_ <= 10 THEN p.seen_outcome ELSE 'timeout' END WHEN looks THEN n.outcome WHEN open_ THEN p.outcome END, CASE WHEN opens THEN CASE WHEN n.at - seen_ <= 10 THEN p.seen_reason ELSE '' END WHEN looks THEN n.reason WHEN open_ THEN p.reason END,
    CASE WHEN opens THEN 1 WHEN open_ AND n.kind = 'alert' THEN p.events + 1 WHEN open_ THEN p.events ELSE 0 END, silent_, CASE WHEN opens THEN -1e18 WHEN NOT open_ AND n.kind = 'evidence' AND n.outcome <> '' THEN n.at ELSE seen_ END,
    CASE WHEN NOT open_ AND n.kind = 'evidence' AND n.outcome <> '' THEN n.outcome ELSE p.seen_outcome END, CASE WHEN NOT open_ AND n.kind = 'evidence' AND n.outcome <> '' THEN n.reason ELSE p.seen_reason END,
    {", ".join(f"CASE WHEN opens THEN {v.replace('p.' + c, 'NULL')} WHEN open_ AND n.kind = 'alert' THEN {v} WHEN open_ THEN p.{c} END" for c, v in _MERGED)},
    CASE WHEN ended THEN {{'event_id': p.event_id, 'opened': p.opened, 'closed': p.closes, 'outcome': p.outcome, 'reason': p.reason, 'events': p.events, {", ".join(f"'{c}': p.{c}" for c in _NAMES)}}} END
  FROM (SELECT r.*, s.i AS next_ FROM r JOIN s ON s.key = r.key AND s.i = r.i + 1) p JOIN s n ON n.key = p.key AND n.i = p.next_,
    LATERAL (SELECT coalesce(p.closes <= n.at, false) AS ended) e, LATERAL (SELECT p.opened IS NOT NULL AND NOT ended AS open_, CASE WHEN ended THEN p.closes + CASE WHEN p.outcome = 'downgraded' THEN 30 ELSE 300 END ELSE p.silent END AS silent_, CASE WHEN ended THEN -1e18 ELSE p.seen END AS seen_) f,
    LATERAL (SELECT NOT open_ AND n.kind = 'alert' AND n.at > silent_ AS opens, p.opened + greatest(0.5, CASE WHEN n.at - p.opened <= 5 THEN ceil((n.at - p.opened) / 0.5) * 0.5 ELSE ceil(n.at - p.opened) END) AS look) g, LATERAL (SELECT open_ AND n.kind = 'evidence' AND n.outcome <> '' AND p.outcome = 'timeout' AND look < p.opened + 10 AS looks) h),
z AS (SELECT key, unnest(done) FROM r WHERE done IS NOT NULL UNION ALL SELECT key, event_id, opened, closes, outcome, reason, events, {", ".join(_NAMES)} FROM r WHERE opened IS NOT NULL AND (key, i) IN (SELECT (key, max(i)) FROM s GROUP BY key))
SELECT * FROM z"""
_STATES = """v AS (SELECT *, split_part(path, '?', 1) AS p FROM x WHERE kind = 'seen'), fi AS (SELECT key, p, min(at) AS first_ FROM v GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_) AS rank FROM fi),
t AS (SELECT v.*, sum(CASE WHEN rank > 10 OR v.at = first_ THEN 1 ELSE 0 END) OVER (PARTITION BY v.key ORDER BY v.at)::BIGINT AS paths FROM v JOIN rk USING (key, p)),
pe AS (SELECT key, min(at) AS pended FROM t WHERE paths >= 5 AND method IN ('GET', 'HEAD') GROUP BY 1), ve AS (SELECT pe.key, pended, min(x.at) AS settled, arg_min(outcome, x.at) AS outcome, arg_min(reason, x.at) AS reason FROM pe JOIN x ON x.key = pe.key AND x.kind = 'verdict' AND x.at > pended GROUP BY 1, 2),
u AS (SELECT t.event_id, t.key, t.at, CASE WHEN t.at > settled THEN ve.outcome WHEN t.at >= pe.pended THEN 'pending' ELSE 'candidate' END AS state, t.paths, coalesce(t.at > settled AND ve.outcome = 'verified', false) AS caught, CASE WHEN t.at > settled AND ve.outcome = 'verified' THEN ve.reason ELSE '' END AS reason FROM t LEFT JOIN pe USING (key) LEFT JOIN ve USING (key))"""
_PINS = """p AS (SELECT * FROM x WHERE kind = 'pin'), q AS (SELECT * FROM x WHERE kind = 'response'),
c AS (SELECT p.key, p.event_id, p.at, q.event_id AS response, q.at AS r_at FROM p JOIN q ON q.key = p.key AND abs(q.at - p.at) <= 5 AND p.status IN (0, q.status)),
early AS (SELECT key, event_id, at, arg_min(response, (at - r_at, -response)) AS response FROM c WHERE r_at < at GROUP BY ALL), wait AS (SELECT * FROM p WHERE event_id NOT IN (SELECT event_id FROM early)),
o AS (SELECT key, response, r_at, event_id, at, row_number() OVER (PARTITION BY key ORDER BY r_at, response) AS n FROM c WHERE r_at > at AND event_id IN (SELECT event_id FROM wait)),
s AS (SELECT DISTINCT key, response, r_at, dense_rank() OVER (PARTITION BY key ORDER BY r_at, response) AS i FROM o),
r AS (SELECT key, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS pin, NULL::BIGINT AS response, NULL::DOUBLE AS r_at FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT b.key, b.i, CASE WHEN b.pin IS NULL THEN b.used ELSE list_append(b.used, b.pin) END, b.pin, b.response, b.r_at FROM (SELECT r.key, s.i, r.used, s.response, s.r_at, (SELECT arg_min(o.event_id, (o.at, o.event_id)) FROM o WHERE o.key = s.key AND o.response = s.response AND NOT list_contains(r.used, o.event_id)) AS pin FROM r JOIN s ON s.key = r.key AND s.i = r.i + 1) b),
a AS (SELECT pin, response, r_at FROM r WHERE pin IS NOT NULL)
SELECT key, event_id, at, response, 0.0::DOUBLE AS waited FROM early UNION ALL SELECT w.key, w.event_id, w.at, a.response, coalesce(a.r_at - w.at, 120.0)::DOUBLE FROM wait w LEFT JOIN a ON a.pin = w.event_id"""

SQL = {
    "ended_investigations": _with(_HUDDLES, _ENDED),
    "catch_all_sights": _with(_SIGHTS, f"{_STATES} SELECT event_id, key, state, paths, caught, reason FROM u"),
    "catch_all_states": _with(_SIGHTS, f"{_STATES} SELECT state, count(*) AS pages, sum(caught)::BIGINT AS caught FROM (SELECT key, arg_max(state, at) AS state, count(*) FILTER (caught) AS caught FROM u GROUP BY key) GROUP BY state"),
    "catch_all_rules": _with(_SIGHTS, f"""{_STATES}, w AS (SELECT key, arg_max(state, at) AS state, max(paths) AS paths, max(reason) AS reason FROM u GROUP BY key)
SELECT split_part(key, '|', 1) AS host, split_part(key, '|', 2) AS http_method, split_part(key, '|', 3)::INT AS http_status, split_part(key, '|', 4) AS body_preview_hash, state AS verdict, reason, 0::BIGINT AS response_bytes, paths FROM w WHERE state IN ('verified', 'rejected')"""),
    "pinned_lookups": _with(_PINNED, _PINS),
}
