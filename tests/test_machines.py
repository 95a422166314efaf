"""State machines over a stream and over a table give the same rows, and do what their rules say."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsieve.streaming import keyed
from test_streaming import rocks, run  # noqa: F401


def told(machine, *rows):
    """What a machine makes of rows of one key, the end included."""
    names = [c.split()[0] for c in machine.INPUT.split(", ")]
    pdf = pd.DataFrame([{n: None for n in names} | {"key": "k", "event_id": i} | r for i, r in enumerate(rows)], columns=names).sort_values(["at", *machine.ORDER])
    state, out = {}, []
    out = machine.rows(state, pdf)
    while (due := machine.due(state)) is not None:
        out += machine.end(state, due)
    return out


def alert(at, **kw):
    return {"at": float(at), "kind": "alert"} | kw


def evidence(at, outcome="downgraded", reason="r"):
    return {"at": float(at), "kind": "evidence", "outcome": outcome, "reason": reason}


def test_investigations_end_by_evidence_or_by_time():
    ends = lambda *rows: [(r["opened"], r["closed"], r["outcome"], r["events"]) for r in told(keyed.Investigations(), *rows)]
    assert ends(alert(0), alert(3), alert(9.9), alert(10)) == [(0, 10, "timeout", 3)]
    assert ends(alert(0), evidence(1.2), alert(1.4), alert(1.6)) == [(0, 1.5, "downgraded", 2)]
    assert ends(alert(0), evidence(6.2)) == [(0, 7, "downgraded", 1)] and ends(alert(0), evidence(9.5)) == [(0, 10, "timeout", 1)]
    assert ends(evidence(-9), alert(0)) == [(0, 0.5, "downgraded", 1)] and ends(evidence(-11), alert(0)) == [(0, 10, "timeout", 1)]
    # 30 seconds of silence after a downgrade, 300 after another end
    assert ends(alert(0), evidence(0), alert(30.5), alert(31)) == [(0, 0.5, "downgraded", 1), (31, 41, "timeout", 1)]
    assert [e[0] for e in ends(alert(0), evidence(0, "escalated"), alert(31), alert(300), alert(301))] == [0, 301]
    assert ends(alert(0), evidence(1, ""), evidence(2, None)) == [(0, 10, "timeout", 1)]


def test_merged_fields():
    rows = [alert(0, http_path="/a/<NUM>", host="", line="x", response_bytes=0), alert(1, http_path="/a/1", host="h", line=None, response_bytes=7), alert(2, http_path="/b", host="i", line="z", response_bytes=9)]
    (out,) = told(keyed.Investigations(), *rows)
    assert (out["http_path"], out["host"], out["line"], out["response_bytes"], out["event_id"]) == ("/a/1", "h", "z", 7, 0)


def test_a_page_becomes_a_catch_all():
    seen = lambda i, path, method="GET": {"at": float(i), "kind": "seen", "method": method, "path": path}
    verdict = lambda i, outcome: {"at": float(i), "kind": "verdict", "outcome": outcome, "reason": "same"}
    five = [seen(i, f"/{i % 5}?x={i}") for i in range(5)]
    states = lambda *rows: [(r["state"], r["paths"], r["caught"]) for r in told(keyed.CatchAlls(), *rows)]
    assert states(verdict(-1, "verified"), *five, seen(5, "/0"), verdict(6, "verified"), seen(7, "/9"))[3:] == [("candidate", 4, False), ("pending", 5, False), ("pending", 5, False), ("verified", 6, True)]
    assert states(*five, verdict(6, "rejected"), verdict(7, "verified"), seen(8, "/1"))[-1] == ("rejected", 5, False)
    assert states(*[seen(i, f"/{i}", "POST") for i in range(9)])[-1] == ("candidate", 9, False)
    assert states(*[seen(i, f"/{min(i, 10)}") for i in range(14)])[-1][1] == 14  # the eleventh path is not kept and counts each time


def test_pins():
    row = lambda kind, at, i, status=200: {"kind": kind, "at": float(at), "event_id": i, "status": status}
    answers = lambda *rows: {r["event_id"]: (r["response"], r["waited"]) for r in told(keyed.Pins(), *rows)}
    assert answers(row("response", 0, 10), row("response", 1, 11), row("pin", 2, 1), row("pin", 3, 2, 0)) == {1: (11, 0.0), 2: (11, 0.0)}
    assert answers(row("pin", 0, 1), row("pin", 1, 2), row("response", 3, 10), row("response", 6, 11)) == {1: (10, 3.0), 2: (11, 5.0)}
    assert answers(row("pin", 0, 1, 404), row("response", 1, 10), row("response", 5.1, 11, 404)) == {1: (None, 120.0)}


def rows_for(machine, seed):
    r = random.Random(seed)
    names = [c.split() for c in machine.INPUT.split(", ")]
    values = {"string": lambda n: r.choice(["", "a", "GET", "/x<NUM>", "/y", None]), "long": lambda n: r.choice([0, 5, 9]), "int": lambda n: r.choice([0, 200, 404])}
    kinds = {"Investigations": ["alert", "alert", "alert", "evidence"], "CatchAlls": ["seen", "seen", "seen", "verdict"], "Pins": ["pin", "response"]}[type(machine).__name__]
    out = []
    for i in range(300):
        row = {n: values[k](n) for n, k in names if k in values}
        row |= {"key": r.choice("abc"), "at": i * 0.5 + r.choice([0, 0.25]), "kind": r.choice(kinds), "event_id": i, "outcome": r.choice(["downgraded", "escalated", "verified", ""]), "path": f"/{r.randrange(15)}"}
        out.append(tuple(row.get(n) for n, _ in names))
    return sorted(out, key=lambda x: x[1])


@pytest.mark.parametrize("kind", [keyed.Investigations, keyed.CatchAlls, keyed.Pins])
def test_a_stream_gives_what_the_table_gives(rocks, tmp_path, kind):  # noqa: F811
    machine = kind()
    rows = rows_for(machine, 5)
    # a last row of another key moves the watermark on, so that all that is open ends
    last = tuple({"key": "z", "at": 90_000.0, "kind": "evidence"}.get(c.split()[0]) for c in machine.INPUT.split(", "))
    batches = [rows[:100], rows[100:170], rows[170:], [last], [last]]
    got = run(rocks, tmp_path, batches, machine.INPUT, lambda s: keyed.streamed(s, machine, "1 minute"), "machine")
    table = rocks.createDataFrame(rows, machine.INPUT)
    want = keyed.folded(table, machine).collect()
    assert sorted(map(str, (x for x in got if x.key != "z"))) == sorted(map(str, want)) and want
    assert keyed.folded(table.limit(0), machine).count() == 0


def test_null_keys_and_extra_columns(spark):
    rows = spark.createDataFrame([(None, 1.0, "pin", 1, 200), ("k", None, "pin", 2, 200), ("k", 1.0, "pin", 3, None)], keyed.Pins.INPUT).withColumn("state", F.lit("x"))
    assert [(r.event_id, r.response) for r in keyed.folded(rows, keyed.Pins()).collect()] == [(3, None)]
