"""Keyed state machines, over a stream and over a bounded table: investigations that end, catch-all pages, pinned look-ups.

A machine says what one row does to a key's state, when the state is due by itself, and what then comes of it. Rows of
a key are taken in the order of time. Over a stream the state is one value of a key, due times are event-time timers
(so ends are emitted though nothing more comes of the key), and state without use goes. Over a table a key's rows are
dealt by key, sorted by time and folded as they stream by, with one key's state in a task; at its end, what is open
falls due. Both run the same machine, so they give the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsieve.streaming.limits import LATE, SHIFT, SILENCE, WINDOW

# Seconds of the first phase of an investigation, in which evidence is looked for each half second (then each second), and for which an end that evidence brought silences late events.
FIRST, SHORT_SILENCE = 5.0, 30.0
# Paths of a page that are kept, and distinct ones that make it a candidate to be verified.
KEPT_PATHS, CANDIDATE_PATHS = 10, 5
# Seconds for which a pinned look-up waits, and around its time in which a response may lie.
PIN_SECONDS, PIN_WINDOW = 120.0, 5.0


class Machine:
    """``INPUT`` and ``OUTPUT`` are schemas of rows with ``key`` and ``at`` (seconds); ORDER sorts rows of one time."""

    INPUT = OUTPUT = ""
    ORDER: list[str] = []

    def step(self, state: dict, row) -> list[dict]:
        """Changes ``state`` by a row, all that was due before it being done; what comes of it."""
        raise NotImplementedError

    def due(self, state: dict) -> float | None:
        """When something comes of the state by itself."""
        return None

    def end(self, state: dict, now: float) -> list[dict]:
        """What comes of the state at ``now``, at or after the time it is due."""
        return []

    def useless(self, state: dict) -> float | None:
        """From when on the state says no more than none would; None if it never does."""
        return None

    def rows(self, state: dict, pdf: pd.DataFrame) -> list[dict]:
        out = []
        for row in pdf.itertuples(index=False):
            while (due := self.due(state)) is not None and due <= row.at:
                out += self.end(state, due)
            out += self.step(state, row)
        return out


def _some(value) -> bool:
    return value is not None and value == value and value != ""


def _number(value, default: int | None = None) -> int | None:
    return int(value) if value is not None and value == value else default


class Investigations(Machine):
    """One merged alert for each investigation.

    An alert opens one, unless its key is silenced; further alerts of the key join it until it ends. Evidence
    (outcome, reason) ends it at the next look: each half second in the first five, then each second. Evidence that
    came up to ten seconds before is found at the first look. After ten seconds it ends as ``timeout``. For 30
    seconds after a downgrade, or 300 after another end, alerts of the key are taken for late ones and go. The
    first that is not empty counts for the request, a path without placeholders before one that has some; the last
    that is not empty for the rest.
    """

    FIELDS_FIRST = ["http_method", "host", "user_agent"]
    FIELDS_LAST = ["line", "classification"]
    INPUT = "key string, at double, kind string, event_id long, http_method string, http_path string, host string, user_agent string, response_bytes long, line string, classification string, outcome string, reason string"
    OUTPUT = "key string, event_id long, opened double, closed double, outcome string, reason string, events long, http_method string, http_path string, host string, user_agent string, response_bytes long, line string, classification string"
    ORDER = ["kind", "event_id"]

    def due(self, state):
        return state.get("closes")

    def end(self, state, now):
        row = {c.split()[0]: state.get(c.split()[0]) for c in self.OUTPUT.split(", ")} | {"closed": state["closes"]}
        silence = SHORT_SILENCE if state["outcome"] == "downgraded" else SILENCE
        state.clear()
        state["silent"] = row["closed"] + silence
        return [row]

    def useless(self, state):
        return max(state.get("silent", -math.inf), state.get("seen", -math.inf) + WINDOW) if "closes" not in state else None

    def _look(self, state, at):
        after = at - state["opened"]
        tick = math.ceil(after / 0.5) * 0.5 if after <= FIRST else math.ceil(after)
        return state["opened"] + max(tick, 0.5)

    def step(self, state, row):
        if row.kind == "evidence":
            if not _some(row.outcome):
                return []
            if "closes" not in state:
                state |= {"seen": row.at, "seen_outcome": row.outcome, "seen_reason": row.reason}
            elif state["outcome"] == "timeout" and (look := self._look(state, row.at)) < state["opened"] + WINDOW:
                state |= {"closes": look, "outcome": row.outcome, "reason": row.reason}
            return []
        if "closes" not in state:
            if row.at <= state.get("silent", -math.inf):
                return []
            seen = state if row.at - state.get("seen", -math.inf) <= WINDOW else {}
            new = {"key": row.key, "event_id": _number(row.event_id), "opened": row.at, "closes": row.at + WINDOW, "outcome": "timeout", "reason": "", "events": 0}
            if seen:
                new |= {"closes": row.at + 0.5, "outcome": seen["seen_outcome"], "reason": seen["seen_reason"]}
            state.clear()
            state |= new
        state["events"] += 1
        for c in self.FIELDS_FIRST:
            if _some(value := getattr(row, c)) and not state.get(c):
                state[c] = value
        for c in self.FIELDS_LAST:
            if _some(value := getattr(row, c)):
                state[c] = value
        if _some(row.http_path) and (not state.get("http_path") or ("<NUM>" in state["http_path"] and "<NUM>" not in row.http_path)):
            state["http_path"] = row.http_path
        if _some(row.response_bytes) and row.response_bytes > 0 and not state.get("response_bytes"):
            state["response_bytes"] = int(row.response_bytes)
        return []


class CatchAlls(Machine):
    """What each sight of a page says: its state, its distinct paths, and whether it is caught, being a verified catch-all.

    A page (key: host, method, status and body) is a candidate until ``CANDIDATE_PATHS`` of its paths were seen; then, if
    it answers GET or HEAD, it is pending, until a verdict (outcome verified or rejected, with a reason) settles it.
    Verdicts on pages that do not wait for one say nothing. Of a page's paths ``KEPT_PATHS`` are kept; any other
    counts each time. Queries are no part of a path.
    """

    INPUT = "key string, at double, kind string, event_id long, method string, path string, outcome string, reason string"
    OUTPUT = "key string, at double, event_id long, state string, paths long, caught boolean, reason string"
    ORDER = ["kind", "event_id"]

    def step(self, state, row):
        if row.kind == "verdict":
            if state.get("state") == "pending":
                state |= {"state": "verified" if row.outcome == "verified" else "rejected", "reason": row.reason if _some(row.reason) else ""}
            return []
        path = (row.path if _some(row.path) else "").split("?", 1)[0]
        if not state:
            state |= {"paths": [path], "total": 1, "state": "candidate", "reason": ""}
        else:
            if path not in state["paths"]:
                state["total"] += 1
                if len(state["paths"]) < KEPT_PATHS:
                    state["paths"].append(path)
            if state["state"] == "candidate" and row.method in ("GET", "HEAD") and state["total"] >= CANDIDATE_PATHS:
                state["state"] = "pending"
        caught = state["state"] == "verified"
        return [{"key": row.key, "at": row.at, "event_id": _number(row.event_id), "state": state["state"], "paths": state["total"], "caught": caught, "reason": state["reason"] if caught else ""}]


class Pins(Machine):
    """Pinned look-ups and the responses that answer them.

    A pin (kind ``pin``, event_id) waits for a response (kind ``response``, event_id being its number) of its key whose
    time is at most PIN_WINDOW from its own, status the same if the pin knows one. Of the responses that are already
    there it takes the nearest in time (of equal ones the latest). A response that comes answers one waiting pin, the
    oldest that fits, which is thereby used up, and is there for later pins as well. A pin that no response answers in
    PIN_SECONDS ends without one (response null).
    """

    INPUT = "key string, at double, kind string, event_id long, status int"
    OUTPUT = "key string, event_id long, at double, response long, waited double"
    ORDER = ["kind", "event_id"]

    def due(self, state):
        return min((p[0] + PIN_SECONDS for p in state.get("pins", [])), default=None)

    def end(self, state, now):
        gone = [p for p in state["pins"] if p[0] + PIN_SECONDS <= now]
        state["pins"] = [p for p in state["pins"] if p[0] + PIN_SECONDS > now]
        return [{"key": state["key"], "event_id": p[1], "at": p[0], "response": None, "waited": PIN_SECONDS} for p in gone]

    def useless(self, state):
        return max((r[0] + PIN_WINDOW for r in state.get("responses", [])), default=-math.inf) if not state.get("pins") else None

    def step(self, state, row):
        state["key"] = row.key
        pins, responses = state.setdefault("pins", []), [r for r in state.get("responses", []) if r[0] >= row.at - PIN_WINDOW]
        state["responses"] = responses
        fits = lambda pin, response: abs(pin[0] - response[0]) <= PIN_WINDOW and pin[2] in (0, response[2])
        me = [row.at, _number(row.event_id, 0), _number(row.status, 0)]
        if row.kind == "pin":
            found = min((r for r in responses if fits(me, r)), key=lambda r: (abs(r[0] - row.at), -r[1]), default=None)
            if found is None:
                pins.append(me)
                return []
            return [{"key": row.key, "event_id": me[1], "at": row.at, "response": found[1], "waited": 0.0}]
        responses.append(me)
        found = next((p for p in pins if fits(p, me)), None)
        if found is None:
            return []
        pins.remove(found)
        return [{"key": row.key, "event_id": found[1], "at": found[0], "response": me[1], "waited": row.at - found[0]}]


def _frame(machine: Machine, rows: list[dict]) -> pd.DataFrame:
    kinds = {"string": object, "long": "Int64", "int": "Int32", "double": float, "boolean": bool}
    names = [c.split() for c in machine.OUTPUT.split(", ")]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=kinds[k]) for n, k in names})


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", "json string")

    def _kept(self, state: dict) -> None:
        self.value.update((json.dumps(state),))
        wake = [t for t in (self.machine.due(state), self.machine.useless(state)) if t is not None and t > -math.inf]
        if wake:
            self.handle.registerTimer(int((min(wake) + SHIFT) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.value.get()[0]) if self.value.exists() else {}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", *self.machine.ORDER])
        out = self.machine.rows(state, pdf)
        self._kept(state)
        if out:
            yield _frame(self.machine, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.value.exists():
            return
        state, now = json.loads(self.value.get()[0]), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000 - SHIFT
        out = []
        while (due := self.machine.due(state)) is not None and due <= now:
            out += self.machine.end(state, due)
        useless = self.machine.useless(state)
        if useless is not None and useless <= now:
            self.value.clear()
        elif out:
            self._kept(state)
        if out:
            yield _frame(self.machine, out)

    def close(self) -> None:
        pass


def streamed(events: DataFrame, machine: Machine, late: str = LATE) -> DataFrame:
    """What ``machine`` makes of a stream of its rows; rows of a key arrive in the order of time, up to ``late``."""
    timed = events.withColumn("_ts", F.timestamp_seconds(F.col("at") + SHIFT)).withWatermark("_ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Processor(machine), machine.OUTPUT, outputMode="Append", timeMode="EventTime")


def folded(events: DataFrame, machine: Machine) -> DataFrame:
    """What ``machine`` makes of a table of its rows, however long a key's history is."""
    columns = [c.split()[0] for c in machine.INPUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for pdf in batches:
            out = []
            for key, rows in pdf.groupby("key", sort=False, dropna=False):
                if key != last:
                    out += finished(state)
                    last, state = key, {}
                out += machine.rows(state, rows)
            yield _frame(machine, out)
        yield _frame(machine, finished(state))

    def finished(state: dict) -> list[dict]:
        out = []
        while (due := machine.due(state)) is not None:
            out += machine.end(state, due)
        return out

    rows = events.select(*columns).where("key IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at", *machine.ORDER).mapInPandas(run, machine.OUTPUT)


def catch_all_states(seen: DataFrame) -> DataFrame:
    """Pages by state, of what ``CatchAlls`` made: state, pages, caught."""
    last = seen.groupBy("key").agg(F.max_by("state", F.struct("at", "event_id")).alias("state"), F.count_if("caught").alias("caught"))
    return last.groupBy("state").agg(F.count("*").alias("pages"), F.sum("caught").alias("caught"))
