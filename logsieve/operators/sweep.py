"""The best response of each alert by a sorted sweep: no pair of an alert and a response is ever written out.

Alerts and responses are listed under pages: a request's method and path, or, for responses seen without their
request, the class of their length. Pages are cut into bins of the window's length (a response is listed in its own
and both neighbouring bins), which spreads a hot page over time, and rows are dealt by (bin, page) and sorted. A task
goes through its rows some pages at a time. In each, responses are ordered by time for every combination of known
status and host that an alert may ask for. Rivals are then counted as a difference of two places, whether they are
copies of one body by a running count of changes, and the best is sought outwards from the alert's time until the
next response is farther away than the best one found. Memory is linear in the rows of some pages of one bin, and so
is time, but where most lengths on a page do not fit an alert's.

Rules are those of ``evidence.candidates`` and ``evidence.best``; times are compared in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.evidence import PENALTY, _class, _filled
from logsieve.sources.tables import release

#: Rows that a task gathers, in whole pages, before it goes through them.
ROWS = 50_000
#: Pairs of an alert and a length of responses without a request that are looked up at a time.
LOOKUPS = 200_000
_ROWS = "_bin long, _page string, asks boolean, id long, t long, host string, agent string, status int, length long, body long"
_FOUND = "event_id long, far long, other boolean, late long, candidates long, least_body long, most_body long"
_FAR = np.iinfo(np.int64).max


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the number of the range, and each of its values."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class _View:
    """Responses by group (a code), time and number; those alike in group, time, body and agent are one entry."""

    def __init__(self, code, t, seq, body, agent, length):
        order = np.lexsort((seq, agent, body, t, code))
        code, t, seq, body, agent, length = (c[order] for c in (code, t, seq, body, agent, length))
        new = np.ones(len(code), bool)
        if len(code):
            new[1:] = (code[1:] != code[:-1]) | (t[1:] != t[:-1]) | (body[1:] != body[:-1]) | (agent[1:] != agent[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(code)) - 1  # of an entry the largest number counts
        self.code, self.t, self.body, self.agent, self.length, self.seq = code[first], t[first], body[first], agent[first], length[first], seq[last]
        self.before = np.append(first, len(code))
        changed = np.zeros(len(first), np.int64)
        changed[1:] = (self.body[1:] != self.body[:-1]) | (self.code[1:] != self.code[:-1])
        self.changes = np.cumsum(changed)
        self.groups, self.starts = np.unique(self.code, return_index=True)
        self.ends = np.append(self.starts[1:], len(first))
        # one ascending number for (group, time)
        self.zero, self.span = (int(self.t.min()), int(self.t.max()) - int(self.t.min()) + 2) if len(first) else (0, 2)
        self.at = np.repeat(np.arange(len(self.groups)), self.ends - self.starts) * self.span + (self.t - self.zero)

    def place(self, group: np.ndarray, t: np.ndarray, side: str) -> np.ndarray:
        """Of each time the place in its group."""
        return np.searchsorted(self.at, group * self.span + np.clip(t - self.zero, -1 if side == "right" else 0, self.span - 1), side)


def _best(view: _View, group, t, agent, penal, size, window):
    """For lookups (group, time, agent, whether a length that does not fit counts against it, length): far, other, late, candidates, body, mixed. far is in microseconds, with the penalty."""
    lo, hi = view.place(group, t - window, "left"), view.place(group, t + window, "right")
    lo, hi = np.maximum(lo, view.starts[group]), np.minimum(hi, view.ends[group])
    n = view.before[np.maximum(hi, lo)] - view.before[lo]
    some = n > 0
    body = np.where(some, view.body[np.minimum(lo, len(view.body) - 1)], 0)
    mixed = np.zeros(len(lo), bool)
    mixed[some] = view.changes[hi[some] - 1] != view.changes[lo[some]]
    far, other, late = np.full(len(lo), _FAR), np.ones(len(lo), bool), np.zeros(len(lo), np.int64)
    r = view.place(group, t, "left")
    r = np.clip(r, lo, np.maximum(hi, lo))
    left, right = r - 1, r.copy()
    slack = np.maximum(size // 5, 2048)
    live = np.flatnonzero(some)
    penalty = int(PENALTY * 1_000_000)
    while len(live):
        a, b = left[live], right[live]
        before = np.where(a >= lo[live], t[live] - view.t[np.maximum(a, 0)], _FAR)
        after = np.where(b < hi[live], view.t[np.minimum(b, len(view.t) - 1)] - t[live], _FAR)
        gap = np.minimum(before, after)
        go = (gap < _FAR) & (gap <= far[live])
        live, a, b, before, after, gap = (x[go] for x in (live, a, b, before, after, gap))
        back = before <= after
        k = np.where(back, a, b)
        off = penal[live] & (size[live] > 0) & (view.length[k] > 0) & (np.abs(size[live] - view.length[k]) > slack[live])
        score, differs, newer = gap + off * penalty, ~((agent[live] >= 0) & (agent[live] == view.agent[k])), -view.seq[k]
        f, o, q = far[live], other[live], late[live]
        better = (score < f) | ((score == f) & ((differs < o) | ((differs == o) & (newer < q))))
        at = live[better]
        far[at], other[at], late[at] = score[better], differs[better], newer[better]
        left[live] -= back
        right[live] += ~back
    return far, other, late, n, body, mixed


def _swept(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """What _FOUND says of the alerts among some whole pages' rows."""
    asks = rows["asks"].to_numpy(bool)
    page = rows["_page"].to_numpy(object)
    new = np.ones(len(rows), bool)
    new[1:] = (page[1:] != page[:-1]) | (np.diff(rows["_bin"].to_numpy()) != 0)
    gid = np.cumsum(new) - 1
    names = page[new]
    penal = np.array([p[0] == "R" for p in names])
    by_length = np.array([p[0] == "L" and p not in ("L-1", "Lany") for p in names])
    host, hosts = pd.factorize(np.append(rows["host"].to_numpy(object), ""))
    blank = host[-1]
    host = host[:-1]
    agent = pd.factorize(rows["agent"].to_numpy(object))[0]
    agent[rows["agent"].to_numpy(object) == ""] = -1
    status, length, t, ids, body = (rows[c].to_numpy(np.int64) for c in ("status", "length", "t", "id", "body"))
    lengths = np.unique(np.append(length[~asks], 0))
    states = pd.factorize(status)[0]
    n_state, n_host, n_length = states.max(initial=0) + 2, len(hosts) + 1, len(lengths) + 1

    def code(g, s, h, k):
        return ((g * n_state + s) * n_host + h) * n_length + k

    out = []
    resp, mine = np.flatnonzero(~asks), np.flatnonzero(asks)
    rank = np.where(by_length[gid], np.searchsorted(lengths, length), 0)
    for with_status in (True, False):
        for with_host in (True, False):
            those = mine[((status[mine] > 0) == with_status) & ((host[mine] != blank) == with_host)]
            if not len(those) or not len(resp):
                continue
            s, h = states + 1 if with_status else np.zeros_like(states), host + 1 if with_host else np.zeros_like(host)
            view = _View(code(gid[resp], s[resp], h[resp], rank[resp]), t[resp], ids[resp], body[resp], agent[resp], length[resp])
            asked = np.concatenate([np.stack([those, h[those]]), np.stack([those, np.full(len(those), blank + 1)])], axis=1) if with_host else np.stack([those, h[those]])
            for c in range(0, asked.shape[1], ROWS):
                i, wanted = asked[:, c : c + ROWS]
                slack = np.maximum(length[i] // 10, 256)
                narrow = by_length[gid[i]]
                first = np.where(narrow, np.searchsorted(lengths, length[i] - slack), 0)
                last = np.where(narrow, np.searchsorted(lengths, length[i] + slack, "right"), 1)
                base = code(gid[i], s[i], wanted, 0)
                lo, hi = np.searchsorted(view.groups, base + first), np.searchsorted(view.groups, base + last)
                ends = np.cumsum(np.maximum(hi - lo, 0))
                cuts = np.searchsorted(ends, np.arange(LOOKUPS, (ends[-1] if len(ends) else 0) + LOOKUPS, LOOKUPS), "left")
                begin = 0
                for end in (cuts + 1).tolist():
                    of, group = _ranges(lo[begin:end], hi[begin:end])
                    k = i[begin:end][of]
                    begin = end
                    if len(k):
                        found = _best(view, group, t[k], agent[k], penal[gid[k]], length[k], window)
                        keep = found[3] > 0
                        out.append(pd.DataFrame(dict(zip(("far", "other", "late", "candidates", "body", "mixed"), (f[keep] for f in found), strict=True)) | {"event_id": ids[k[keep]]}))
    if not out:
        return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in _FOUND.split(", ")})
    all_ = pd.concat(out, ignore_index=True)
    order = np.lexsort((all_["late"], all_["other"], all_["far"], all_["event_id"]))
    all_ = all_.iloc[order].reset_index(drop=True)
    by = all_.groupby("event_id", sort=False)
    best = by.first()
    mixed = by["mixed"].any().to_numpy()
    best["candidates"] = by["candidates"].sum()
    best["least_body"], best["most_body"] = by["body"].min().to_numpy(), by["body"].max().to_numpy()
    # several bodies among one lookup's rivals: no two of the ends agree
    best["least_body"], best["most_body"] = np.where(mixed, np.iinfo(np.int64).min, best["least_body"]), np.where(mixed, _FAR, best["most_body"])
    return best.reset_index()[["event_id", "far", "other", "late", "candidates", "least_body", "most_body"]]


def _pages(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        try:
            for pdf in batches:
                held.append(pdf)
                if sum(map(len, held)) >= ROWS:
                    rows = pd.concat(held, ignore_index=True)
                    last = (rows["_bin"] == rows["_bin"].iat[-1]) & (rows["_page"] == rows["_page"].iat[-1])
                    # a copy, as a part of the frame would keep all of it
                    held = [rows[last].copy()]
                    if not last.all():
                        yield _swept(rows[~last], window)
                    del rows
            if held and len(rows := pd.concat(held, ignore_index=True)):
                yield _swept(rows, window)
        finally:
            held.clear()
            release()

    return run


def best(alerts: DataFrame, responses: DataFrame, window: int, keep: list[str] | None = None) -> DataFrame:
    """The best response of each of ``alerts`` that has any: event_id, resp_seq, score, content_length, body_hash, what ``keep`` names, candidates and confidence, as ``evidence.best`` over ``evidence.candidates``.

    event_id and resp_seq are long numbers, and resp_seq names one response.
    """
    alerts, responses = _filled(alerts, ["host", "user_agent"]), _filled(responses, ["resp_host", "resp_agent", "content_type"])
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    long_bin = lambda c: F.floor(F.unix_micros(c) / (window * 1_000_000))
    request = lambda m, p: F.concat(F.lit("R"), m, F.lit(" "), p)
    kind = F.when(F.col("content_length") > 0, _class(F.col("content_length"))).otherwise(-1)
    asked = F.coalesce("resp_method", F.lit("")) != ""
    pages = F.when(asked, F.array(request(F.col("resp_method"), F.col("resp_path")))).otherwise(F.array(F.concat(F.lit("L"), kind), F.lit("Lany")))
    there = responses.where("resp_ts IS NOT NULL").select(
        F.explode(F.array(*[long_bin("resp_ts") + i for i in (-1, 0, 1)])).alias("_bin"), pages.alias("_pages"), F.lit(False).alias("asks"), F.col("resp_seq").cast("long").alias("id"), F.unix_micros("resp_ts").alias("t"),
        F.col("resp_host").alias("host"), F.col("resp_agent").alias("agent"), F.coalesce("resp_status", F.lit(-1)).alias("status"), some("content_length").alias("length"), F.xxhash64(F.coalesce("body_hash", F.lit("")), some("content_length"), F.lit("|"), "content_type").alias("body"),
    )
    size = some("bytes")
    slack = F.greatest(F.floor(size / 10), F.lit(256))
    classes = F.transform(F.sequence(_class(size - slack), _class(size + slack)), lambda c: F.concat(F.lit("L"), c))
    lone = F.when(size > 0, F.concat(F.array(F.lit("L-1")), classes)).otherwise(F.array(F.lit("Lany")))
    own = F.when((F.coalesce("method", F.lit("")) != "") & F.col("path").isNotNull(), F.concat(F.array(request(F.col("method"), F.col("path"))), lone)).otherwise(lone)
    mine = alerts.where("ts IS NOT NULL").select(
        long_bin("ts").alias("_bin"), own.alias("_pages"), F.lit(True).alias("asks"), F.col("event_id").cast("long").alias("id"), F.unix_micros("ts").alias("t"), "host", F.col("user_agent").alias("agent"), F.coalesce("status", F.lit(0)).alias("status"), size.alias("length"), F.lit(0).cast("long").alias("body"),
    )
    rows = there.unionByName(mine).withColumn("_page", F.explode("_pages")).where("_page IS NOT NULL").selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in _ROWS.split(", ")])
    found = rows.repartition("_bin", "_page").sortWithinPartitions("_bin", "_page").mapInPandas(_pages(window * 1_000_000), _FOUND)
    rank = F.struct("far", "other", "late")
    one = found.groupBy("event_id").agg(F.min(rank).alias("r"), F.sum("candidates").alias("candidates"), (F.min("least_body") == F.max("most_body")).alias("_clones"))
    one = one.select("event_id", (-F.col("r.late")).alias("resp_seq"), (F.col("r.far") / 1_000_000).alias("score"), "candidates", "_clones")
    out = one.join(responses.select(*dict.fromkeys(["resp_seq", "content_length", "body_hash", *(keep or [])])), "resp_seq")
    high = (F.col("candidates") == 1) | (F.col("_clones") & (F.coalesce("body_hash", F.lit("")) != ""))
    return out.select("event_id", "resp_seq", "score", "content_length", "body_hash", *(keep or []), "candidates", F.when(high, "HIGH").otherwise("LOW").alias("confidence"))

