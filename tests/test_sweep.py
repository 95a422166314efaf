"""The sweep gives what the pairs give, and its work on a hot page grows with the rows."""

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logsieve.operators import evidence, sweep

ALERT = "event_id long, at double, method string, path string, host string, user_agent string, status int, bytes long"
RESPONSE = "resp_seq long, rat double, resp_method string, resp_path string, resp_host string, resp_agent string, resp_status int, content_length long, content_type string, body_hash string"


def tables(spark, alerts, responses):
    a = spark.createDataFrame(alerts, ALERT).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    return a, spark.createDataFrame(responses, RESPONSE).withColumn("resp_ts", F.timestamp_seconds("rat")).drop("rat")


def same(spark, alerts, responses, window=5):
    a, r = tables(spark, alerts, responses)
    got = {tuple(x) for x in sweep.best(a, r, window, ["content_type"]).collect()}
    want = {tuple(x) for x in evidence.best(evidence.candidates(a, r, window), ["content_type"]).collect()}
    assert sorted(map(repr, got - want)) == sorted(map(repr, want - got))
    return got


def test_random_rows_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(sweep, "ROWS", 300)
    for seed in (1, 2):
        r = random.Random(seed)
        size = lambda: r.choice([0, None, 36, 300, 500, 510, 900, 2400, 5000, 9000, 9400, 60_000, r.randint(1, 20_000)])
        host = lambda: r.choice(["", None, "h1", "h2"])
        when = lambda: r.randint(0, 480) / 8
        alerts = [(i, when(), r.choice(["GET", "GET", "POST", "", None]), r.choice(["/a", "/b", "", None]), host(), r.choice(["u", "v", "", None]), r.choice([0, None, 200, 200, 404]), size()) for i in range(500)]
        responses = [(i, when(), *r.choice([("GET", "/a"), ("GET", "/b"), ("POST", "/a"), ("", ""), (None, None), ("", "")]), host(), r.choice(["u", "v", "", None]), r.choice([None, 200, 200, 404]), size(), r.choice(["t", None]), r.choice(["x", "x", "y", "", None])) for i in range(1200)]
        found = same(spark, alerts, responses)
        assert len(found) > 300 and {x[-1] for x in found} == {"HIGH", "LOW"}


def test_ties_clones_and_nothing(spark):
    base = ("GET", "/a", "h", "u", 200, 500)
    alerts = [(1, 10.0, *base), (2, 50.0, *base), (3, 90.0, *base), (4, None, *base)]
    response = lambda seq, at, agent="", size=500, body="b": (seq, at, "GET", "/a", "h", agent, 200, size, "t", body)
    responses = [response(i, 10.0 + i % 3 - 1) for i in range(30)] + [response(40, 51.0), response(41, 49.0, "u"), response(42, 50.0, "u", 9000), response(43, None)]
    found = {x[0]: x for x in same(spark, alerts, responses)}
    assert found[1][1] == 28 and found[1][-1] == "HIGH" and found[2][1] == 41 and set(found) == {1, 2}
    assert not same(spark, alerts, []) and not same(spark, [], responses)


def hot(n, lone):
    r = np.random.default_rng(1)
    rows = {"_bin": 0, "_page": "L7" if lone else "RGET /", "asks": np.arange(2 * n) % 2 == 0, "id": np.arange(2 * n), "t": r.integers(0, 10**7, 2 * n), "host": "h", "agent": r.choice(["u", "v", ""], 2 * n), "status": 200, "length": 500, "body": r.integers(0, 3, 2 * n)}
    return pd.DataFrame(rows)


def test_a_hot_page_costs_in_proportion_to_its_rows():
    for lone in (False, True):
        took = []
        for n in (10_000, 100_000):
            began = time.process_time()
            out = sweep._swept(hot(n, lone), 10**7)
            took.append(time.process_time() - began)
            assert len(out) == n and (out["candidates"] == n).all()
        assert took[1] < 40 * took[0] + 2
