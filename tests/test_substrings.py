"""Very many patterns meet lines by the texts that they must hold; no line is tried against all patterns of its scope."""

import random

import pytest
from pyspark.sql import functions as F
from test_patterns import events, store

from logsieve.operators import patterns as p
from logsieve.operators import substrings


@pytest.mark.parametrize("piece", [1, 100, 1 << 18])
def test_no_known_text_is_missed(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "SLICE", piece)
    r = random.Random(piece)
    text = lambda k: "".join(r.choices("ab é$", k=k))
    keys = sorted({(r.random() < 0.5, text(r.choice([1, 2, 3, 5, 8, 13, 17, 40]))) for _ in range(200)})
    lines = ["", *[text(r.choice([0, 0, 1, 5, 30, 200])) for _ in range(100)], *[f"x{k}y{k}" for _, k in keys[::5]], text(5000), ""]
    known = spark.createDataFrame(keys, "start boolean, key string").withColumn("key", F.col("key").cast("binary"))
    rows = spark.createDataFrame([(i, f"s{i % 3}", x) for i, x in enumerate(lines)], "_id long, scope string, text string").withColumn("text", F.col("text").cast("binary"))
    got = [(x._id, x.scope, x.start, bytes(x.key)) for x in substrings.found(rows, known, len(keys)).collect()]
    want = {(i, f"s{i % 3}", start, k.encode()) for i, x in enumerate(lines) for start, k in keys if (x.startswith(k) if start else k in x)}
    texts = {(start, k.encode()) for start, k in keys}
    # each once; by chance others too, but windows of the line and few
    assert len(got) == len(set(got)) and {g for g in got if g[2:] in texts} == want
    assert all(k in lines[i].encode() for i, _, _, k in got) and len(got) < 1.5 * len(want)


def test_patterns_of_large_scopes_are_not_tried_one_by_one(spark, monkeypatch):
    sizes, small = [], p.small

    def noted(df, *args):
        sizes.extend(df.agg(F.coalesce(F.max(F.size(c)), F.lit(0))).first()[0] for c in df.columns if c in ("ps", "_hs"))
        return small(df, *args)

    monkeypatch.setattr(p, "small", noted)
    monkeypatch.setattr(p, "AUTOMATA_BYTES", 1)
    known = [("s", p.BUCKETS[i % 4], "prefix" if i % 2 else "contains", f"GET /{i:04d}", "llm", "", False, i) for i in range(2000)]
    known.append(("s", "malicious", "regex", "^GET /1[0-9]+ x$", "llm", "", False, 2000))
    lines = [("s", f"GET /{i:04d} x") for i in range(0, 3000, 99)]
    out = p.match(events(spark, lines), p.patterns(spark, known)).orderBy("event_id").select("match.value").collect()
    assert sizes and max(sizes) <= p.FEW
    # malicious comes first, and in it a regex before a part
    assert [r.value for r in out] == [None if i >= 2000 else "^GET /1[0-9]+ x$" if i >= 1000 else f"GET /{i:04d}" for i in range(0, 3000, 99)]


@pytest.mark.parametrize("everywhere", [0, 100])
def test_only_lines_of_the_condition_are_looked_up(spark, monkeypatch, everywhere):
    r = random.Random(everywhere)
    rows = [x for x in store(r, 200) if x[0] != p.GLOBAL]
    rows += [(p.GLOBAL, "alert", "contains", f"{i:03d}", "llm", "", False, 1000 + i) for i in range(everywhere)]
    lines = [(r.choice(["s1", "s2", "s3", None]), r.choice([None, "", f"GET /a login {i:03d} 200"])) for i in range(200)]

    def found():
        out = p.match(events(spark, lines), p.patterns(spark, rows), F.col("event_id") % 2 == 0)
        assert set(out.columns) == {"scope", "hash", "event_id", "normalized", "match"}
        return sorted(map(str, out.select("event_id", "match.*").collect()))

    monkeypatch.setattr(p, "FEW", 10_000)
    want = found()
    monkeypatch.setattr(p, "FEW", 3)
    monkeypatch.setattr(p, "AUTOMATA_BYTES", 1)
    assert found() == want and any("alert" in x for x in want)
