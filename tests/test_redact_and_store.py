import json

from pyspark.sql import functions as F

from logsieve.functions import redact
from logsieve.operators import classify, patterns, store


def test_json_previews(spark):
    body = json.dumps({"user": "ann", "api_token": "t", "mail": "a@b.c", "n": 3, "blob": "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==", "long": "x " * 40, "list": [{"session": "s"}]})
    r = spark.createDataFrame([(body,), ("{oops",), (None,)], "b string").select(redact.redact_json("b").alias("r")).collect()
    out = json.loads(r[0].r.preview)
    assert out["user"] == "ann" and out["n"] == 3 and out["api_token"] == "[REDACTED]" and out["mail"] == "[REDACTED:email]"
    assert out["blob"] == "[REDACTED:encoded]" and out["long"] == "[REDACTED:long_string]" and out["list"] == [{"session": "[REDACTED]"}]
    assert r[0].r.redactions == 5
    assert [x.r.preview for x in r[1:]] == ["", ""]


def test_scripts_go(spark):
    df = spark.createDataFrame([("<p>a</p><SCRIPT src=x>var s</script ><style>b</style>c",)], "h string")
    assert df.select(redact.without_scripts(F.col("h")).alias("x")).first().x == "<p>a</p>c"


def test_pattern_precedence(spark):
    rows = [
        ("s:a", "suppress", "hash", "h1", "llm", "", False, 1), ("s:a", "alert", "contains", "bad", "llm", "", False, 2),
        (patterns.GLOBAL, "malicious", "contains", "worse", "seed", "", False, 3), ("s:a", "alert", "prefix", "go", "llm", "", False, 4), ("s:b", "allow", "prefix", "go", "llm", "", True, 5),
    ]
    ev = spark.createDataFrame([(1, "s:a", "h1", "bad and worse"), (2, "s:a", "h1", "go bad"), (3, "s:a", "h1", "x"), (4, "s:b", "h1", "go")], "event_id long, scope string, hash string, normalized string")
    got = {r.event_id: r.match and (r.match.bucket, r.match.tier) for r in patterns.match(ev, patterns.patterns(spark, rows)).collect()}
    assert got == {1: ("malicious", "contains"), 2: ("alert", "prefix"), 3: ("suppress", "hash"), 4: None}


def test_learning_skips_what_is_known_and_keeps_caps(spark, monkeypatch):
    monkeypatch.setitem(patterns.CAPS, "hash", 2)
    known = patterns.patterns(spark, [("s", "allow", "hash", "a", "llm", "", False, 1)])
    new = patterns.patterns(spark, [("s", "allow", "hash", v, src, "", False, i) for i, (v, src) in enumerate([("a", "llm"), ("b", "llm"), ("c", "llm"), ("d", "human")])])
    assert sorted(r.value for r in patterns.learn(known, new).collect()) == ["a", "b", "d"]


def test_disclosure_is_never_suppressed_and_one_answer_serves_a_group(spark):
    line = 'x root:x:0:0:root "GET /missing HTTP/1.1" 404 5'
    ev = spark.createDataFrame([(1, "docker", "app", "", line, None), (2, "docker", "app", "", "hello", None), (3, "docker", "app", "", "hello", None)], "event_id long, source_type string, source_name string, unit string, line string, ts timestamp")
    calls = []
    out = classify.with_classifier(classify.deterministic(ev, patterns.patterns(spark, [("docker:app", "suppress", "contains", "root:x", "llm", "", False, 1)])), lambda g: calls.append(g.count()) or classify.by_rules(g))
    got = {r.event_id: (r.verdict, r.via, r.leads) for r in out.collect()}
    assert calls == [2] and got[1][0] == "alert" and got[2] == ("allow", "llm", True) and got[3] == ("allow", "llm", False)


def test_a_resolved_finding_stays_whoever_resolves_it_again(spark):
    f = spark.createDataFrame([(1, "a", "alert", "resolved", "evidence"), (2, "b", "alert", None, None)], "id long, event_id string, verdict string, resolution_status string, resolution_method string")
    change = lambda m: spark.createDataFrame([("a", "resolved", m, "recon"), ("b", "resolved", m, "")], "event_id string, new_status string, new_method string, new_verdict string")
    rows = lambda m: [(r.verdict, r.resolution_method) for r in store.resolve(f, change(m)).orderBy("id").collect()]
    assert rows("rec_evidence") == [("alert", "evidence"), ("alert", "rec_evidence")]
    assert rows("human_review") == [("alert", "evidence"), ("alert", "human_review")]
