"""Cases of evidence, decisions, reviews, redaction and sources, after those that the behaviour is defined by."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from logsieve.functions import answers, redact
from logsieve.functions import text as t
from logsieve.operators import evidence, investigate, networks, patterns, policy, reviews, store
from logsieve.sources import journal, schemas, tables

ALERT = "event_id long, ts timestamp, method string, path string, host string, user_agent string, status int, bytes long, verdict string, classification string, reason string"
RESPONSE = "resp_seq long, resp_ts timestamp, resp_method string, resp_path string, resp_host string, resp_agent string, resp_status int, content_length long, content_type string, body string, body_hash string, request_ts timestamp"


def alert(spark, **kw):
    row = {"event_id": 1, "at": 100.0, "method": "GET", "path": "/x", "host": "h", "user_agent": "ua", "status": 200, "bytes": 500, "verdict": "alert", "classification": "suspicious", "reason": "seen"} | kw
    return spark.createDataFrame([tuple(row.values())], ALERT.replace("ts timestamp", "at double")).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def response(spark, *rows):
    base = {"resp_seq": 1, "at": 101.0, "resp_method": "GET", "resp_path": "/x", "resp_host": "h", "resp_agent": "", "resp_status": 200, "content_length": 500, "content_type": "application/json", "body": '{"a":1}', "body_hash": "b", "asked": 100.5}
    out = spark.createDataFrame([tuple((base | r).values()) for r in rows], RESPONSE.replace("resp_ts timestamp", "at double").replace("request_ts timestamp", "asked double"))
    return out.withColumns({"resp_ts": F.timestamp_seconds("at"), "request_ts": F.timestamp_seconds("asked")}).drop("at", "asked")


def evidences(spark, cases):
    """Evidence of each case (alert's columns, responses), all in one go: a case has a time of its own, an hour from the next."""
    alerts, rows = [], []
    for i, (a, *rs) in enumerate(cases):
        alerts.append(alert(spark, **({"event_id": i, "at": 100.0 + 3600 * i} | a)))
        rows += [r | {"resp_seq": 100 * i + r.get("resp_seq", 1), "at": r.get("at", 101.0) + 3600 * i, "asked": None if r.get("asked", 1) is None else r.get("asked", 100.5) + 3600 * i} for r in rs]
    table = alerts[0]
    for x in alerts[1:]:
        table = table.unionByName(x)
    return table, response(spark, *rows)


def seen_all(spark, cases):
    return [r.evidence for r in investigate.evidence(*evidences(spark, cases)).orderBy("event_id").collect()]


def test_a_response_counts_only_within_its_filters(spark):
    got = seen_all(spark, [
        ({}, {"resp_status": 404}), ({}, {"resp_status": None}), ({}, {"resp_host": "other"}), ({}, {"resp_host": ""}), ({}, {"at": 111.0}), ({"status": 0}, {"resp_status": 404}), ({"path": "/a\\x22b"}, {"resp_path": '/a"b'}),
    ])
    assert [e.candidates for e in got] == [0, 0, 0, 1, 0, 1, 1]
    assert got[0].status == "not_available_no_match" and got[5].status_code == 404


def test_responses_without_a_request_go_by_length(spark):
    lone = {"resp_method": "", "resp_path": "", "asked": None}
    got = seen_all(spark, [
        ({"bytes": 2401}, lone | {"content_length": 36}), ({"bytes": 10_000}, lone | {"content_length": 10_990}), ({"bytes": 10_000}, lone | {"content_length": 11_001}), ({"bytes": 0}, lone), ({"status": 0}, lone | {"resp_status": 500}), ({"host": ""}, lone),
    ])
    assert [e.candidates for e in got] == [0, 1, 0, 1, 1, 1]
    assert got[1].capture_mode == "single_segment_preview_orphan" and got[4].status_code == 500


def test_classes_of_length_lose_no_pair(spark):
    sizes = [1, 100, 255, 256, 257, 300, 2559, 2560, 2561, 5000, 123_456, 10**7, 10**9]
    lengths = [sorted({max(0, s + d) for d in (-s, -s // 9, -s // 10, -s // 10 + 1, -257, -256, -255, -1, 0, 1, 255, 256, 257, s // 10, s // 10 + 1, s // 9)}) for s in sizes]
    table, rows = evidences(spark, [({"bytes": s}, *({"resp_seq": i, "resp_method": "", "resp_path": "", "content_length": n} for i, n in enumerate(mine))) for s, mine in zip(sizes, lengths, strict=True)])
    got = {(r.event_id, r.content_length) for r in evidence.candidates(table, rows, 10).collect()}
    assert got == {(i, n) for i, (s, mine) in enumerate(zip(sizes, lengths, strict=True)) for n in mine if n <= 0 or abs(s - n) <= max(s // 10, 256)}


def test_clones_and_the_choice_among_rivals(spark):
    got = seen_all(spark, [
        ({}, {}, {"resp_seq": 2, "at": 102.0}), ({}, {}, {"resp_seq": 2, "content_type": "text/html"}), ({}, {"body_hash": ""}, {"resp_seq": 2, "body_hash": ""}), ({}, {"content_length": 3000, "at": 100.0}, {"resp_seq": 2, "at": 109.0}),
        ({}, {"resp_agent": "ua", "body_hash": "mine"}, {"resp_seq": 2}), ({}, {"body_hash": "old"}, {"resp_seq": 2, "body_hash": "new"}),
    ])
    assert got[0].confidence == "high" and got[1].preview == "" and got[2].confidence == "low"
    assert got[3].content_length == 500 and got[4].body_hash == "mine" and got[5].body_hash == "new"


def judge(answer, generic=True):
    return lambda g: g.withColumns({"classification": F.lit(answer), "generic": F.lit(generic), "reason": F.lit("said")})


def decided(spark, cases, answer="recon_failed", endpoints=None, cache=None):
    e = spark.createDataFrame(endpoints or [], schemas.ENDPOINTS)
    c = spark.createDataFrame(cache or [], "body_hash string, outcome string, classification string, reason string")
    return investigate.decisions(investigate.evidence(*evidences(spark, cases)), e, c, judge(answer) if isinstance(answer, str) else answer)


def by_body(g):
    """A judge who reads its answer in the preview."""
    return g.withColumns({"classification": F.regexp_extract("preview", '"say": "([a-z_]+)"', 1), "generic": F.lit(True), "reason": F.lit("said")})


def test_the_order_of_decisions(spark):
    sha = lambda a: hashlib.sha256(f'{{\n  "a": {a}\n}}'.encode()).hexdigest()
    cases = [
        ({"method": ""}, {}), ({"status": 404}, {"resp_status": 404}), ({"status": 404}, {"resp_status": 404, "at": 104.0, "asked": 101.0, "body": '{"say":"noise"}'}), ({"status": 400}, {"resp_status": 400, "body": '{"say":"noise"}'}), ({}, {"resp_path": "/y"}),
        ({}, {"body": "words", "content_type": ""}), ({}, {"body": '{"say":"malicious"}'}), ({"classification": "malicious"}, {"body": '{"say":"suspicious"}'}), ({"classification": "", "verdict": "malicious"}, {"body": '{"say":"suspicious","n":2}'}),
        ({"path": "/x?q=1"}, {"resp_path": "/x?q=1"}), ({}, {"body": '{"a":2}'}),
    ]
    out = decided(spark, cases, by_body, [("h", "GET", "/x", 200, sha(1), None, "e", "why")], [(sha(2), "escalated", "malicious", "before")])
    assert [(r.step, r.outcome) for r in out.orderBy("event_id").collect()] == [
        ("no_request", "kept"), ("transport", "downgraded"), ("judged", "downgraded"), ("judged", "downgraded"), ("no_evidence", "kept"),
        ("no_preview", "kept"), ("judged", "escalated"), ("judged", "kept"), ("judged", "downgraded"), ("endpoint", "downgraded"), ("cached", "escalated"),
    ]


def test_one_body_is_judged_once_and_only_clean_downgrades_are_kept(spark):
    out = decided(spark, [({}, {}), ({}, {}), ({}, {"body": '{"token":"x"}'})]).orderBy("event_id")
    rows = out.collect()
    assert [r.decision_reason for r in rows] == ["said", "said (coalesced with 0)", "said"]
    assert [r.body_hash for r in investigate.cacheable(out).collect()] == [rows[0].shape]
    f = investigate.final_findings(out).orderBy("event_id").first()
    assert (f.verdict, f.previous_verdict, f.resolution_status, f.notify) == ("downgraded", "alert", "resolved", False)


FINDING = "id long, event_id string, verdict string, resolution_status string, resolution_method string, downgraded boolean, downgrade_reason string, previous_verdict string"


def test_resolutions(spark):
    rows = [(1, "a", "alert", s, "", False, "", "") for s in ("", "pending", None, "evidence_unavailable", "resolved")]
    f = spark.createDataFrame([(i, f"e{i}", *r[2:]) for i, r in enumerate(rows)], FINDING)
    change = lambda s, v="": spark.createDataFrame([(f"e{i}", s, "rec_evidence", v) for i in range(5)], "event_id string, new_status string, new_method string, new_verdict string")
    after = lambda c: [r.resolution_status for r in store.resolve(f, c).orderBy("id").collect()]
    assert after(change("evidence_unavailable")) == ["evidence_unavailable"] * 4 + ["resolved"]
    assert after(change("resolved")) == ["resolved"] * 5
    out = store.resolve(f, change("resolved", "downgraded")).orderBy("id").collect()
    assert [(r.verdict, r.downgraded, r.previous_verdict) for r in out] == [("downgraded", True, "alert")] * 4 + [("alert", False, "")]
    assert out[0].downgrade_reason == "rec_evidence resolution"


TAGS = [
    ('<input name="q" value="s3">', '<input name="q" value="[REDACTED]">'), ("<a class=x href=/y?t=1>", '<a class=x href="[REDACTED]">'), ("<IMG SRC='a b' />", '<IMG SRC="[REDACTED]" />'),
    ('<p data-session-id="1" id="2">', '<p data-session-id="[REDACTED]" id="2">'), ('<a data-src="keep" href = "go">', '<a data-src="keep" href = "[REDACTED]">'), ('<input value="cut', '<input value="[REDACTED]"'),
    ('<p title="cut', '<p title="cut'), ("</a>", "</a>"), ("<!-- key=1 -->", "<!-- key=1 -->"), ("<input disabled value=1>", '<input disabled value="[REDACTED]">'), ("<a>", "<a>"),
]


@pytest.mark.parametrize(("tag", "want"), TAGS)
def test_tags(tag, want):
    assert redact._tag(tag)[0] == want


def test_html_previews_fail_closed_and_are_capped(spark):
    html = ["<p>a</p><SCRIPT src=x>key</script>b<style>c", "<a href='x'>" * 500, "x < y", None]
    rows = [r.r for r in spark.createDataFrame([(h,) for h in html], "h string").select(redact.redact_html("h").alias("r")).collect()]
    assert rows[0].preview == "<p>a</p><script>[STRIPPED]</script>b<style>[STRIPPED]</style>" and rows[0].redactions == 0
    assert rows[1].preview.endswith("...[TRUNCATED]") and len(rows[1].preview) == 2048 + 14 and rows[1].redactions == 500
    assert rows[2].preview == "x < y" and rows[3].preview == ""


def test_disclosures(spark):
    rows = [('{"password":"x","n":5}', "application/json"), ("A_KEY=1\nB_KEY=2", ""), ("a\x00b", ""), ("words", ""), ("", ""), (None, None), ("{oops", "application/json"), ("root:x:0:0:r:/root:/bin/sh", "")]
    got = [r.disclosure for r in redact.with_disclosure(spark.createDataFrame(rows, "body string, kind string"), "body", "kind").collect()]
    assert [(d.format, d.confidence, d.redactions) for d in got] == [("json", "high", 1), ("dotenv", "high", 2), ("binary", "none", 0), ("unknown", "none", 0), ("unknown", "none", 0), ("unknown", "none", 0), ("json", "high", 0), ("passwd", "high", 3)]
    assert got[0].preview == '{\n  "n": 5,\n  "password": "[REDACTED]"\n}' and got[6].preview == "" and got[4].summary == redact.NO_BODY


def test_json_is_written_as_its_reader_expects(spark):
    body = json.dumps({"z": 1e21, "a": [1.5, 1e-7, 100, True, None, {}], "x": "<&>", "deep": {}})
    preview = spark.createDataFrame([(body,)], "b string").select(redact.redact_json("b").alias("r")).first().r.preview
    assert preview == '{\n  "a": [\n    1.5,\n    1e-7,\n    100,\n    true,\n    null,\n    {}\n  ],\n  "deep": {},\n  "x": "\\u003c\\u0026\\u003e",\n  "z": 1e+21\n}'


def test_answers(spark):
    rows = ['{"classification":"safe","action":"malicious"}', '```json\n{"classification":"malicious","pattern":"p"}\n```', '{"classification":"noise","reason":"a\\d \\- \\" \\\\"}', "no", "[1]", None, '{"classification":5}']
    got = [r.a for r in spark.createDataFrame([(r,) for r in rows], "c string").select(answers.parsed(F.col("c")).alias("a")).collect()]
    assert [(a.readable, a.action) for a in got] == [(True, "allow"), (True, "malicious"), (True, "suppress"), (False, ""), (False, ""), (False, ""), (True, "alert")]
    assert got[1].pattern == "" and got[2].reason == 'a\\d - " \\'


def test_faults_of_patterns(spark):
    rows = [
        ("regex", "^(unclosed", "human", "x"), ("regex", "^GET /(?P<a>x)", "human", ""), ("regex", "^GET /ab.*", "llm", "GET /abc"), ("regex", "^GET /ab.*", "llm", "POST"), ("prefix", "short", "human", "other"), ("prefix", "short", "llm", ""),
        ("prefix", "<TS> error <NUM>     ", "llm", "<TS> error <NUM>      x"), ("contains", "0123456789", "llm", ""), ("contains", "0123456789", "seeded", ""), ("hash", "0" * 64, "llm", ""), ("glob", "x", "human", ""),
    ]
    got = [r.fault is None for r in patterns.faults(spark.createDataFrame(rows, "tier string, value string, source string, original_line string")).collect()]
    assert got == [False, False, True, False, True, False, False, False, True, True, False]


def test_trust_is_the_same_for_few_and_for_many_networks(spark, monkeypatch):
    ev = spark.createDataFrame([(i, x) for i, x in enumerate(["10.1.2.3", "10.2.0.1", "8.8.8.8", "", None, "no", "192.168.0.7"])], "event_id long, ip string")
    nets = spark.createDataFrame([("", "10.1.0.0/16"), ("8.8.8.8", ""), ("192.168.0.7", None), ("", "bad"), ("", "1.2.3.0/x")], "ip_address string, cidr string")
    few = {r.event_id: r.trusted for r in networks.with_trust(ev, nets, "ip").collect()}
    monkeypatch.setattr(networks, "BROADCAST_ROWS", 0)
    assert few == {r.event_id: r.trusted for r in networks.with_trust(ev, nets, "ip").collect()}
    assert few == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_log_escapes_are_decoded_once(spark):
    cases = {"/a\\x22b": '/a"b', "\\x5Cx5C": "\\x5C", "/x\\x2": "/x\\x2", "\\\\x41": "\\A", "plain": "plain", "\\xzz\\x41": "\\xzzA"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", t.log_unescape(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in got} == cases


def test_container_streams_and_stored_patterns(spark, tmp_path):
    frame = lambda kind, text: bytes([kind, 0, 0, 0]) + len(text).to_bytes(4, "big") + text
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.bin").write_bytes(frame(1, b"2024-01-02T03:04:05.5Z hello\n") + frame(2, b"  oops ") + frame(1, b" \n") + b"\x01\x00\x00\x00\x7f\xff\xff\xffrest")
    rows = journal.container_frames(spark, str(tmp_path / "s")).orderBy("n").collect()
    assert [(r.n, r.stream, r.line, r.ts is None) for r in rows] == [(0, "stdout", "hello", False), (1, "stderr", "oops", True)]
    (tmp_path / "p.json").write_text(json.dumps({"docker:a": {"allow": [{"type": "hash", "value": "h"}, {"type": "prefix", "value": "p", "revoked": True}]}}))
    got = [(r.scope, r.bucket, r.tier, r.value, r.revoked, r.ord) for r in journal.stored_patterns(spark, str(tmp_path / "p.json")).collect()]
    assert got == [("docker:a", "allow", "hash", "h", False, 0), ("docker:a", "allow", "prefix", "p", True, 1)]


def test_journal_entries_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text('{"MESSAGE":"m","_COMM":"c"}\nbroken\n{"MESSAGE":""}\n')
    query = journal.entries(spark.readStream.text(str(tmp_path / "in"))).writeStream.format("memory").queryName("entries").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.source_name, r.line) for r in spark.table("entries").collect()] == [("c", "m")]


def own_checks(spark, lines, tokens):
    rows = spark.createDataFrame(lines, "event_id long, line string, at double").withColumn("ts", F.timestamp_seconds("at"))
    minted = spark.createDataFrame(tokens, "token string, at double").select("token", F.timestamp_seconds("at").alias("minted"))
    return sorted(r.event_id for r in journal.without_own_checks(rows, minted).collect())


def test_a_token_takes_one_line_while_it_lives(spark):
    a, b = "OV-" + "a" * 32, "OV-" + "b" * 32
    lines = [(1, f"x{a}f0 glued", 105.0), (2, f"GET / {a}", 106.0), (3, "GET /", 105.0), (4, f"GET / {b}", 111.0), (5, f"GET / {b}", 99.0), (6, None, 100.0), (7, f"GET / OV-{'c' * 32}", 100.0)]
    assert own_checks(spark, lines, [(a, 100.0), (b, 101.5)]) == [2, 3, 5, 6, 7]
    assert own_checks(spark, lines, [(a, 100.0), (b, 100.5), (b, 103.0)]) == [2, 3, 4, 5, 6, 7]  # minted twice: the first time counts, 10.5 s before
    assert own_checks(spark, lines, []) == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("waiting", [True, False])
def test_the_oldest_of_too_many_live_tokens_gives_way(spark, waiting):
    name = lambda i: f"OV-{i:032x}"
    # 200 tokens over 200 seconds are never too many; 60 in a second are, unless each is taken before the next is minted
    assert own_checks(spark, [(i, name(i), i + 0.5) for i in range(200)], [(name(i), float(i)) for i in range(200)]) == []
    lines = [(i, name(i), 102.0 if waiting else 100.0 + i / 100 + 0.001) for i in range(60)]
    assert own_checks(spark, lines, [(name(i), 100.0 + i / 100) for i in range(60)]) == (list(range(10)) if waiting else [])


def test_journal_fields_that_are_no_text(spark):
    rows = ['{"MESSAGE":[104,105],"_COMM":"x"}', '{"MESSAGE":"a","PRIORITY":6}', '{"MESSAGE":"b","_COMM":"x"', '{"MESSAGE":"c","_UID":null}', '{"MESSAGE":"d","OTHER":[1]}', '{"MESSAGE":null}', None, '{}']
    out = journal.entries(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.line, r.source_name, r.metadata["uid"]) for r in out] == [("c", "unknown", ""), ("d", "unknown", "")]


def test_a_persons_rule_downgrades_the_next_alert(spark):
    finding = [(1, "evt", "docker", "web", "h", "GET", "/x", 200, 500, "alert", "", "", "", "", 200, "b", "")]
    columns = "id long, event_id string, source_type string, source_name string, dest_host string, http_method string, http_path string, http_status int, response_bytes long, verdict string, normalized_hash string, matched_pattern_value string, matched_pattern_bucket string, matched_pattern_scope string, evidence_status_code int, evidence_body_hash string, resolution_status string"
    correction = spark.createDataFrame([("evt", "failed_probe", "", "")], "event_id string, kind string, target string, reason string").withColumn("at", F.current_timestamp())
    decision = spark.createDataFrame([], schemas.DECISIONS)
    rules = reviews.failed_probes(correction, spark.createDataFrame(finding, columns), decision)
    cases = [({"event_id": 1}, {"body": "plain words", "content_type": "text/plain"}), ({"event_id": 2, "host": "other"}, {"body": "plain words", "content_type": "text/plain", "resp_host": "other"}), ({"event_id": 3, "bytes": 700},), ({"event_id": 4, "bytes": 20_000},), ({"event_id": 5, "bytes": 700, "method": "POST"},)]
    alerts = investigate.evidence(*evidences(spark, cases))
    endpoints, cache = spark.createDataFrame([], schemas.ENDPOINTS), spark.createDataFrame([], "body_hash string, outcome string, classification string, reason string")
    judge = lambda g: g.withColumns({"classification": F.lit("suspicious"), "generic": F.lit(False), "reason": F.lit("")})
    got = {r.event_id: r for r in investigate.decisions(alerts, endpoints, cache, judge, catch_alls=rules).collect()}
    assert [(got[i].step, got[i].outcome) for i in range(1, 6)] == [("catch_all", "downgraded"), ("no_preview", "kept"), ("catch_all_bytes", "downgraded"), ("no_evidence", "kept"), ("no_evidence", "kept")]
    assert got[1].decision_reason == "Verified catch-all: 5 distinct paths on h all returned identical GET 200 response (body hash b) - human: marked as failed probe (no observable impact)"
    final = {r.event_id: r for r in investigate.final_findings(investigate.decisions(alerts.withColumn("coordinator_events", F.lit(3)), endpoints, cache, judge, catch_alls=rules)).collect()}
    assert (final[1].verdict, final[1].classification, final[1].previous_verdict, final[1].coordinator_events) == ("downgraded", "suspicious", "alert", 3)
    veto = rules.unionByName(rules.withColumns({"body_preview_hash": F.lit("c"), "verdict": F.lit("rejected")}))
    again = {r.event_id: r.step for r in investigate.decisions(alerts, endpoints, cache, judge, catch_alls=veto).collect()}
    assert again == {1: "catch_all", 2: "no_preview", 3: "no_evidence", 4: "no_evidence", 5: "no_evidence"}
    early = investigate.decisions(alerts.withColumn("body_hash", F.lit("b")), endpoints, cache, judge, catch_alls=rules)
    assert {r.event_id: r.step for r in early.collect()}[3] == "catch_all" and "body_hash" in early.columns


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    assert tables.cut(spark.range(3), "t").count() == 3


def test_hashes(spark):
    got = spark.createDataFrame([("a" * 64,), ("g" * 64,), ("A0" * 32 + "\n",), (None,)], "h string").select(reviews.is_hash(F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False]
