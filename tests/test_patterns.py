"""Matching by automata gives what arrays give, at a cost that does not grow with the patterns."""

import random
import time

import duckdb
import pytest

from logsieve.operators import patterns as p

EVENTS = "event_id long, scope string, hash string, normalized string"


def events(spark, lines):
    return spark.createDataFrame([(i, s, f"h{i % 50}", x) for i, (s, x) in enumerate(lines)], EVENTS)


def found(spark, rows, known):
    out = p.match(events(spark, rows), known).select("event_id", "match.*").collect()
    return sorted(map(str, out))


def store(r, n):
    words = ["GET", "POST", "/a", "/b", "login", "admin", "<NUM>", "200", "404", "x.php", "é", "$", "(", "."]
    text = lambda k: " ".join(r.choices(words, k=k))
    for i in range(n):
        tier = r.choice(p.TIERS)
        value = f"h{r.randrange(60)}" if tier == "hash" else text(r.choice([1, 2, 3])) if tier != "regex" else r.choice(["^GET /a", "^POST .*[0-9]{3}", "login.admin", "a|b", "GET *x", "(?i)LOGIN", "^$", r"\\bx", "200$"])
        yield (r.choice(["s1", "s2", p.GLOBAL]), r.choice(p.BUCKETS), tier, value, "llm", f"r{i}", r.random() < 0.1, i)
    yield ("s1", "suppress", "contains", "", "llm", "empty", False, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_automata_find_what_arrays_find(spark, monkeypatch, seed):
    r = random.Random(seed)
    known = p.patterns(spark, list(store(r, 300)))
    words = ["GET", "POST", "/a", "/b", "login", "admin", "<NUM>", "200", "404", "x.php", "é", "$", "(", ".", "LOGIN"]
    lines = [(r.choice(["s1", "s2", "s3", None]), r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 6)))])) for _ in range(400)]
    monkeypatch.setattr(p, "FEW", 10_000)
    want = found(spark, lines, known)
    monkeypatch.setattr(p, "FEW", 3)
    assert found(spark, lines, known) == want
    monkeypatch.setattr(p, "AUTOMATA_BYTES", 1)
    assert found(spark, lines, known) == want


def test_texts_that_regexes_must_hold():
    cases = {"^GET /[?]q=UNION": "GET /", "^abc*": "ab", "abc+x": "ab", "a|b": "", "(?i)abc": "", "^": "", "x{2}y": "", "ab.c": "ab", "^a(b|c)": "", "^a(bc)": "a"}
    assert {k: p.literal(k) for k in cases} == cases


def test_ten_thousand_patterns_cost_a_line_no_more_than_twice_twenty():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    one = lambda i: (1, 0, 2 if i % 2 else 4, i, "malicious", "prefix" if i % 2 else "contains", f"GET /{word()}", "llm", "", None)
    lines = [f"GET /{word()}/{word()} HTTP/1.1 200 {word()}" for _ in range(3000)]
    took = {}
    for n in (20, 10_000):
        automata = p._Automata({"s": [one(i) for i in range(n)]})
        automata.search("s", "")
        took[n] = min(_timed(automata, lines) for _ in range(5))
    assert took[10_000] < 2.5 * took[20]


def _timed(automata, lines):
    began = time.process_time()
    for x in lines:
        automata.search("s", x)
    return time.process_time() - began


@pytest.mark.parametrize("name", ["pattern_counts", "pattern_match_many"])
def test_all_that_lines_taught_counts(spark, monkeypatch, name):
    from test_oracle import SF, rows

    from logsieve.plans import catalog

    for tier in ("prefix", "contains"):
        monkeypatch.setitem(p.CAPS, tier, 2)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
