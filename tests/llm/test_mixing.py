import hashlib
import math
from collections import Counter

from logsieve.llm import mixing


def draws(row, rate, seed=11):
    n = max(1, math.ceil(rate / 32))
    out = 0
    for i in range(1, n + 1):
        u = int(hashlib.md5(f"{seed}|{row}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / n)
        k = 0
        while c <= u and k < 127:
            k += 1
            p *= rate / n / k
            c += p
            out += 1
    return out


def row(r):
    return f"{'' if r.doc_id is None else r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}"


def check(docs, weights):
    rows = docs.collect()
    n = Counter(r.source or "" for r in rows)
    share = weights or {s: c**0.7 for s, c in n.items()}
    total = sum(share.get(s, 0) for s in n)
    rate = {s: len(rows) * share.get(s, 0) / (total * n[s]) for s in n}
    want = Counter()
    for r in rows:
        want[row(r)] += draws(row(r), rate[r.source or ""])
    got = Counter(row(r) for r in mixing.mix(docs, weights).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_copies_are_the_inverse_of_the_poisson_distribution(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 3 else f"s{i % 60}") for i in range(2000)], "doc_id long, text string, source string")
    check(docs, None)
    check(docs, {"big": 1.0, "s0": 4.0, "none": 3.0})


def test_large_rates_and_salted_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "rare" if i < 3 else "big") for i in range(400)], "doc_id long, text string, source string")
    check(docs, {"rare": 9.0, "big": 1.0})
    monkeypatch.setattr(mixing, "checked_broadcast", lambda df, rows: df)
    check(docs, None)


def test_nulls_repeats_and_extra_columns(documents, empty):
    out = mixing.mix(documents.withColumnRenamed("digest", "copy_no"))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "uid", "copy_no", "mix_key"}
    check(documents, None)
    assert mixing.mix(empty).count() == 0


def test_order_is_a_shuffle_by_key(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    keys = [r.mix_key for r in mixing.mix(docs).collect()]
    assert len(set(keys)) == len(keys)
