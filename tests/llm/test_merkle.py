import hashlib

from pyspark.sql import functions as F

from logsieve.llm import merkle


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def tree(text):
    cut = lambda p: [md5(" ".join(w[i : i + 8])) for w in [p.split(" ")] for i in range(0, len(w), 8)]
    return [[cut(p) for p in s.split("\n")] for s in text.split("\n\n")]


def fingerprint(text):
    t = tree(text)
    node = lambda s: md5("".join(md5("".join(p)) for p in s))
    root = hashlib.sha256("".join(map(node, t)).encode()).hexdigest()
    return root + ";" + "|".join(node(s)[:8] + "=" + "/".join(md5("".join(p))[:8] + ":" + ",".join(x[:8] for x in p) for p in s) for s in t)


def leaves(text):
    return {x[:8] for s in tree(text) for p in s for x in p}


def near(a, b):
    return 1.0 if fingerprint(a) == fingerprint(b) else 2 * len(leaves(a) & leaves(b)) / (len(leaves(a)) + len(leaves(b)))


def check(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(t), fingerprint(edited))
        assert abs(r.near_edited - near(t, edited)) < 1e-12 and abs(r.near_next - near(t, after)) < 1e-12


def test_fingerprints_against_brute_force(documents, spark, monkeypatch):
    check(documents.where("doc_id IS NOT NULL AND doc_id <> 8"))
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    docs = spark.createDataFrame([(i * i % 1009, f"line {i}\n\npara {i % 7} " + "some words go here " * (i % 9)) for i in range(100)], "doc_id long, text string")
    check(merkle_buckets(docs))


def merkle_buckets(docs):
    assert merkle.with_next(docs, 7).select("bucket").distinct().count() > 5
    return docs


def test_nulls_repeats_one_row_and_empty(documents, empty, spark):
    assert merkle.fingerprints(documents).count() == documents.count()
    assert merkle.fingerprints(empty).count() == 0
    one = merkle.fingerprints(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 8


def test_differing_branches_locate_an_edit(spark):
    a = "first section\nsecond line\n\nsecond section\nits other line\n\nthird"
    b = a.replace("its other", "its changed")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    prints = [merkle.fingerprint(merkle.tree(F.col(c))) for c in ("a", "b")]
    found = df.select(*[p.alias(n) for p, n in zip(prints, ("x", "y"), strict=True)]).select(merkle.differing(F.col("x"), F.col("y")).alias("d"), merkle.differing(F.col("x"), F.col("x")).alias("none")).first()
    assert [tuple(x) for x in found.d] == [(1, 1)] and found.none == []


def test_no_python_runs(documents):
    plan = merkle.fingerprints(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
