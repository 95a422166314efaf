import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from logsieve.llm import registry
from tests.llm.test_mixing import row
from tests.llm.test_ngram_join import sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, SF), f"test-{i}")
        out.append(docs)
    return out


def test_stages_against_brute_force(kept):
    tables = [t.collect() for t in kept]
    assert all(t.columns == corpus_pipeline.COLUMNS for t in kept[:5])
    labels = {r.doc_id: r.quality for r in kept[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in tables[1]}
    known = [d for d in labels if d in {r.doc_id for r in tables[0]}]
    assert sum((d in good) == bool(labels[d]) for d in known) >= 0.95 * len(known)
    # exact dedup
    least = {}
    for r in tables[1]:
        t = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in tables[2]) == sorted(least.values())
    # near copies
    s = [(r.doc_id, sets(r.text, 5)) for r in tables[2]]
    label = {d: d for d, _ in s}
    for i, (d, a) in enumerate(s):
        for e, b in s[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = label[d], label[e]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert sorted(r.doc_id for r in tables[3]) == sorted(d for d in label if label[d] == d)
    # copies are whole rows of the stage before, and pieces cover each copy
    assert {row(r) for r in tables[4]} <= {row(r) for r in tables[3]}
    assert 0.7 * len(tables[3]) < len(tables[4]) < 1.3 * len(tables[3])
    copies = Counter(r.doc_id for r in tables[4])
    assert Counter(r.doc_id for r in tables[5] if r.piece == 0) == copies
    bins = defaultdict(int)
    for r in tables[5]:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= 1.05 * -(-sum(bins.values()) // 2048) + 1


def test_run_is_the_stages_one_after_the_other(spark, kept):
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(kept[-1])


def test_each_operator_has_one_query():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_stand_nulls_long_texts_and_extra_columns(spark, documents, empty):
    from pyspark.sql import functions as F

    docs = documents.withColumns({"n_chars": F.length("text"), "__id": F.lit(1), "component": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.cut(stage(spark, docs, SF), "edge")
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, empty, SF).count() == 0, name
    ids = lambda i: sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[i][1](spark, docs, SF).collect())
    # equal texts: 1 and 3, the two rows of 8, and null and empty ones (4, 5 and a row without an id); white space is not empty
    assert ids(1) == sorted(["1", "2", "4", "6", "7", "8", "9", "10", "None"])
    # near copies: 1, 2, 3 lower-cased, and ONE with one; texts without words stay
    assert ids(2) == sorted(["1", "4", "5", "6", "7", "8", "10", "None", "None"])
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert pieces.where("piece = 0").count() == docs.count() and corpus_pipeline.STAGES[4][1](spark, empty, SF).count() == 0
