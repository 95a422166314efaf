from collections import Counter

import numpy as np
import pytest
from test_ngram_join import brute, corpus

from logsieve.llm import minhash, ngram_join


def got(docs, width, num, den):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(docs, width, num, den).collect())


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2)])
def test_components_against_brute_force(spark, width, seed):
    rows = corpus(seed, 70, 6, [2, 3, 4, 5, 6, 8, 10, 15, 26, 40, 80, 200])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, width, 80, 100) == brute(rows, width, 80, 100)


def test_large_groups_by_stars_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(minhash, "LONG_BAND", 8)
    rows = corpus(9, 3, 120, [60, 90]) + [(10_000 + i, t) for i, (_, t) in enumerate(corpus(10, 10, 1, [60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 2, 80, 100) == brute(rows, 2, 80, 100)


def test_nulls_empty_repeats_and_clashing_columns(spark, documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    clashing = documents.withColumnsRenamed({"digest": "bands", "lang": "component_id", "uid": "cid"})
    assert got(clashing, 2, 80, 100) == brute(rows, 2, 80, 100)
    out = minhash.near_groups(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = {(r.doc_id, r.kept) for r in minhash.near_groups(documents, 2).collect()}
    assert {(1, True), (2, False), (8, True), (9, False), (4, True), (None, True)} <= kept


def test_both_ends_of_a_permutation_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.8):
        common = r.integers(-(2**63), 2**63, 400)
        own = [r.integers(-(2**63), 2**63, round(400 * (1 - share) / share / 2)) for _ in range(2)]
        sets = [np.unique(np.concatenate([common, x])) for x in own]
        low, high = minhash.signatures(sets)
        assert abs(np.mean([low[0] == low[1], high[0] == high[1]]) - share) < 0.1
    # sets hashed together and apart have the same values, and a set of one element has one value at both ends
    one = [sets[0], sets[1], sets[0][:1]]
    low, high = minhash.signatures(one)
    for i, s in enumerate(one):
        a, b = minhash.signatures([s])
        assert (a[0] == low[i]).all() and (b[0] == high[i]).all()
    assert (low[2] == high[2]).all()
    keys = minhash.band_keys(low, high)
    assert keys.shape == (3, minhash.BANDS) and len(np.unique(keys[2])) == minhash.BANDS
