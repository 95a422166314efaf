import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logsieve.llm import ngram_join
from logsieve.llm.ngram_join import Law


def sets(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, num, den):
    s = [sets(t, width) for _, t in rows]
    near = list(range(len(rows)))

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
            near[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def got(docs, width, num, den):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, width, num, den).collect())


def corpus(seed, groups, most, lengths):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    common = " ".join(r.choices(words, k=30))
    for _ in range(groups):
        base = r.choices(words, k=r.choice(lengths))
        for _ in range(r.randint(1, most)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 40))):
                x[r.randrange(len(x))] = r.choice(words)
            if r.random() < 0.2:
                x = x[: -r.randint(1, 3)] or x
            out.append(" ".join(x) + (" " + common if r.random() < 0.3 else ""))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_against_brute_force(spark, width, num, den):
    rows = corpus(width, 60, 6, [3, 6, 8, 10, 12, 15, 18, 22, 26, 40, 80, 200])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, width, num, den) == brute(rows, width, num, den)


def test_a_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rows = corpus(9, 3, 120, [60, 90]) + [(10_000 + i, t) for i, (_, t) in enumerate(corpus(10, 10, 1, [60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_small_sets_link_by_subsets_alone(spark):
    rows = corpus(4, 80, 5, [4, 5, 6, 8, 9, 10, 11, 13])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 3, 70, 100) == brute(rows, 3, 70, 100)


def test_nulls_empty_repeats_and_clashing_columns(spark, documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert ngram_join.near_groups(empty).count() == 0
    kept = ngram_join.keep_one(documents.withColumnRenamed("digest", "items"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "uid", "items"]
    # rows 1, 2, 3 are one group, 8 and 9 another
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "10", "None", "None"])


def test_prefix_law_holds_for_all_sizes():
    for law in (Law(85, 100), Law(80, 100)):
        for n in range(1, 120):
            for m in range(law.least(n), n + 1):
                o = law.overlap(n, m)
                if o > m:
                    continue
                share = min(law.shared(n), law.shared(m), o)
                assert law.enough(n) <= share and law.enough(m) <= share
                assert law.prefix(n) >= min(n, n - o + share) and law.prefix(m) >= min(m, m - o + share)


def test_shingles_at_white_space_and_case():
    texts = ["  A b\tC d e ", "a B c D E", None, "", " \n", "x", "a b c d e f\x1cg"]
    a, b, c, d, e, f, g = ngram_join.shingle_sets(pa.array(texts), 4)
    assert (a == b).all() and len(a) == 2
    assert [len(x) for x in (c, d, e, f, g)] == [0, 0, 0, 1, 3]
    assert a.dtype == np.int64
