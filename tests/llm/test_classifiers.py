import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logsieve.llm import quality, toxicity
from logsieve.llm.folds import held_out, labelled

INSULTS = ["blockhead", "dimwit", "numbskull"]


def clean(r):
    words = ["the", "river", "house", "of", "green", "walks", "slowly", "over", "meadow", "and", "bright", "window", "keeps", "watch", "table"]
    return " ".join(" ".join(r.choices(words, k=r.randint(5, 12))).capitalize() + "." for _ in range(r.randint(3, 9)))


def junk(r):
    k = r.randrange(3)
    if k == 0:
        return clean(r).upper().replace(" ", "!! ")
    if k == 1:
        return " | ".join(clean(r).split())
    return " ".join(w for w in clean(r).split() for _ in range(8))


def insult(r, text):
    words = text.split()
    for _ in range(r.randint(2, 4)):
        words.insert(r.randrange(len(words)), r.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(2500):
        good, bad = r.random() < 0.75, r.random() < 0.2
        text = clean(r) if good else junk(r)
        if bad:
            text = insult(r, text)
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(good), int(bad)))
    docs += [(3001, None), (3002, ""), (3003, "x" * 200_000), (None, "no id")]
    labels += [(4000, 1, 1), (None, 1, 0), (1, 1 - labels[0][1], 1 - labels[0][2])]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'e' AS label"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folds_and_labels(spark, tables):
    got = tables[0].where("doc_id < 50").select("doc_id", held_out(tables[0]["doc_id"]).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    chosen = labelled(tables[1], "quality", 100).collect()
    assert sum(r.label for r in chosen) == 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in chosen)
    assert 1 not in {r.doc_id for r in chosen}


def hits(scored, column, tables):
    truth = {r.doc_id: r[column] for r in tables[1].collect() if r.doc_id not in (1, None, 4000)}
    rows = [r for r in scored.collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 100
    return np.mean([r.predicted == truth[r.doc_id] for r in rows])


def test_quality_on_held_out_rows(tables):
    model, prior = quality.fit(*tables)
    assert abs(prior - 0.75) < 0.12
    out = quality.score(tables[0], model)
    assert set(out.columns) == {"doc_id", "text", "label", "score", "predicted"}
    assert hits(out, "quality", tables) > 0.97
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert out.count() == tables[0].count()


def test_prior_estimate():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, 4000), np.concatenate([r.normal(2, 1, 6000), r.normal(-2, 1, 4000)])
    assert abs(quality.best_bin_prior(p, u) - 0.6) < 0.06


def test_toxicity_on_held_out_rows(tables):
    model = toxicity.fit(*tables)
    out = toxicity.score(tables[0], model)
    assert hits(out, "toxic", tables) > 0.98
    by = {r.doc_id: r.score for r in out.collect()}
    assert len(by) == tables[0].count() and max(by[3001], by[3002]) < 0.5
    scorer = toxicity.Scorer(model)
    gapped = pa.array(["what a b.l.o.c.k.h.e.a.d he is", "you dim-wit there", "a n u m b s k u l l indeed", "Dimwit!", "the river house of green", None])
    assert (model.score(scorer.tops(gapped)) >= 0.5).tolist() == [True, True, True, True, False, False]


def test_toxicity_of_gapped_strings_and_phrases():
    r = random.Random(8)
    texts, toxic = [], []
    for i in range(900):
        text = clean(r)
        if i % 3 == 0:
            text = insult(r, text)
        elif i % 3 == 1:
            # a phrase whose words are common
            words = text.split()
            words[3:3] = "walks over house".split()
            text = " ".join(words)
        texts.append(text)
        toxic.append(int(i % 3 < 2))
    model = toxicity.train(texts, np.array(toxic))
    bad = ["dim wit", "num bsk ull", "b. l. o. c. k. h. e. a. d.", "d---i---m---w---i---t", "d\ni\nm\nw\ni\nt", "d - i - m - w - i - t", "bloc\n\nkhead", "he walks over house", "walks, over  house"]
    good = ["the meadow table keeps watch of green", "a b c d e f", "", "house bright window walks", "x " * 500, "z" * 100_000]
    value = toxicity.Scorer(model).tops(pa.array([f"the river {x} of green" for x in bad] + good))
    assert (model.score(value) >= 0.5).tolist() == [True] * len(bad) + [False] * len(good)
    assert toxicity.Scorer(model).tops(pa.array(["green " * 150_000 + "dim wit"]))[0] > model.place


def test_bounds_of_runs_leave_none_out(monkeypatch):
    r = random.Random(4)
    texts = [insult(r, clean(r)) if i % 2 else clean(r) for i in range(300)]
    model = toxicity.train(texts, np.arange(300) % 2)
    monkeypatch.setattr(toxicity, "LETTERS", 40)
    some = ["dim wit " + " ".join(r.choices(["dim", "wit", "d", "numb.", "--", "skull", "he", "block", "ad"], k=25)) for _ in range(30)]
    words, which, bounds = toxicity._words(pa.array(some, pa.large_string()))
    docs, strings = model.runs(words, which, bounds, np.full(30, model.place))
    got = {(d, s) for d, s, v in zip(docs, strings, model.units(strings), strict=True) if v > model.place}
    every = set()
    for d, text in enumerate(some):
        parts = [x for w in text.split() if (x := toxicity.letters(w))]
        every |= {(d, x) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) if len(x := "".join(parts[i:j])) <= toxicity.REACH}
    every = sorted(every)
    want = {x for x, v in zip(every, model.units([x for _, x in every]), strict=True) if v > model.place}
    assert got == want and want


def test_kernel_is_the_sum_over_common_gapped_triples():
    number, weight = toxicity._merged(*toxicity.triples(["abcd", "a.bcd", "xyz", ""]))
    phi = np.zeros((4, 64**3))
    np.add.at(phi, (np.arange(4)[:, None], number), weight)
    k = phi @ phi.T
    raw = {s: toxicity.DECAY**n for s, n in (("abc", 3), ("bcd", 3), ("abd", 4), ("acd", 4))}
    far = {s: toxicity.DECAY**n for s, n in (("abc", 4), ("bcd", 3), ("abd", 5), ("acd", 5))}
    norm = lambda x: sum(v * v for v in x.values()) ** 0.5
    assert abs(k[0, 1] - sum(raw[s] * far[s] for s in raw) / norm(raw) / norm(far)) < 1e-6
    assert abs(k[0, 0] - 1) < 1e-6 and k[0, 2] == 0 and k[3, 3] == 0


def test_no_labels_and_no_text(spark, empty, tables):
    none = tables[1].limit(0)
    model, _ = quality.fit(tables[0], none)
    assert {r.score for r in quality.score(tables[0], model).limit(5).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(tables[0], toxicity.fit(tables[0], none)).limit(5).collect()} == {0}
    assert quality.score(empty, model).count() == 0
    assert quality.fit(empty, tables[1])[0].blank
    assert toxicity.fit(empty, tables[1]).weights is None


def test_quality_sample_is_bounded_by_rows_and_not_by_ids(spark, monkeypatch):
    rows = [(1 + i % 3, f"word{i} and some more text of a document {i % 40}") for i in range(400)] + [(50 + i, "plain text here") for i in range(50)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda p, u, prior=None: seen.append((len(p), len(u))) or (quality.Model(0), 0.5))
    quality.fit(docs, labels, positives=20, unlabelled=60)
    assert seen[-1] == (20, 60)
    quality.fit(docs, labels, positives=10_000, unlabelled=10_000)
    fold = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5]
    assert seen[-1] == (sum(d < 4 for d in fold), len(fold))
