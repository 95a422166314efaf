import math
import random
from collections import Counter

import numpy as np
import pytest

from logsieve.llm import mining

SCHEMA = "vec_id long, label int, embedding array<float>, score long, uid string"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    usable = [(i, c, [math.floor(256 * float(np.float32(v))) for v in e]) for i, c, e in rows if i is not None and c is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = Counter()
    for a, label, x in usable:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, c) for i, c, y in usable if i != a and len(y) == len(x))
        for s, i, c in [t for t in scored if t[2] == label][:positives]:
            fits = [(-t, j) for t, j, k in scored if k != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out.update((a, i, r, j, -s, t) for r, (t, j) in enumerate(fits, 1))
    return out


def got(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return Counter(tuple(r) for r in mining.hard_negatives(table).collect())


def vectors(seed, n, d, labels=4, step=1 / 256):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (labels, d))
    for i in range(n):
        c = int(r.integers(labels))
        yield i, c, [float(v) for v in np.round((centres[int(r.integers(labels))] * 0.5 + centres[c] + r.normal(0, 0.2, d)) / step) * step]


@pytest.mark.parametrize(("seed", "d", "step"), [(1, 24, 1 / 256), (2, 9, 0.5), (3, 1, 0.25)])
def test_against_brute_force_with_ties(spark, monkeypatch, seed, d, step):
    monkeypatch.setattr(mining, "BLOCK_ROWS", 70)
    monkeypatch.setattr(mining, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(mining, "CELL_ANCHORS", 4)
    rows = list(vectors(seed, 700, d, step=step))
    found = got(spark, rows)
    assert found and found == brute(rows)


def test_nulls_ragged_repeated_and_empty(spark):
    rows = list(vectors(5, 260, 6, labels=2))
    rows += rows[:3] + [rows[7]] * 40 + [(900, 1, rows[3][2])]  # repeats of an anchor, of a candidate, and a tie
    rows += [(None, 1, [0.5] * 6), (50, None, [0.5] * 6), (100, 1, None), (150, 0, [0.5, None] + [0.1] * 4), (200, 0, [float("nan")] + [0.2] * 5), (250, 1, [float("inf")] * 6), (300, 0, []), (350, 1, [1.0, 2.0]), (351, 0, [0.75, 1.5]), (352, 1, [1.0, 2.0])]
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == brute(rows)
    assert not got(spark, [])
    assert not got(spark, [(0, 1, [0.5, 0.5])])


def test_bit_planes_give_exact_scores_and_sound_intervals():
    r = np.random.default_rng(4)
    for most in (1, 3, 200, mining.MOST):
        x, a = r.integers(-most, most + 1, (50, 13)), r.integers(-most, most + 1, (4, 13))
        exact = a @ x.T
        bits = mining.sliced(x)

        def stays(at, low, high, live):
            if live is not None and low.shape == exact.shape:
                assert (low <= exact).all() and (exact <= high).all()
            return np.ones(low.shape, bool)

        at, row, score = mining.search(a, bits, np.ones((4, 50), bool), stays)
        assert len(at) == 200 and (score == exact[at, row]).all()

        def above(at, low, high, live, bar=np.sort(exact.ravel())[-5]):
            return high >= bar

        at, row, score = mining.search(a, bits, np.ones((4, 50), bool), above)
        assert sorted(score.tolist()) == sorted(v for v in exact.ravel().tolist() if v >= np.sort(exact.ravel())[-5])
