import math
from collections import Counter

import numpy as np
import pytest

from logsieve.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string"


def whole(rows):
    return [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]


def check(spark, rows, d, components=4):
    table = spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)
    out = whitening.whiten(table, components).collect()
    used = [(i, x) for i, x in whole(rows) if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in used}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = (fit * n - s).astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * d * 2.3e-16).sum()))
    assert len(out) == len(used) * k
    deviation = Counter((i, sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True))) for i, x in used for _ in range(k))
    assert Counter((r.vec_id, int(r.deviation)) for r in out) == deviation
    by = {}
    for r in out:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        by.setdefault(r.component, []).append((int(r.deviation), r.whitened))
    for c, found in by.items():
        want = [(sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)), float((np.array([float(n * v - t) for v, t in zip(x, s, strict=True)]) / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1]))) for _, x in used]
        for sign in (1, -1):
            if np.allclose([w for _, w in sorted(found)], [w for _, w in sorted((q, sign * w) for q, w in want)], atol=1e-7):
                break
        else:
            raise AssertionError(c)
    return out


def rows_of(seed, n, d, scale=0.1):
    r = np.random.default_rng(seed)
    mix = r.normal(0, 1, (d, d)) * np.linspace(3, 0.2, d)[:, None]
    return [(i, [float(v) for v in r.normal(0, scale, d) @ mix]) for i in range(n)]


def test_against_numpy_with_repeats(spark):
    rows = rows_of(1, 400, 12)
    check(spark, rows + [(1000 + i, rows[3][1]) for i in range(200)], 12)


def test_nulls_ragged_and_ids(spark):
    rows = rows_of(2, 60, 5)
    odd = [(None, rows[0][1]), (7, rows[1][1]), (1, None), (2, [0.1, None, 0.1, 0.1, 0.1]), (3, [float("nan")] * 5), (4, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (5, []), (6, [0.5] * 3)]
    check(spark, rows + odd, 5)


def test_dimensions_without_variance_are_left_out(spark):
    rows = [(i, [0.25, i / 256, -i / 256]) for i in range(50)]
    assert {r.component for r in check(spark, rows, 3)} == {1}


def test_no_variance_or_no_rows(spark):
    for rows in ([], [(1, [0.5, 0.5])] * 3, [(1, None)], [(1, [])]):
        table = spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)
        out = whitening.whiten(table)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits_are_exact():
    m = whitening.Whitening(10**6, [3 * 10**14, -5], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[2**31 - 1, 7], [-(2**31) + 1, 0]])
    assert [int(v) for v in m.deviations(x).to_pylist()] == [sum((10**6 * int(v) - s) ** 2 for v, s in zip(r, m.sums, strict=True)) for r in x]
