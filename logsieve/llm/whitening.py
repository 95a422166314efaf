"""Whitening of embeddings: covariance in two passes, eigenvectors of it, and a projection that every task holds.

Components become whole numbers, floor(256 c). The fit list holds each distinct vector of them once; it is made by
one shuffle (equal vectors meet in partial aggregates first, so a vector of very many rows stays cheap) and cut.
Pass one adds up its columns as whole numbers, so the mean is exact. Pass two adds up the outer products of the
centred vectors, one matrix product for each batch and one matrix for each task, merged by treeAggregate. LAPACK's
symmetric solver runs on the one d x d matrix that comes of it, and the projection goes to all tasks as a
broadcast of d x k numbers. A third pass over the fit list measures how far the whitened covariance is from the identity.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; so are rows of another
length than most distinct vectors have (of equally many, the longer). Entries beyond 2^31 / 256 count as that. A null
vec_id is kept. Components without variance have no whitened values and are left out, so one distinct vector, an
empty table or vectors of no entries give an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut
from logsieve.llm.vectors import by_length

WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_KIND = pa.decimal128(38, 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of length ``d`` of a list column of whole numbers without nulls."""
    kept = column.filter(pc.equal(pc.list_value_length(column), d))
    return np.asarray(pc.list_flatten(kept), np.int64).reshape(-1, d)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, x in by_length(b.column("embedding")):
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1]) if x.shape[1] else np.zeros(len(x) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length the number of a task's vectors and their sums, as text. Entries are below 2^31, so sums of a task fit into 64 bits."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        x = b.column("x")
        for d in filter(None, pc.unique(pc.list_value_length(x)).to_pylist()):
            m = _matrix(x, d)
            n, s = found.get(d, (0, np.zeros(d, np.int64)))
            found[d] = (n + len(m), s + m.sum(0))
    rows = [(d, n, i, int(v)) for d, (n, s) in found.items() for i, v in enumerate(s)]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["d", "n", "i", "s"])


def _products(d: int, centred):
    """One row for each task: the sum of outer products of what ``centred`` makes of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            z = centred(_matrix(b.column("x"), d))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _gathered(fit_list: DataFrame, d: int, k: int, centred) -> np.ndarray:
    """The sum of all tasks' k x k matrices, merged in two levels."""
    read = lambda m: np.frombuffer(bytes(m), np.float64).reshape(k, k)
    parts = fit_list.mapInArrow(_products(d, centred), "m binary").rdd
    return parts.treeAggregate(np.zeros((k, k)), lambda total, row: total + read(row.m), lambda a, b: a + b)


class Whitening:
    """What is learned: n, sums (whole numbers), mean, values and vectors (one column for each component) by falling eigenvalue, trace and identity_error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.mean = np.array([float(Decimal(s) / n) for s in sums])
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Of each row the sum of (n x - S)^2, exactly: in 64 bits where they hold it, else in Python's whole numbers."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far * far * max(1, x.shape[1]) < 2**63:
            off = self.n * x - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(1)).cast(_KIND)
        return pa.array([Decimal(sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))) for row in x.tolist()], _KIND)


def fit(table: DataFrame, components: int = 4) -> Whitening | None:
    """Learns from ``table`` (embedding); None where no component has variance. The driver holds sums, and matrices of the vectors' length."""
    fit_list = cut(table.select("embedding").mapInArrow(_whole, "x array<long>").distinct(), "whitening-fit")
    sums = fit_list.mapInArrow(_sums, "d int, n long, i int, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = sorted(tuple(r) for r in sums.select("n", "d", "i", "s").collect())
    if not sums:
        return None
    n, d = sums[-1][:2]
    totals = [int(s) for m, e, _, s in sums if (m, e) == (n, d)]
    mean = np.array([float(Decimal(s) / n) for s in totals])
    covariance = _gathered(fit_list, d, d, lambda x: x - mean) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum())
    k = min(components, some)
    if not k:
        return None
    model = Whitening(n, totals, values[:k].copy(), np.ascontiguousarray(vectors[:, :k]), float(np.trace(covariance)))
    model.identity_error = float(np.abs(_gathered(fit_list, d, k, model.whiten) / n - np.eye(k)).max())
    return model


def transform(table: DataFrame, model: Whitening) -> DataFrame:
    """A row of WHITENED for each usable row of ``table`` (vec_id, embedding) and component."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        k = len(m.values)
        for b in batches:
            for at, x in by_length(b.column("embedding")):
                if x.shape[1] != len(m.sums):
                    continue
                each = np.repeat(np.arange(len(x)), k)
                rows = len(each)
                columns = [
                    b.column("vec_id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, m.n)), m.deviations(x).take(pa.array(each)),
                    pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(rows, m.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, WHITENED)


def whiten(table: DataFrame, components: int = 4) -> DataFrame:
    """``table`` (vec_id, embedding) whitened by what it teaches itself, as WHITENED."""
    model = fit(table, components)
    return table.sparkSession.createDataFrame([], WHITENED) if model is None else transform(table, model)
