"""Embeddings as integer vectors: what the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts of one unit of a component.
UNIT = 256
#: Whole numbers that components are held to, so that sums of them stay exact.
MOST = 2**31 - 1


def usable(column: pa.Array) -> np.ndarray:
    """Which rows of a list column are neither null nor hold null, NaN or infinite entries."""
    good = np.asarray(pc.is_valid(column))
    if not len(column):
        return good
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = pc.list_flatten(column)
    entry = np.asarray(pc.is_valid(flat)) & np.isfinite(np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0)))
    bad = np.zeros(len(column), np.int64)
    np.add.at(bad, np.repeat(np.arange(len(column)), sizes), ~entry)
    return good & (bad == 0)


def by_length(column: pa.Array, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the usable rows of a list column, for each length: their places, and floor(256 * entry), held to ``most``, as an int64 matrix."""
    good = np.flatnonzero(usable(column))
    kept = column.take(pa.array(good))
    sizes = np.asarray(pc.list_value_length(kept), np.int64) if len(kept) else np.zeros(0, np.int64)
    flat = np.asarray(pc.list_flatten(kept).cast(pa.float64()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        yield good[rows], np.clip(np.floor(UNIT * x), -most, most).astype(np.int64)
