"""Reproducible shuffle into shards: a keyed Feistel permutation, with cycle walking, over global row numbers.

The permutation of [0, n) is a balanced Feistel network over the smallest even-bit domain that holds n; a value
that falls outside [0, n) is put through again until it falls inside (at most four times on average, as the
domain is less than 4 n). The permuted number p gives the shard p mod k and the slot p div k, so any row's
place follows from (row number, n, seed) alone, shards differ by one row at most, and slots have no gaps.

Defined results: rows are numbered by doc_id (nulls first), then by size and checksum; rows alike in all three
are interchangeable. Null text has size 1 and checksum 0. An empty table gives an empty result. Other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import in_global_order

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), (seed * 0x94D049BB133111EB + 1) % 2**64)]


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the rows numbered ``index`` (each in [0, n)) go under the permutation of [0, n)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), _keys(seed)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def invert(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers that ``permute`` sends to ``place``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), _keys(seed)
    out = place.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for key in reversed(keys):
            left, right = right ^ (_mix(left, key) & mask), left
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, row_index, shard, slot."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, n = in_global_order(light, ["doc_id", "size", "text_crc32"], "shard-order")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = permute(b.column("row_index").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((to % shards).astype(np.int32)), pa.array(to // shards)], [*b.schema.names, "shard", "slot"])

    columns = ["doc_id", "size", "text_crc32", "row_index"]
    return numbered.select(*columns).mapInArrow(place, "doc_id long, size long, text_crc32 long, row_index long, shard int, slot long")
