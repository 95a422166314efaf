"""Packing of token pieces into sequences of a fixed capacity: best-fit decreasing, certified by dual-feasible functions.

A document longer than the capacity is cut into full pieces and a rest; others are one piece. Pieces are put in
the order of their lengths over the whole table and dealt round, so that every partition has the same mix of
lengths, and each partition packs its own by best-fit decreasing. A dual-feasible function f maps sizes in
[0, 1] to [0, 1] so that any set of sizes that fits into a bin still does after f; the sum of f over the
pieces, rounded up, is therefore a lower bound on the bins. A partition whose bin count equals its largest
bound is certified and final. Of a partition with a gap, the bins that are exactly full are final too; all
others are opened, and their pieces are pooled with those of the other open partitions, dealt anew and packed
again. Rounds go on until the bound of the whole table is met, no partition has a gap, all that is open was in
one partition, or a round frees no bin (its places are then those of the round before).

Every piece carries ``certified``: whether its sequence is proven to be part of a least number of bins for its
partition's pieces. ``certificate`` sums up a result: its bins and the bound of the whole table.

Defined results: null text counts as empty; an empty document is one piece of length 1 (id 0 alone) and goes into
some sequence; rows that repeat are packed each; an empty table gives an empty result. Extra columns of the pieces
are kept; the added ones replace columns of the same names, and names that start with ``__pack_`` are this
operator's own and go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut, in_global_order
from logsieve.llm.tokens import default_path, encoder

CAPACITY = 2048
#: Pieces that one task packs.
PART_PIECES = 50_000
#: Sequence numbers set aside for a partition; it has no more bins than pieces.
PART_NUMBERS = 1 << 32
#: Ids in one batch of pieces.
BATCH_IDS = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACED = "uid long, length long, part long, bin long, offset long, certified boolean, open boolean"
ADDED = ("sequence_id", "offset", "certified")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` (doc_id, text) as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (little-endian unsigned 32-bit). A document's ids end with id 0."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as enc:
            for b in batches:
                docs_of = b.column("doc_id")
                for at_doc, ids, n in enc.slices(b.column("text")):
                    yield from cut_up(docs_of.slice(at_doc, len(n)), ids, n)

    def cut_up(docs_of: pa.Array, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, n = np.insert(ids, np.cumsum(n), np.uint32(0)).astype("<u4", copy=False), n + 1
        # pieces of each document, and their places in it and among all ids
        pieces = -(-n // capacity)
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, n[of] - start)
        at = np.concatenate([[0], np.cumsum(length)])
        doc = docs_of.take(pa.array(of))
        first = 0
        while first < len(of):
            last = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_IDS, "right")) - 1)
            rows = slice(first, last)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(4 * (at[first : last + 1] - at[first])), pa.py_buffer(ids[at[first] : at[last]])])
            columns = [doc[rows], pa.array(piece[rows], pa.int32()), pa.array(start[rows], pa.int64()), pa.array(length[rows], pa.int64()), data.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])
            first = last

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and what each bin holds. A piece goes into the fullest bin that has room for it."""
    bins, offsets, left = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, capacity - np.array(left, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound that the dual-feasible functions give for counts[s] pieces of size s.

    Two families: f_e keeps sizes from e to 1 - e, drops smaller ones and makes larger ones 1; u_k takes x to
    floor((k + 1) x) / k, but leaves x where (k + 1) x is whole.
    """
    s = np.arange(len(counts), dtype=np.int64)
    best = math.ceil(int((counts * s).sum()) / capacity)
    amounts, number = np.cumsum(counts * s), np.cumsum(counts)
    for e in range(1, capacity // 2 + 1):
        big = number[-1] - number[capacity - e]
        kept = amounts[capacity - e] - amounts[e - 1]
        best = max(best, int(big) + math.ceil(int(kept) / capacity))
    for k in range(1, 65):
        scaled = (k + 1) * s
        whole = scaled % capacity == 0
        f = np.where(whole, s * k, (scaled // capacity) * capacity)
        best = max(best, math.ceil(int((counts * f).sum()) / (k * capacity)))
    return best


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        met = len(fill) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        full = fill == capacity
        return pd.DataFrame({"uid": pdf["uid"], "length": sizes, "part": key[0], "bin": bins, "offset": offsets, "certified": full[bins] | met, "open": ~(full[bins] | met)})

    return run


def _bins(placed: DataFrame) -> tuple[int, int]:
    """Bins of a round, and the pieces that it leaves open."""
    each = placed.groupBy("part").agg((F.max("bin") + 1).alias("bins"), F.sum(F.col("open").cast("long")).alias("open"))
    found = each.agg(F.sum("bins").alias("bins"), F.sum("open").alias("open")).first()
    return found.bins or 0, found.open or 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """``pieces`` (length long, at most ``capacity``, and any other columns) with sequence_id long, offset long and certified boolean.

    Only (row id, length) is dealt and packed; full pieces need no packing and take a sequence each. What each
    round leaves open is counted, never collected; a task gets about ``part_pieces`` of them. The driver sees
    the number of pieces of each length, of which there are ``capacity`` at most.
    """
    rest = [c for c in pieces.columns if c not in ADDED and not c.startswith("__pack_")]
    rows = cut(pieces.select(*rest, F.monotonically_increasing_id().alias("__pack_row")), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    bound = lower_bound(counts, capacity)
    open_, n = rows.where(F.col("length") < capacity).select(F.col("__pack_row").alias("uid"), "length"), int(counts.sum())
    done: list[DataFrame] = []
    base, final, before = 0, 0, None  # numbers given out, bins that are final, and the round before with its open bins
    while n:
        parts = math.ceil(n / part_pieces)
        dealt, _ = in_global_order(open_, ["length", "uid"], "pack-order")
        dealt = dealt.withColumn("part", F.pmod("row_index", F.lit(parts)))
        placed = cut(dealt.select("uid", "length", "part").groupBy("part").applyInPandas(_pack(capacity), PLACED), "pack-round")
        bins, left = _bins(placed)
        if before and bins >= before[1]:
            done.append(before[0].where("open"))
            break
        placed = placed.withColumn("sequence_id", F.col("part") * PART_NUMBERS + F.col("bin") + base)
        base += parts * PART_NUMBERS
        if not left or parts == 1 or final + bins <= bound:
            done.append(placed)
            break
        done.append(placed.where("NOT open"))
        kept = placed.where("NOT open").select("sequence_id").distinct().count()
        final, before = final + kept, (placed, bins - kept)
        open_, n = placed.where("open").select("uid", "length"), left
    whole = rows.where(F.col("length") >= capacity).select("*", (-1 - F.col("__pack_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    if not done:
        return whole.select(*rest, *ADDED)
    places = done[0]
    for x in done[1:]:
        places = places.unionByName(x)
    places = places.select(F.col("uid").alias("__pack_row"), *ADDED)
    return rows.where(F.col("length") < capacity).join(places, "__pack_row").unionByName(whole).select(*rest, *ADDED)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Of a result of ``pack``: its bins, the lower bound of its pieces, and the pieces that are in no certified sequence."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    found = packed.agg(F.countDistinct("sequence_id").alias("bins"), F.sum((~F.col("certified")).cast("long")).alias("open")).first()
    return {"bins": found.bins, "bound": lower_bound(counts, capacity), "uncertified": found.open or 0}


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids and places: doc_id, piece, start, length, ids, sequence_id, offset, certified."""
    return pack(token_pieces(docs, path, capacity), capacity)
