"""Hard negatives by integer inner products, computed on bit-planes with intervals that narrow.

Components are whole numbers, floor(256 c), kept in slices: of a block of rows one plane of bits for each binary
digit (two's complement), most significant first. A plane times an anchor is a product with a 0/1 matrix, so after
each plane a candidate's score is known up to (2^p - 1) times the anchor's positive or negative part, p being the
planes still to come. Candidates whose interval cannot reach what they would have to leave; where few are left, the
other planes are read for those pairs alone. Scores of candidates that stay to the end are exact.

Anchors (the query set) meet all rows in cells: a part of at most CELL_ROWS rows and a chunk of at most about
CELL_ANCHORS anchors, dealt by (chunk, part). A task holds a cell and goes through it in blocks; what it hands on
are at most ``positives`` rows for an anchor, or ``negatives`` for an anchor and positive, which are merged by rank.
No other pairs are written, so ties and repeated rows, however many, cost no more than others.

Defined results: rows without vec_id or label, or whose vector is null or holds null or non-finite entries, take no
part. Entries beyond 2^17 count as that, so that scores of vectors of up to 2,048 entries, and their intervals, fit
into 64 bits. Rows are candidates of anchors whose vectors have their length.
Rows that repeat are candidates each (ranks among equal ones are as for one of them, as their scores are), but none
with the anchor's own vec_id. An anchor without positives gives no rows, and so does an empty table. Other columns
are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.common import cut
from logsieve.llm.vectors import by_length

#: Whole numbers that components are held to.
MOST = 2**25
#: Rows and anchors in one cell, and in one block of it.
CELL_ROWS, CELL_ANCHORS = 65_536, 4096
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 256
#: Share of pairs below which planes are read for single pairs.
SPARSE = 1 / 24
#: Pairs that are read so at a time.
PAIRS = 65_536
_BLOCKS = "part int, d int, planes int, ids binary, labels binary, bits binary"
_ANCHORS = "vec_id long, label long, d int, x binary"
_FOUND = "uid long, other long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def sliced(x: np.ndarray) -> np.ndarray:
    """The bit-planes of whole numbers (rows, d), most significant first: (planes, rows, ceil(d / 8)) bytes. The first stands for -2^(planes - 1)."""
    most = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    return np.stack([np.packbits((x >> p) & 1 != 0, axis=1) for p in range(most.bit_length(), -1, -1)])


def weights(planes: int) -> list[int]:
    return [-(1 << (planes - 1)), *(1 << p for p in range(planes - 2, -1, -1))]


def search(anchors: np.ndarray, bits: np.ndarray, open_: np.ndarray, stays: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, exact score) that no interval rules out.

    ``anchors``: (a, d) whole numbers; ``bits``: planes of rows; ``open_``: (a, rows) pairs to look at. ``stays`` gets
    the number of the anchor of each pair, the pairs' least and most scores, and which pairs are open, as matrices
    (a, rows); or, for single open pairs, vectors and None. It says which of them stay.
    """
    planes = len(bits)
    d = anchors.shape[1]
    # products of 0/1 and whole numbers are exact in doubles as long as they are below 2^53
    exact = int(np.abs(anchors).sum(1).max(initial=0)) << planes < 2**53
    kind = np.float64 if exact else np.int64
    a = anchors.astype(kind)
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    rows = np.flatnonzero(open_.any(0))
    if not len(rows):
        return rows, rows, rows
    live = open_[:, rows]
    score = np.zeros(live.shape, kind)
    of = np.broadcast_to(np.arange(len(a))[:, None], live.shape)
    for i, w in enumerate(weights(planes)):
        plane = np.unpackbits(bits[i][rows], axis=1, count=d).astype(kind)
        score += w * (a @ plane.T)
        rest = (1 << (planes - 1 - i)) - 1
        live &= stays(of, score + (rest * down)[:, None], score + (rest * up)[:, None], live)
        if live.sum() < SPARSE * open_.size and i + 1 < planes:
            at, row = np.nonzero(live)
            return _by_pair(a, bits, at, rows[row], score[at, row], i + 1, up, down, stays)
        keep = live.any(0)
        if 0 < keep.mean() < 0.7:
            rows, live, score = rows[keep], live[:, keep], score[:, keep]
            of = of[:, : len(rows)]
    at, row = np.nonzero(live)
    return at, rows[row], score[at, row].astype(np.int64)


def _by_pair(a, bits, at, row, score, start, up, down, stays):
    planes, d = len(bits), a.shape[1]
    for i, w in list(enumerate(weights(planes)))[start:]:
        for k in range(0, len(at), PAIRS):
            s = slice(k, k + PAIRS)
            score[s] += w * np.einsum("ij,ij->i", a[at[s]], np.unpackbits(bits[i][row[s]], axis=1, count=d).astype(a.dtype))
        rest = (1 << (planes - 1 - i)) - 1
        keep = stays(at, score + rest * down[at], score + rest * up[at], None)
        at, row, score = at[keep], row[keep], score[keep]
    return at, row, score.astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: by falling score, then smaller id."""
    order = np.lexsort((other, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


class _Top:
    """The first ``k`` candidates of each of ``n`` groups so far, and the score that a new one has to reach."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.group, self.score, self.other = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        all_ = [np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.other, other))]
        keep = _best(*all_, self.k)
        self.group, self.score, self.other = (c[keep] for c in all_)
        full = np.bincount(self.group, minlength=self.n) >= self.k
        low = np.full(self.n, np.inf)
        np.minimum.at(low, self.group, self.score)
        self.least = np.where(full, low, -np.inf)


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """Of each row of a matrix its k-th largest entry, -inf where there are fewer."""
    return np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)


def _blocks(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for r in rows.itertuples():
        ids = np.frombuffer(r.ids, np.int64)
        yield r.d, ids, np.frombuffer(r.labels, np.int64), np.frombuffer(r.bits, np.uint8).reshape(r.planes, len(ids), -1)


def _chunks(anchors: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for (d, *_), same in anchors.groupby(keys, sort=False):
        for k in range(0, len(same), BLOCK_ANCHORS):
            part = same.iloc[k : k + BLOCK_ANCHORS]
            yield int(d), part, np.frombuffer(b"".join(part["x"]), np.int32).reshape(len(part), int(d)).astype(np.int64)


def _positives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, part, x in _chunks(anchors, ["d", "label"]):
            top, label, mine = _Top(len(part), k), part["label"].iat[0], part["vec_id"].to_numpy()

            def stays(at, low, high, live, top=top):
                if live is None:
                    return high >= top.least[at]
                return high >= np.maximum(top.least, _kth(np.where(live, low, -np.inf), k))[:, None]

            for e, ids, labels, bits in _blocks(rows):
                same = np.flatnonzero(labels == label)
                if e == d and len(same):
                    at, row, score = search(x, bits[:, same], mine[:, None] != ids[same], stays)
                    top.add(at, score, ids[same][row])
            out.append(pd.DataFrame({"uid": part["uid"].to_numpy()[top.group], "other": top.other, "score": top.score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("uid", "other", "score")})

    return run


def _negatives(k: int, low_share: int, high_share: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, part, x in _chunks(anchors, ["d"]):
            label, mine = part["label"].to_numpy(), part["vec_id"].to_numpy()
            most = max(len(p) for p in part["scores"])
            # of each anchor and positive the scores in question; none where an anchor has fewer positives
            least, largest = np.full((len(part), most), np.inf), np.full((len(part), most), -np.inf)
            for i, scores in enumerate(part["scores"]):
                for j, s in enumerate(scores):
                    least[i, j], largest[i, j] = -(-low_share * int(s) // 100), high_share * int(s) // 100
            top = _Top(len(part) * most, k)

            def stays(at, low, high, live, top=top, least=least, largest=largest, most=most):
                found = np.zeros(low.shape, bool)
                for j in range(most):
                    need = np.maximum(least[:, j], top.least[j::most])
                    if live is not None:
                        sure = live & (low >= least[:, j, None]) & (high <= largest[:, j, None])
                        if sure.any():
                            need = np.maximum(need, _kth(np.where(sure, low, -np.inf), k))
                    found |= (high >= need[at]) & (low <= largest[at, j])
                return found

            for e, ids, labels, bits in _blocks(rows):
                if e == d:
                    at, row, score = search(x, bits, (label[:, None] != labels) & (mine[:, None] != ids), stays)
                    for j in range(most):
                        fits = (score >= least[at, j]) & (score <= largest[at, j])
                        top.add(at[fits] * most + j, score[fits], ids[row[fits]])
            out.append(pd.DataFrame({"uid": part["uid"].to_numpy()[top.group // most], "place": top.group % most, "other": top.other, "score": top.score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("uid", "place", "other", "score")})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, vec_id, label, embedding) of one part as blocks of at most BLOCK_ROWS rows of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    part = 0

    def block(d: int) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
        bits = sliced(x)
        values = ([part], [d], [len(bits)], [ids.tobytes()], [labels.tobytes()], [bits.tobytes()])
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "d", "planes", "ids", "labels", "bits"])

    for b in batches:
        if b.num_rows:
            part = b.column("part")[0].as_py()
        ids, labels = np.asarray(b.column("vec_id")), np.asarray(b.column("label"))
        for at, x in by_length(b.column("embedding"), MOST):
            d = x.shape[1]
            while len(x):
                room = BLOCK_ROWS - sum(len(p[0]) for p in held.get(d, []))
                held.setdefault(d, []).append((ids[at[:room]], labels[at[:room]], x[:room]))
                if len(x) >= room:
                    yield block(d)
                at, x = at[room:], x[room:]
    for d in list(held):
        yield block(d)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, x in by_length(b.column("embedding"), MOST):
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("label").take(rows), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())], ["vec_id", "label", "d", "x"])


def _met(anchors: DataFrame, chunks: int, blocks: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """What ``run`` finds in each cell of anchors and rows."""
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = anchors.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int")).withColumn("part", many(parts))
    rows = blocks.withColumn("chunk", many(chunks))
    return mine.groupBy("chunk", "part").cogroup(rows.groupBy("chunk", "part")).applyInPandas(run, schema)


def hard_negatives(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the anchors of ``table`` (vec_id, label, embedding), those rows whose vec_id is divisible by ``every``, as MINED.

    An anchor's positives are its first ``positives`` rows of its label, by falling score, then smaller vec_id. For each of
    them the first ``negatives`` rows of another label count whose score is from ``low`` to ``high`` percent of the positive's.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    anchors = cut(rows.where(F.col("vec_id") % every == 0).mapInArrow(_whole, _ANCHORS).withColumn("uid", F.monotonically_increasing_id()), "mining-anchors")
    spark = table.sparkSession
    parts, chunks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / CELL_ROWS)), max(1, math.ceil(anchors.count() / CELL_ANCHORS))
    dealt = rows.repartition(parts).select(F.spark_partition_id().alias("part"), "*")
    blocks = cut(dealt.mapInArrow(_packed, _BLOCKS), "mining-planes")
    first = lambda keys, k: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other")) <= k
    near = _met(anchors, chunks, blocks, parts, _positives(positives), _FOUND)
    near = near.withColumn("_in", first(["uid"], positives)).where("_in").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "other"))).alias("p"))
    asked = cut(anchors.join(near, "uid").select("*", F.transform("p", lambda p: -p["down"]).alias("scores")), "mining-asked")
    far = _met(asked.select("uid", "vec_id", "label", "d", "x", "scores"), chunks, blocks, parts, _negatives(negatives, low, high), "uid long, place long, other long, score long")
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "other")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    chosen = F.get("p", F.col("place").cast("int"))
    out = ranked.join(asked.select("uid", F.col("vec_id").alias("anchor_id"), "p"), "uid")
    return out.select("anchor_id", chosen["other"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), (-chosen["down"]).alias("positive_score"), F.col("score").alias("negative_score"))
