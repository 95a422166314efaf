"""Token files coded by a static range asymmetric numeral system (rANS).

A file holds segments in ascending doc_id order; a segment holds whole documents. Layout of a segment (all
numbers little-endian):

    magic "RSEG", version u16, bits u16, documents u32, symbols u32, tokens u64, blocks u32
    doc_ids i64 x documents, null flags u8 x documents, id counts u64 x documents
    symbols u32 x symbols, frequencies u32 x symbols            (the shared table; frequencies add up to 2^bits)
    checkpoints: tokens u32, lanes u32, first word u64, words u32, crc32 u32, for each block
    lane states u64 x lanes for each block, words u32

All blocks of a segment share its table. A block codes its tokens in interleaved lanes (token t is coded by
lane t mod lanes) and starts from its own states at its own word, so blocks decode in any order, apart or in
parallel; its checksum is that of its decoded ids. The container is Parquet: one row for each segment, with
the segment's CRC-32 beside it, committed by Spark's own writer.

Defined results: null text counts as empty; an empty document has the end id alone; null doc_ids come first;
rows with one doc_id stand in the order of a hash of their texts; an empty table gives no segment and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.tokens import default_path, encoder

HEAD = struct.Struct("<4sHHIIQI")
CHECKPOINT = np.dtype([("tokens", "<u4"), ("lanes", "<u4"), ("word", "<u8"), ("words", "<u4"), ("crc", "<u4")])
BLOCK, LANES = 131_072, 512
#: Ids after which a segment ends; a longer document makes a longer segment.
SEGMENT = 2_000_000
LOW = np.uint64(1 << 31)
SEGMENTS = "part int, segment int, before long, documents long, tokens long, crc32 long, data binary"
ROWS = "part int, doc_id long, start long, n_tokens long, ids binary"


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that add up to 2^bits, each at least 1, near to the share of each count (all above 0)."""
    total = 1 << bits
    share = counts / counts.sum() * total
    out = np.maximum(1, np.floor(share)).astype(np.int64)
    short = total - int(out.sum())
    if short > 0:
        order = np.argsort(out - share, kind="stable")
        out[order[: short % len(out)]] += 1
        out += short // len(out)
    while short < 0:
        order = np.argsort(-out, kind="stable")
        can = order[out[order] > 1]
        take = can[: min(-short, max(1, len(can) // 8))]
        cut = np.minimum(out[take] - 1, np.maximum(1, out[take] // 64))
        cut = np.where(np.cumsum(cut) <= -short, cut, 0)
        cut[0] = max(1, cut[0]) if short else 0
        out[take] -= cut
        short = total - int(out.sum())
    return out


def encode_block(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane states and words of the symbols (numbers into freq and cum)."""
    x = np.full(lanes, LOW, np.uint64)
    k, top, words = np.uint64(bits), np.uint64(63 - bits), []
    f_all, c_all = freq[symbols], cum[symbols]
    for at in range((len(symbols) - 1) // lanes * lanes, -1, -lanes):
        f, c = f_all[at : at + lanes], c_all[at : at + lanes]
        own = x[: len(f)]
        over = own >= (f << top)
        words.append(own[over].astype(np.uint32))
        own = np.where(over, own >> np.uint64(32), own)
        q = own // f
        x[: len(f)] = (q << k) + (own - q * f) + c
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_block(n: int, states: np.ndarray, words: np.ndarray, by_slot: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int) -> np.ndarray:
    """The block's symbols again."""
    x, lanes = states.astype(np.uint64), len(states)
    k, mask, out, at = np.uint64(bits), np.uint64((1 << bits) - 1), np.empty(n, np.int64), 0
    wide = words.astype(np.uint64)
    for i in range(0, n, lanes):
        own = x[: min(lanes, n - i)]
        slot = own & mask
        s = by_slot[slot]
        out[i : i + len(own)] = s
        own = freq[s] * (own >> k) + slot - cum[s]
        low = own < LOW
        if m := int(np.count_nonzero(low)):
            own[low] = (own[low] << np.uint64(32)) | wide[at : at + m]
            at += m
        x[: len(own)] = own
    return out


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, the place of each id among them, and how often each occurs."""
    if len(ids) and int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, which, n = _numbered(ids)
    bits = min(22, max(16, int(len(symbols)).bit_length() + 2))
    freq = quantize(n, bits) if len(n) else n
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    points, states, words, at = [], [], [], 0
    for i in range(0, len(ids), BLOCK):
        part = which[i : i + BLOCK]
        x, w = encode_block(part, f, c, bits, min(LANES, len(part)))
        points.append((len(part), len(x), at, len(w), zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes())))
        states.append(x)
        words.append(w)
        at += len(w)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(b"RSEG", 1, bits, len(doc_ids), len(symbols), len(ids), len(points)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), counts.astype("<u8").tobytes(),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array(points, CHECKPOINT).tobytes(),
        *(x.astype("<u8").tobytes() for x in states), *(w.astype("<u4").tobytes() for w in words),
    ])


class Segment:
    """A segment's index and table; its blocks decode one by one."""

    def __init__(self, data: bytes):
        magic, version, self.bits, docs, symbols, self.tokens, blocks = HEAD.unpack_from(data)
        if magic != b"RSEG" or version != 1:
            raise ValueError("not a token segment")
        self.data, self.at = data, HEAD.size
        ids, nulls, counts = self._take("<i8", docs), self._take(np.uint8, docs), self._take("<u8", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.counts = counts.astype(np.int64)
        self.symbols, freq, self.points = self._take("<u4", symbols), self._take("<u4", symbols), self._take(CHECKPOINT, blocks)
        self.freq, self.cum = freq.astype(np.uint64), (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
        self.by_slot = np.repeat(np.arange(symbols, dtype=np.int64), freq)
        lanes = self.points["lanes"].astype(np.int64)
        self.states = np.split(self._take("<u8", int(lanes.sum())), np.cumsum(lanes)[:-1]) if blocks else []
        self.words = np.frombuffer(data, "<u4", -1, self.at)

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def block(self, i: int) -> np.ndarray:
        """Ids of block i, held against its checksum."""
        p = self.points[i]
        words = self.words[int(p["word"]) : int(p["word"]) + int(p["words"])]
        ids = self.symbols[decode_block(int(p["tokens"]), self.states[i], words, self.by_slot, self.freq, self.cum, self.bits)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(p["crc"]):
            raise ValueError(f"block {i} does not have its checksum")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.points))]) if len(self.points) else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 1) -> None:
    """Encodes ``docs`` (doc_id, text), each with ``end_id`` after it, and writes their segments under ``path``.

    Texts are shuffled once, by ranges of doc_id; a task encodes its range a segment at a time.
    """
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs_, counts, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = encode_segment(docs_, np.concatenate(counts), ids)
            row = (part, number, before, len(docs_), len(ids), zlib.crc32(data), data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        with encoder(tokenizer) as enc:
            for b in batches:
                ids, n = enc.encode(b.column("text"))
                if len(end):
                    ids, n = np.insert(ids, np.cumsum(n), end[0]), n + 1
                doc, stops = b.column("doc_id").to_pylist(), np.cumsum(n)
                first = 0
                while first < len(n):
                    done = int(stops[first - 1]) if first else 0
                    # a segment ends with the document that fills it
                    last = min(len(n), int(np.searchsorted(stops, done + SEGMENT - held)) + 1)
                    docs_ += doc[first:last]
                    counts.append(n[first:last])
                    parts.append(ids[done : int(stops[last - 1])])
                    held += len(parts[-1])
                    if held >= SEGMENT:
                        yield flush()
                        before, number = before + held, number + 1
                        docs_, counts, parts, held = [], [], [], 0
                    first = last
            if docs_:
                yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    starts = spark.createDataFrame(starts or [(0, 0)], "part int, _start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in ROWS.split(", ")]
        for b in batches:
            for part, before, crc, data in zip(*(b.column(c) for c in ("part", "before", "crc32", "data")), strict=True):
                data = data.as_py()
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError("a segment does not have its checksum")
                seg = Segment(data)
                blob, ends = seg.ids().astype("<u4").tobytes(), np.cumsum(seg.counts)
                each = zip(seg.doc_ids, (ends - seg.counts).tolist(), ends.tolist(), strict=True)
                rows = [(part.as_py(), d, before.as_py() + a, z - a, blob[4 * a : 4 * z]) for d, a, z in each]
                for i in range(0, len(rows), 2000):
                    columns = zip(*rows[i : i + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    found = files.select("part", "before", "crc32", "data").mapInArrow(run, ROWS)
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("_start")).alias("start"), "n_tokens", "ids")
