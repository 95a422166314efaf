"""Which of very many known texts a line begins with or holds, at a cost that does not grow with their number.

A line's windows of the lengths that known texts have are hashed. Those that a filter of all known texts lets through
are given out as they are, to be joined with the known texts: the filter misses none, and the join drops what it let
through by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of lines that are hashed at a time (whole lines), and of windows given out at a time.
SLICE, GIVEN = 1 << 18, 8 << 20
#: Bits of the filter for each entry, and words of 64 bits that it has at least and at most (64 MB; beyond, it lets more through by chance).
ENTRY_BITS, LEAST_WORDS, MOST_WORDS = 16, 1 << 10, 1 << 23
#: Words of the filter that are put together in one task's row.
BLOCK = 1 << 10
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Of what an entry tells: a text that lines begin with, one they hold, the head of such a one.
_START, _PART, _HEAD = range(3)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, out=powers))
    return out[0], out[1]


class _Hashes:
    """Hashes of any windows of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self.inverse = _powers(1 << max(n, SLICE).bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, sizes) -> np.ndarray:
        return (self.sums[places + sizes] - self.sums[places]) * self.inverse[places]

    def every(self, size: int) -> np.ndarray:
        """Of the windows of one size at each place, in order."""
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


def _mixed(hashes: np.ndarray, kind: int, sizes) -> np.ndarray:
    """``hashes`` so that all bits tell, apart for each kind and size."""
    out = (hashes + (np.asarray(sizes).astype(np.uint64) * np.uint64(4) + np.uint64(kind))) * _MIX
    return (out ^ (out >> np.uint64(32))) * _MIX


def _word(mixed: np.ndarray, words: int) -> np.ndarray:
    return mixed >> np.uint64(65 - words.bit_length())


def _mask(mixed: np.ndarray) -> np.ndarray:
    """Four bits of a word, of which two may be the same."""
    out = np.zeros(len(mixed), np.uint64)
    for i in range(4):
        out |= np.uint64(1) << ((mixed >> np.uint64(8 + 6 * i)) & np.uint64(63))
    return out


def _heads(sizes: np.ndarray) -> np.ndarray:
    """The largest power of two that is not above a size."""
    return np.left_shift(1, np.frexp(sizes)[1].astype(np.int64) - 1)


class Filter:
    """Bits for the known texts, and their lengths: of texts that lines begin with, and by the length of their heads of texts that lines hold."""

    def __init__(self, words: np.ndarray, lengths: list[tuple[bool, int]]):
        self.words = words
        self.starts = sorted(size for start, size in lengths if start)
        self.parts: dict[int, list[int]] = {}
        for size in sorted(size for start, size in lengths if not start):
            self.parts.setdefault(1 << size.bit_length() - 1, []).append(size)

    def among(self, hashes: np.ndarray, kind: int, size: int) -> np.ndarray:
        """Numbers of the hashes that may be of a known text; none of a known text is missing."""
        mixed = _mixed(hashes, kind, size)
        first = (self.words[_word(mixed, len(self.words))] >> ((mixed >> np.uint64(8)) & np.uint64(63))) & np.uint64(1)
        found = np.flatnonzero(first)
        mixed = mixed[found]
        mask = _mask(mixed)
        return found[(self.words[_word(mixed, len(self.words))] & mask) == mask]

    def windows(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
        """Start or not, size, places in ``data`` and numbers of their lines, of the windows that pass; lines lie between ``begins`` and ``ends``, one after another."""
        hashes, n = _Hashes(data), len(data)
        for size in self.starts:
            lines = np.flatnonzero(begins + size <= ends)
            lines = lines[self.among(hashes.at(begins[lines], size), _START, size)]
            yield True, size, begins[lines], lines
        end = np.repeat(ends, ends - begins)
        for head, sizes in self.parts.items():
            if head > n:
                continue
            places = self.among(hashes.every(head), _HEAD, head)
            for size in sizes:
                fit = places[places + size <= end[places]]
                fit = fit[self.among(hashes.at(fit, size), _PART, size)]
                # of lines that begin at one place all but the last are empty
                yield False, size, fit, np.searchsorted(begins, fit, "right") - 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of the first text, bytes and borders of whole texts, SLICE bytes or one text at a time."""
    texts = texts.cast(pa.binary())
    if not len(texts):
        return
    borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + SLICE, "right")) - 1)
        yield i, data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        i = j


def _entries(words: int) -> Callable:
    """Batches of known texts (start, key) to what they set in the filter: block, word and mask."""

    def run(batches):
        for batch in batches:
            starts = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for first, data, borders in _slices(batch.column(1)):
                begins, sizes, start = borders[:-1], np.diff(borders), starts[first : first + len(borders) - 1]
                hashes, heads = _Hashes(data), _heads(sizes)
                mixed = [_mixed(hashes.at(begins[on], size[on]), kind, size[on]) for kind, on, size in ((_START, start, sizes), (_PART, ~start, sizes), (_HEAD, ~start, heads))]
                mixed = np.concatenate(mixed)
                word = _word(mixed, words).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word // BLOCK), pa.array(word % BLOCK), pa.array(_mask(mixed).view(np.int64))], ["block", "word", "mask"])

    return run


def _block(rows: pa.Table) -> pa.Table:
    """The words of a block one after another."""
    out = np.zeros(BLOCK, np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return pa.table({"block": pa.array(rows["block"].to_numpy()[:1]), "words": pa.array([out.tobytes()], pa.binary())})


def filter_of(keys: DataFrame, count: int) -> Filter:
    """The filter of ``keys`` (start, key as bytes, none empty), about ``count`` of them. Its bits are set by tasks; the driver gets its blocks."""
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (2 * count * ENTRY_BITS // 64).bit_length()))
    keys = keys.select("start", "key")
    entries = keys.mapInArrow(_entries(words), "block long, word long, mask long").groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(words, np.uint64)
    for r in entries.groupBy("block").applyInArrow(_block, "block long, words binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(bytes(r.words), np.uint64)
    return Filter(out, [tuple(r) for r in keys.select("start", F.octet_length("key")).distinct().collect()])


def _given(known: Filter, batch: pa.RecordBatch, whole: bool) -> Iterator[pa.RecordBatch]:
    """The windows of a batch of lines (_id, scope, text) that pass, each once for its line; with ``whole``, the text too."""
    for first, data, borders in _slices(batch.column(2)):
        for start, size, places, lines in known.windows(data, borders[:-1], borders[1:]):
            for i in range(0, len(places), step := max(1, GIVEN // size)):
                at = places[i : i + step]
                keys = np.lib.stride_tricks.sliding_window_view(data, size)[at]
                offsets = np.arange(0, (len(at) + 1) * size, size, dtype=np.int32)
                of, key = pa.array(lines[i : i + step] + first), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
                if not start and not np.diff(lines[i : i + step]).all():
                    once = pa.table({"line": of, "key": key}).group_by(["line", "key"], use_threads=False).aggregate([])
                    of, key = once["line"].combine_chunks(), once["key"].combine_chunks()
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.full(len(of), start)), key]
                yield pa.RecordBatch.from_arrays(columns + ([batch.column(2).take(of)] if whole else []), ["_id", "scope", "start", "key", "text"][: 5 if whole else 4])


def found(lines: DataFrame, keys: DataFrame, count: int, whole: bool = False) -> DataFrame:
    """Of ``lines`` (_id, scope, text as bytes, none null) what may be of ``keys`` (start, key; ``count`` of them): _id, scope, start, key, with ``whole`` also text.

    All keys that a text begins with (start) or holds are among them, and by chance others: windows of the text that
    are no keys. A join by key tells.
    """
    shared = lines.sparkSession.sparkContext.broadcast(filter_of(keys, count))

    def run(batches):
        for batch in batches:
            yield from _given(shared.value, batch, whole)

    return lines.select("_id", "scope", "text").mapInArrow(run, "_id long, scope string, start boolean, key binary" + (", text binary" if whole else ""))
