"""Exact dedup against a historical corpus, by a minimal perfect hash over the distinct digests it holds.

The index is a table with one row for each part of the digest space. A part's keys are placed by a cascade of
bit arrays: at each level a key that is alone at its position sets that bit, the others go on to the next
level; a key's slot is the number of bits set before its own. A slot holds the full 32-byte digest and the
locator (row id and doc_id) of the row that won there, so a lookup compares all bytes: a digest outside the
index lands on some slot too, and is told apart there.

Defined results: null text counts as empty; equal texts are those that are identical after each run of white
space is one space; of equal texts the smallest doc_id stays, null doc_ids come last, and of rows that repeat
a doc_id one stays. Ids are carried as whole numbers beside a flag for null, so none is rounded or taken for
another. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import HOT_ROWS, SPACE, checked_broadcast, cut, fresh, join_spread

#: Distinct digests in one part of the index; a part is built and searched in one task.
PART_KEYS = 4096
GAMMA = 2.0
INDEX = "part long, sizes array<int>, bits binary, digests binary, blanks binary, winners binary, uids binary, counts binary"
RESOLVED = "digest binary, blank long, winner long, uid long, n long"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "), 256))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys[:, level % 4] ^ (keys[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the levels' bits, one after the other, for distinct keys (n x 4 uint64)."""
    sizes, levels, left = [], [], keys
    while len(left):
        size = max(8, math.ceil(len(left) * GAMMA))
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has a bit for it. A key outside the set may get any slot."""
    rank = np.cumsum(bits) - bits
    out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    start = 0
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = start + _positions(keys[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return out


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(pdf["digest"])
    sizes, bits = build_mph(keys)
    order = np.argsort(slots(keys, sizes, bits), kind="stable")
    put = lambda c: np.ascontiguousarray(pdf[c].to_numpy("int64")[order]).tobytes()
    row = (key[0], sizes, np.packbits(bits).tobytes(), np.ascontiguousarray(keys[order]).tobytes(), *map(put, ("blank", "winner", "uid", "n")))
    return pd.DataFrame([row], columns=["part", "sizes", "bits", "digests", "blanks", "winners", "uids", "counts"])


def build_index(distinct: DataFrame, parts: int) -> DataFrame:
    """The index over ``distinct`` (digest binary, blank long, winner long, uid long, n long, none null; digests differ)."""
    return distinct.withColumn("part", _part(parts)).groupBy("part").applyInPandas(_build, INDEX)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("long")


def _look_up(key: tuple, index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    if len(index):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        blank, winner, uid, count = (np.frombuffer(row[c], "<i8").copy() for c in ("blanks", "winners", "uids", "counts"))
    else:
        sizes, bits, held = [], np.zeros(0, bool), np.zeros((0, 4), "<u8")
        blank, winner, uid, count = (np.zeros(0, "<i8") for _ in range(4))
    parts = [([x.tobytes() for x in np.ascontiguousarray(held)], blank, winner, uid, count)]
    if len(new):
        keys = _keys(new["digest"])
        at = slots(keys, sizes, bits)
        found = np.flatnonzero(at >= 0)
        member = np.zeros(len(new), bool)
        member[found] = (held[at[found]] == keys[found]).all(axis=1)
        b, won, u, n = (new[c].to_numpy("int64") for c in ("blank", "winner", "uid", "n"))
        s, m = at[member], np.flatnonzero(member)
        count[s] += n[m]
        # rows without an id come last; then the smaller id, then the row itself
        lower = (won[m] < winner[s]) | ((won[m] == winner[s]) & (u[m] < uid[s]))
        better = (b[m] < blank[s]) | ((b[m] == blank[s]) & lower)
        blank[s[better]], winner[s[better]], uid[s[better]] = b[m][better], won[m][better], u[m][better]
        rest = np.flatnonzero(~member)
        parts.append((new["digest"].to_numpy()[rest].tolist(), b[rest], won[rest], u[rest], n[rest]))
    columns = [sum((p[0] for p in parts), []), *(np.concatenate([p[i] for p in parts]) for i in range(1, 5))]
    return pd.DataFrame(dict(zip(("digest", "blank", "winner", "uid", "n"), columns, strict=True)))


def resolve(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest of ``rows`` (uid, doc_id, digest, historical): keep_id, keep_uid, group_size.

    Historical digests go into the index; the others are first grouped by digest, so that a text that repeats a
    million times is one lookup. Members take the slot's winner unless theirs is smaller; nonmembers stand alone.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().cast("long").alias("z"), F.coalesce("doc_id", F.lit(0)).alias("d"), "uid"))
    each = lambda df: df.groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).select("digest", F.col("f.z").alias("blank"), F.col("f.d").alias("winner"), F.col("f.uid").alias("uid"), "n")
    old, new = each(rows.where("historical")), each(rows.where("NOT historical"))
    parts = max(1, math.ceil(rows.count() / PART_KEYS))
    index = cut(build_index(old, parts), "digest-index")
    found = index.groupBy("part").cogroup(new.withColumn("part", _part(parts)).groupBy("part")).applyInPandas(_look_up, RESOLVED)
    return found.select("digest", F.when(F.col("blank") == 0, F.col("winner")).alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))


def digests(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """``docs`` as (uid, doc_id, digest, historical), cut. ``history`` tells which rows are the historical corpus; without it, that is the half of the doc_id range below its middle."""
    if history is None:
        ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        history = F.col("doc_id") <= (0 if ends.a is None else (ends.a + ends.b) // 2)
    old = F.coalesce(history, F.lit(False))
    return cut(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), old.alias("historical")), "digests")


def exact_groups(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest. A text of very many rows is joined apart, so that these do not meet in one task."""
    rows = digests(docs, history)
    found = cut(resolve(rows), "digest-found")
    out = join_spread(rows, found, "digest", F.col("group_size") > HOT_ROWS, found)
    return out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "digest")


def drop_repeats(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept.

    Only the ids of the rows that go are joined to the texts, so texts are not shuffled while those ids are few
    enough to broadcast (counted first). A doc_id that stays in one row and goes in another, or a null one, is
    settled on those rows alone, by their digests.
    """
    found = cut(exact_groups(docs, history).select("doc_id", "kept", "digest"), "exact-groups")
    both = found.groupBy("doc_id").agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("n"))
    goes = checked_broadcast(cut(both.where("stay = 0 AND doc_id IS NOT NULL").select("doc_id"), "exact-goes"))
    mixed = cut(both.where("stay < n AND (stay > 0 OR doc_id IS NULL)").select("doc_id"), "exact-mixed")
    out = docs.join(goes, "doc_id", "left_anti").select(*docs.columns)
    if mixed.limit(1).count():
        id_, own = fresh(docs, "id"), fresh(docs, "digest")
        hard = mixed.select(F.col("doc_id").alias(id_))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
        told = out.join(hard, same, "left_semi").withColumn(own, digest(F.col("text")))
        keep = found.where("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(f"{own}_of"))
        told = told.join(keep, same & (F.col(own) == F.col(f"{own}_of")), "left_semi").dropDuplicates(["doc_id", own])
        out = out.join(hard, same, "left_anti").unionByName(told.drop(own))
    return out
