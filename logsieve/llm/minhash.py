"""Near-duplicate documents by min-max hashing of word shingles, with every link confirmed on whole sets.

Texts with one set are one class. Of a class's set, each of PERMUTATIONS permutations gives two values, the least
and the largest, so a signature of 2 P values takes P hashes of each element; both agree between two sets as often
as their Jaccard similarity says, and as they seldom fail together their mean varies less than that of 2 P minima.
Values of ROWS permutations make up a band, minima and maxima apart. Classes that share a band meet: all pairs of a
band of few classes whose sizes fit, if they meet MET times or more, and a band of many as a star on its smallest
class. What meets makes up families (as components, so no pairs of a large band are written), in which links are
confirmed exactly on the whole sets, first with the family's hub, then what misses it in tiles.

Two sets at 0.8 agree in a band with chance 0.8^5 = 0.33, so of 64 bands they share fewer than two with chance
3e-10, and less the more alike they are; that is the chance that a link is overlooked, and the only thing here that
is not exact. (With ``met`` 1 it is 9e-12, with more pairs to compare.) Sets at 0.3 share two bands with chance
0.01. No bucket, family or set is capped.

Defined results: A-Z are lower-cased; a text without words, or null, has an empty set and stands alone; one with
fewer words than the width has one element, the whole sequence; null doc_ids do not count for the smallest id of a
component; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm import ngram_join as nj
from logsieve.llm.common import HOT_ROWS, checked_broadcast, components, cut, join_spread, release

#: Values of one band, and bands: as many of minima as of maxima.
ROWS, BANDS = 5, 64
PERMUTATIONS = ROWS * BANDS // 2
#: Bands that a pair has to share.
MET = 2
#: A band of more classes joins them to a family without writing out its pairs.
LONG_BAND = 32
#: Elements that are hashed at a time, so that they stay in a core's cache.
ELEMENTS = 60_000
SIGNED = "doc_id long, n int, key binary, bands array<long>"


def _factors() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = nj._mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima (sets, PERMUTATIONS) of sets of hashes, none of them empty."""
    low, high = (np.zeros((len(sets), PERMUTATIONS), np.uint32) for _ in range(2))
    factor, shift = _factors()
    a = 0
    while a < len(sets):
        z, total = a + 1, len(sets[a])
        while z < len(sets) and total + len(sets[z]) <= ELEMENTS:
            total += len(sets[z])
            z += 1
        starts = np.cumsum([0, *[len(s) for s in sets[a : z - 1]]])
        h = (np.concatenate(sets[a:z]).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        for k in range(PERMUTATIONS):
            value = h * factor[k] + shift[k]
            if z == a + 1:
                low[a, k], high[a, k] = value.min(), value.max()
            else:
                low[a:z, k], high[a:z, k] = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
        a = z
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of bands, those of minima before those of maxima."""
    out = []
    with np.errstate(over="ignore"):
        for kind, values in enumerate((low, high)):
            for g in range(BANDS // 2):
                x = np.full(len(values), g * 2 + kind + 1, np.uint64)
                for k in range(g * ROWS, (g + 1) * ROWS):
                    x = nj._mixed(x * np.uint64(0xD6E8FEB86659FD93) + values[:, k])
                out.append(x.view(np.int64))
    return np.stack(out, axis=1)


def _signed(width: int, law: nj.Law):
    # a set below this size links to no other: one element more or less is too many
    least = law.den // (law.den - law.num) - 1 if law.num < law.den else 2**31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, nj.ROWS):
                part = b.slice(i, nj.ROWS)
                sets = nj.shingle_sets(part.column("text"), width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                large = [s for s in sets if len(s) >= max(1, least)]
                flat = band_keys(*signatures(large)).ravel() if large else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([BANDS if len(s) >= max(1, least) else 0 for s in sets])])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), bands], ["doc_id", "n", "key", "bands"])
            pa.default_memory_pool().release_unused()
        release()

    return run


def _families(reps: DataFrame, law: nj.Law, met: int) -> DataFrame:
    """Classes (cid, n, bands) that meet, as families: id, component."""
    bands = reps.select("cid", "n", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("len"), F.min("cid").alias("hub")).where("len > 1")
    sized = cut(bands.join(sizes, "band"), "minhash-bands")
    star = sized.where((F.col("len") > LONG_BAND) & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    short = sized.where(F.col("len") <= LONG_BAND)
    a, b = short.select("band", F.col("cid").alias("a"), F.col("n").alias("na")), short.select("band", F.col("cid").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") * law.den >= F.col("nb") * law.num) & (F.col("nb") * law.den >= F.col("na") * law.num)
    pairs = a.join(b, "band").where(fits).groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= met).select("a", "b")
    return cut(components(star.union(pairs), "minhash-family"), "minhash-families")


def _links(docs: DataFrame, rows: DataFrame, reps: DataFrame, law: nj.Law, width: int, met: int) -> DataFrame | None:
    """Edges that join what is linked; None where nothing meets."""
    families = _families(reps.where("size(bands) > 0").select("cid", "n", "bands"), law, met)
    if not families.limit(1).count():
        return None
    # whole sets of those that meet, from their texts again; a row that comes twice with one doc_id gives its set twice
    known = cut(reps.join(families, reps["cid"] == families["id"]).select(F.col("doc_id").alias("_id"), "key", "cid", "n"), "minhash-met")
    texts = docs.join(checked_broadcast(known.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(nj._sets(width, law, True), nj.SETS).select("doc_id", "key", "items")
    sets = found.join(checked_broadcast(known), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (found["key"] == known["key"])).select("cid", "n", "items")
    twice = rows.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1")
    sets = cut(sets.dropDuplicates(["cid"]) if twice.limit(1).count() else sets, "minhash-sets")
    return nj._verified(families, sets, law)


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, met: int = MET) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept, for sets of ``width`` words with a Jaccard of at least num / den.

    ``kept`` says that the row's doc_id is the component's smallest (rows that repeat it are kept each; where no row of a component has an id, all are).
    """
    law = nj.Law(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_signed(width, law), SIGNED).withColumn("uid", F.monotonically_increasing_id()), "minhash-docs")
    classes = cut(rows.where("n > 0").groupBy("key").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "minhash-classes")
    # all but the first row of a class leave; only their ids are joined to the bands
    again = cut(rows.where("n > 0").select("uid", "key").join(classes.select("key", "cid"), "key").where("uid <> cid").select("uid"), "minhash-again")
    reps = rows.where("n > 0").join(checked_broadcast(again), "uid", "left_anti").select(F.col("uid").alias("cid"), "doc_id", "n", "key", "bands")
    edges = _links(docs, rows, reps, law, width, met)
    rows = rows.select("doc_id", "n", "key", "uid")
    of = classes.select("key", "least_id", F.col("cid").alias("component"))
    if edges is not None:
        groups = components(edges, "minhash-component")
        of = classes.join(groups, classes["cid"] == groups["id"], "left").select("key", "least_id", F.coalesce("component", "cid").alias("component"))
    smallest = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = cut(of.join(smallest, "component").select("key", "component_id"), "minhash-found")
    alone = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    some = join_spread(rows.where("n > 0"), found, "key", F.col("rows") > HOT_ROWS, classes.select("key", "rows"))
    out = some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
