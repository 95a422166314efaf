"""Self-join of documents by the Jaccard similarity of their word n-gram sets, as classes and components.

Texts with one set are one class; the join runs over classes. It is size-aware. Two small sets link exactly
when they share a subset of the size that their sizes ask for, so small sets list their subsets of each size
that a partner can ask for; all that list one subset link to the smallest of them whenever any two of them
link, so a star replaces the pairs. Pairs with a large set go by inverted lists over prefixes (two linked
sets share at least l of the first n - ceil(t n) + l elements of any common order). The boundary is the size at
which the subsets to list, counted over the sizes at hand, come to cost more than the lists' postings.

The lists are scanned twice. In the order of the elements' hashes, a class whose prefix has too few elements
that any other prefix holds has no partner and leaves; that is nearly all but near copies. For the rest the
order is by how many of them hold an element, rarest first. Classes that meet in short lists often enough, or
in a long list at all, make up families (as components, so no pairs of a long list are written out). Each
family is first compared with its hub, its smallest class: those that link to it are one component and need no
comparison with each other, so a family of near copies costs one comparison for each member. Only those that
miss their hub go on, and are compared with all of their family in tiles of two blocks of BLOCK classes, which
report each tile's components and not its pairs. Links are thus exact, of all sizes, with no cap on partners,
lists or groups.

Defined results: A-Z are lower-cased; a text without words, or null, has an empty set and stands alone; one
with fewer words than n has one element, the whole sequence; null doc_ids do not count for the smallest id
of a component; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import HOT_ROWS, checked_broadcast, components, cut, fresh, join_spread, release

#: Sets above this size are large whatever the cost: the subsets that sets list grow too fast beyond it. (Which side a set is on changes no link.)
MOST_SMALL = 20
#: What a posting costs in units of a listed subset: it is counted, joined back and sorted.
POSTING_COST = 8.0
#: A list with more classes joins them to a family without writing out its pairs. (Families are compared in the end, so this loses no link.)
LONG_LIST = 32
#: Members of a family that one copy of its hub serves.
HUB_MEMBERS = 4096
#: Classes in one side of a tile.
BLOCK = 192
#: Texts whose words are laid out at a time.
ROWS = 300
#: Elements of a tile that are compared at a time.
RANGE_ITEMS = 200_000
SETS = "doc_id long, n int, key binary, items array<long>"
_EDGES = "a long, b long"


class Law:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n):
        """ceil(t n): the least size of a partner, and the least overlap with any."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """The overlap that sizes n and m ask for."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def shared(self, n):
        """How many elements prefixes are made to share."""
        return 1 + n // 20

    def prefix(self, n):
        return min(n, n - self.least(n) + self.shared(n))

    def enough(self, n):
        """What a class of size n shares with any partner, at least."""
        m = self.least(n)
        return min(self.shared(m), m)

    def subsets(self, n):
        return sum(math.comb(n, k) for k in range(n - self.least(n) + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text its distinct shingles' hashes, ascending, as int64."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    flat = split.flatten().dictionary_encode()
    # bytes.lower() takes A-Z alone; pc.ascii_lower() is wrong on slices of an array
    words = np.array([w.encode().lower().decode() for w in flat.dictionary.to_pylist()], object)
    of = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    blank = words == ""
    which = flat.indices.to_numpy()
    h = of[which]
    real = ~blank[which] if len(which) else np.zeros(0, bool)
    if not real.all():  # white space at the ends leaves empty words
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        h = h[real]
    with np.errstate(over="ignore"):
        whole = np.zeros(len(h), np.uint64)
        for k in range(width):
            part = np.zeros(len(h), np.uint64)
            part[: max(0, len(h) - k)] = h[k:]
            whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
        out = []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a >= width:
                out.append(np.unique(whole[a : z - width + 1].view(np.int64)))
            elif z > a:
                x = np.uint64(z - a)
                for v in h[a:z]:
                    x = _mixed(np.array([x * np.uint64(0xD6E8FEB86659FD93) + v]))[0]
                out.append(np.array([x]).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def _sets(width: int, law: Law, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                sets = shingle_sets(part.column("text"), width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                held = sets if whole else [s if len(s) <= MOST_SMALL else s[: law.prefix(len(s))] for s in sets]
                items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in held])]), pa.int32()), pa.array(np.concatenate([*held, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), items], ["doc_id", "n", "key", "items"])
            pa.default_memory_pool().release_unused()
        release()

    return run


def _ratio(law: Law, n: Column) -> Column:
    return F.ceil(F.lit(law.num) * n / law.den)


def _boundary(sizes: dict[int, int], law: Law) -> int:
    """The size up to which sets are small, by cost over the numbers of classes of each size up to MOST_SMALL / t."""

    def cost(n0: int) -> float:
        lists = sum(c * law.prefix(n) for n, c in sizes.items() if n >= law.least(n0 + 1))
        return sum(c * law.subsets(n) for n, c in sizes.items() if n <= n0) + POSTING_COST * lists

    return min(range(MOST_SMALL + 1), key=cost)


def _subsets(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for cid, n, items in zip(*(b.column(c).to_pylist() for c in ("cid", "n", "items")), strict=True):
                marks = _mixed(np.array(items, np.int64).view(np.uint64)).tolist()
                total = sum(marks)
                for k in range(n - law.least(n) + 1):
                    for gone in itertools.combinations(marks, k):
                        for column, v in zip(out, (n - k, ((total - sum(gone)) % 2**64) - 2**63, n, cid), strict=True):
                            column.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["c", "subset", "n", "cid"])
        release()

    return run


def _small_links(small: DataFrame, law: Law) -> DataFrame:
    """Star edges between small classes (cid, n, items) that share a subset."""
    listed = small.mapInArrow(_subsets(law), "c int, subset long, n int, cid long")
    hub = listed.groupBy("c", "subset").agg(F.min(F.struct("n", "cid")).alias("hub"), F.count("*").alias("held")).where("held > 1")
    met = listed.join(hub, ["c", "subset"]).where(F.col("cid") != F.col("hub.cid"))
    need = F.ceil(F.lit(law.num) * (F.col("n") + F.col("hub.n")) / (law.num + law.den))
    return met.where(need <= F.col("c")).select(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).distinct()


def _tile(law: Law):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        for _, family in pdf.groupby("family", sort=False):
            cids, n = family["cid"].to_numpy(), family["n"].to_numpy()
            order = np.argsort(cids)
            cids, n = cids[order], n[order].astype(np.int64)
            items = [family["items"].to_numpy()[i] for i in order]
            both = _overlaps(items)
            linked = law.den * both >= law.num * (n[:, None] + n[None, :] - both)
            label = np.arange(len(cids))
            while True:
                new = np.where(linked, label[None, :], len(cids)).min(1)
                new = np.minimum(new, label)
                if (new == label).all():
                    break
                label = new
            edges += [(int(c), int(cids[x])) for c, x in zip(cids, label, strict=True) if c != cids[x]]
        if pdf["n"].sum() > RANGE_ITEMS:
            release()
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ascending sets, by ranges of elements."""
    if len(items) == 2:
        x = len(np.intersect1d(*items, assume_unique=True))
        return np.array([[len(items[0]), x], [x, len(items[1])]], np.int64)
    out = np.zeros((len(items), len(items)), np.int64)
    # elements are hashes in ascending order, so equal ranges of them hold nearly equal numbers
    ranges = max(1, sum(map(len, items)) // RANGE_ITEMS)
    bounds = [int(b) for b in np.linspace(-(2.0**63), 2.0**63, ranges + 1)[1:-1]]
    cuts = [[0, *np.searchsorted(x, bounds), len(x)] for x in items]
    for r in range(ranges):
        _add_overlaps(out, [x[c[r] : c[r + 1]] for x, c in zip(items, cuts, strict=True)])
    np.fill_diagonal(out, [len(x) for x in items])
    return out


def _add_overlaps(out: np.ndarray, items: list[np.ndarray]) -> None:
    """Adds the sizes of all intersections: a product of 0/1 matrices over the elements that two sets or more hold, some columns at a time."""
    flat, owner = np.concatenate(items), np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    often = held > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    at, owner = number[column[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for start in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, [start, start + 4096])
        x = np.zeros((len(items), 4096), np.float32)
        x[owner[lo:hi], at[lo:hi] - start] = 1
        out += (x @ x.T).astype(np.int64)


def _large_links(docs: DataFrame, rows: DataFrame, reps: DataFrame, law: Law, width: int, n0: int) -> DataFrame | None:
    """Edges that join what is linked among classes of which one at least is large; None where there are none."""
    lowest = max(1, law.least(n0 + 1))
    n = F.col("n")
    length = lambda n: F.least(n, n - _ratio(law, n) + 1 + F.floor(n / 20)).cast("int")
    # first scan: elements by hash
    postings = reps.where(n >= lowest).select("cid", "n", F.explode(F.slice("items", F.lit(1), length(n))).alias("h"))
    often = postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    least = _ratio(law, n)
    enough = F.least(1 + F.floor(least / 20), least)
    live = postings.join(often, "h").groupBy("cid", "n").agg(F.count("*").alias("met")).where(F.col("met") >= enough)
    live = cut(live.join(reps.select("cid", "doc_id", "key"), "cid").select("cid", "n", "doc_id", "key"), "ngram-live")
    if not live.limit(1).count():
        return None
    # whole sets of those that stay, from their texts again; a row that comes twice with one doc_id gives its set twice
    known = live.select(F.col("doc_id").alias("_id"), "key", "cid", "n")
    texts = docs.join(checked_broadcast(known.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(_sets(width, law, True), SETS).select("doc_id", "key", "items")
    sets = found.join(checked_broadcast(known), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (found["key"] == known["key"])).select("cid", "n", "items")
    twice = rows.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1")
    sets = cut(sets.dropDuplicates(["cid"]) if twice.limit(1).count() else sets, "ngram-sets")
    # second scan: rarest elements first; those of one class come before all others and take places in the prefix
    postings = sets.select("cid", "n", F.explode("items").alias("h"))
    often = postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    mine = postings.join(often, "h").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    places = length(n) - (n - F.size("x"))
    lists = mine.where(places > 0).select("cid", "n", F.explode(F.slice("x", F.lit(1), places)).alias("e")).select("cid", "n", F.col("e.h").alias("h"))
    lists = cut(lists, "ngram-lists")
    sizes = lists.groupBy("h").agg(F.count("*").alias("len"), F.min("cid").alias("hub")).where("len > 1")
    sized = cut(lists.join(sizes, "h"), "ngram-sized")
    star = sized.where((F.col("len") > LONG_LIST) & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    short = sized.where(F.col("len") <= LONG_LIST)
    a, b = short.select("h", F.col("cid").alias("a"), F.col("n").alias("na")), short.select("h", F.col("cid").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") * law.den >= F.col("nb") * law.num) & (F.col("nb") * law.den >= F.col("na") * law.num)
    pair_least = F.least(1 + F.floor(F.col("na") / 20), 1 + F.floor(F.col("nb") / 20), F.ceil(F.lit(law.num) * (F.col("na") + F.col("nb")) / (law.num + law.den)))
    met = a.join(b, "h").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met")).where(F.col("met") >= pair_least).select("a", "b")
    families = cut(components(star.union(met), "ngram-family"), "ngram-families")
    return _verified(families, sets, law)


def _verified(families: DataFrame, sets: DataFrame, law: Law) -> DataFrame:
    """Edges that join what is linked within families (id, component: the smallest id)."""
    members = families.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("members"))
    placed = families.withColumnRenamed("component", "family").join(members, "family").select(F.col("id").alias("cid"), "family", "members")
    held = sets.join(checked_broadcast(cut(placed, "ngram-placed")), "cid")
    # with the hub: a large family's hub is copied, so that its members stay spread
    salts = F.ceil(F.col("members") / HUB_MEMBERS)
    hubs = held.where("cid = family").select("family", F.col("n").alias("hub_n"), F.col("items").alias("hub_items"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    others = held.where("cid <> family").withColumn("salt", F.pmod(F.xxhash64("cid"), salts))
    both = F.size(F.array_intersect("items", "hub_items"))
    met = others.join(hubs, ["family", "salt"]).select("cid", "family", "n", "hub_n", both.alias("both"))
    linked = F.lit(law.den) * F.col("both") >= F.lit(law.num) * (F.col("n") + F.col("hub_n") - F.col("both"))
    met = cut(met.select("cid", "family", linked.alias("linked")), "ngram-hub")
    edges = met.where("linked").select(F.col("cid").alias("a"), F.col("family").alias("b"))
    # those that miss it: with all of their family, a tile at a time; their blocks come first
    open_ = met.where("NOT linked").groupBy("family").agg(F.count("*").alias("rest"))
    open_ = cut(open_.join(members, "family"), "ngram-open")
    if not open_.limit(1).count():
        return edges
    first = F.ceil(F.col("rest") / BLOCK).cast("int")
    after = F.ceil((F.col("members") - F.col("rest")) / BLOCK).cast("int")
    small = F.col("members") <= BLOCK
    mine = families.select(F.col("id").alias("cid"), F.col("component").alias("family")).join(checked_broadcast(open_), "family")
    mine = mine.join(met.where("NOT linked").select("cid", F.lit(True).alias("misses")), "cid", "left").withColumn("misses", F.coalesce("misses", F.lit(False)))
    lot = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    mine = mine.withColumn("block", F.when(small, 0).when(F.col("misses"), lot(first)).otherwise(first + lot(after)))
    with_ = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(F.col("misses"), first + after - 1).otherwise(first - 1)))
    groups = max(1, mine.count() // BLOCK)
    tile = F.when(small, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.xxhash64("family"))
    mine = mine.select("cid", "family", "block", tile.alias("tile"), F.explode(with_).alias("other"))
    mine = mine.select("cid", "family", "tile", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tiles = sets.join(mine, "cid").select("family", "cid", "n", "items", "tile", "lo", "hi")
    return edges.unionByName(tiles.groupBy("tile", "lo", "hi").applyInPandas(_tile(law), _EDGES).distinct())


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of each row: doc_id, n_shingles, component_id, key (of its set), uid (its number) and component (one for each group, null ids or not)."""
    law = Law(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_sets(width, law, False), SETS).withColumn("uid", F.monotonically_increasing_id()), "ngram-docs")
    classes = cut(rows.where("n > 0").groupBy("key").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "ngram-classes")
    # all but the first row of a class leave; only their ids are joined to the sets
    again = cut(rows.where("n > 0").select("uid", "key").join(classes.select("key", "cid"), "key").where("uid <> cid").select("uid"), "ngram-again")
    reps = rows.where("n > 0").join(checked_broadcast(again), "uid", "left_anti").select(F.col("uid").alias("cid"), "doc_id", "n", "key", "items")
    sizes = {r.n: r.c for r in reps.where(F.col("n") <= math.ceil(MOST_SMALL * den / num)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    n0 = _boundary(sizes, law)
    edges = _small_links(reps.where(F.col("n") <= n0).select("cid", "n", "items"), law)
    large = _large_links(docs, rows, reps, law, width, n0)
    groups = components(edges if large is None else edges.union(large), "ngram-component")
    of = classes.join(groups, classes["cid"] == groups["id"], "left").select("key", "least_id", F.coalesce("component", "cid").alias("component"))
    smallest = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = cut(of.join(smallest, "component").select("key", "component_id", "component"), "ngram-found")
    alone = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", "uid", (-1 - F.col("uid")).alias("component"))
    some = join_spread(rows.where("n > 0").drop("items"), found, "key", F.col("rows") > HOT_ROWS, classes.select("key", "rows"))
    return some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "key", "uid", "component").unionByName(alone)


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, for sets of ``width`` words with a Jaccard of at least num / den."""
    return _grouped(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id (rows without one come last), and all their columns. Texts without words stay.

    Only the ids of the rows that go are joined to the texts. Rows of a doc_id that stays in one place and goes in
    another, and rows without one, are told apart by their sets; of rows alike in both, one stays.
    """
    rows = cut(_grouped(docs, width, num, den).where("n_shingles > 0"), "near-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")
    keep = cut(rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "key", "uid"), rank).alias("k")).select("component", "k.*"), "near-keep")
    stay = keep.groupBy("doc_id").agg(F.count("*").alias("stay"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(stay.withColumnRenamed("doc_id", "_i"), F.col("doc_id").eqNullSafe(F.col("_i")), "left").select("doc_id", "n", F.coalesce("stay", F.lit(0)).alias("stay"))
    ids = cut(ids.where("stay < n"), "near-ids")
    goes = checked_broadcast(ids.where("stay = 0 AND doc_id IS NOT NULL").select("doc_id"))
    out = docs.join(goes, "doc_id", "left_anti").select(*docs.columns)
    mixed = ids.where("stay > 0 OR doc_id IS NULL").select("doc_id")
    if mixed.limit(1).count():
        id_, key = fresh(docs, "id"), fresh(docs, "key")
        hard = mixed.select(F.col("doc_id").alias(id_))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
        told = with_key(out.join(hard, same, "left_semi"), width, num, den, key)
        wanted = keep.select(F.col("doc_id").alias(id_), F.col("key").alias(f"{key}_of"))
        blank = told.where(F.col(key).isNull())
        kept = told.join(wanted, same & (F.col(key) == F.col(f"{key}_of")), "left_semi").dropDuplicates(["doc_id", key])
        out = out.join(hard, same, "left_anti").unionByName(kept.unionByName(blank).drop(key))
    return out


def with_key(docs: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """``docs`` with the key of their sets as the binary column ``name``; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[bytes | None] = []
            for i in range(0, b.num_rows, ROWS):
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(b.column("text").slice(i, ROWS), width)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` binary")
