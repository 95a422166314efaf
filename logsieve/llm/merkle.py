"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words. DataFrame functions only.

A text is split at blank lines into sections, these at line ends into paragraphs, and these into runs of RUN
space-separated words; nothing is dropped, so different texts have different leaves. A leaf is the MD5 of its
run, a paragraph's node that of its leaves, a section's node that of its paragraphs, and the root the SHA-256
of the sections' nodes. The fingerprint names the root in full and each node by its first eight digits, in
order, so equal roots mean equal texts and the first differing branches say where an edit is. Likeness is the
Dice coefficient of the distinct leaves: 1 for equal roots, 0 where no run of words is shared.

Defined results: null text counts as empty (one section, paragraph and leaf); rows with one doc_id follow each
other by a hash of their texts; null doc_ids come last in descending order; a lone document's next is itself;
an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a leaf.
RUN = 8
#: Documents in one bucket of the doc_id order.
BUCKET_ROWS = 512
MOST_BUCKETS = 65_536


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests."""
    run = lambda words, i: F.md5(F.array_join(F.slice(words, i * RUN + 1, RUN), " "))
    leaves = lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / RUN).cast("int")), lambda i: run(words, i))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: leaves(F.split(p, " "))))


def _paragraph(leaves: Column) -> Column:
    return F.md5(F.array_join(leaves, ""))


def _section(paragraphs: Column) -> Column:
    return F.md5(F.array_join(F.transform(paragraphs, _paragraph), ""))


def root(t: Column) -> Column:
    """The root of a tree."""
    return F.sha2(F.array_join(F.transform(t, _section), ""), 256)


def fingerprint(t: Column) -> Column:
    """The tree as text: root;section=paragraph:leaf,leaf/paragraph:leaf|section=..."""
    short = lambda c: F.substring(c, 1, 8)
    paragraph = lambda p: F.concat(short(_paragraph(p)), F.lit(":"), F.array_join(F.transform(p, short), ","))
    section = lambda s: F.concat(short(_section(s)), F.lit("="), F.array_join(F.transform(s, paragraph), "/"))
    return F.concat(root(t), F.lit(";"), F.array_join(F.transform(t, section), "|"))


def leaves(print_: Column) -> Column:
    """Distinct leaves named in a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("[:,]([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    """Likeness of fingerprints ``a`` and ``b`` with those leaves."""
    dice = F.size(F.array_intersect(a_leaves, b_leaves)) * 2.0 / (F.size(a_leaves) + F.size(b_leaves))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(dice)


def differing(a: Column, b: Column) -> Column:
    """Of two fingerprints: (section, paragraph) numbers, from 0, of the paragraphs of ``a`` that differ from the one at that place in ``b`` or have none there.

    Only sections whose nodes differ are looked into.
    """
    parts = lambda f: F.split(F.substring_index(f, ";", -1), "\\|")
    inner = lambda s: F.split(F.substring_index(s, "=", -1), "/")
    theirs = parts(b)

    def within(s: Column, i: Column) -> Column:
        other = F.coalesce(F.get(theirs, i), F.lit(""))
        mine, own = inner(s), inner(other)
        places = F.transform(mine, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.coalesce(p == F.get(own, j), F.lit(False)).alias("same")))
        places = F.transform(F.filter(places, lambda x: ~x["same"]), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))
        return F.when(s == other, F.slice(places, 1, 0)).otherwise(places)

    return F.flatten(F.transform(parts(a), within))


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket``, ``guest`` and ``tie``: each bucket holds a range of the order and, as guest, the document that follows its last.

    The bounds are quantiles of doc_id; they and each bucket's first doc_id, one number for each bucket, are
    all that the driver sees. Texts are shuffled once, to their buckets.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    n = ids.count()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(n / rows)))
    bounds = []
    if buckets > 1:
        at = F.percentile_approx("key", [i / buckets for i in range(1, buckets)], F.lit(max(10_000, 20 * buckets)))
        bounds = sorted(set(ids.agg(at.alias("q")).first().q))
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    number = F.lit(0)
    if bounds:
        table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        number = lambda k: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.coalesce(F.get(table, a + s - 1) <= k, F.lit(False)), a + s).otherwise(a))
        number, of = number(key), number(F.col("key"))
    else:
        of = number
    tops = [(r.b, r.top) for r in ids.groupBy(of.alias("b")).agg(F.max("key").alias("top")).orderBy(F.desc("b")).collect()]
    ends = [(tops[(i + 1) % len(tops)][1], b, 2 if i + 1 == len(tops) else 1) for i, (b, _) in enumerate(tops)]
    firsts = spark.createDataFrame(ends, "_first long, _bucket int, _guest int").groupBy("_first").agg(F.collect_list(F.struct("_bucket", "_guest")).alias("_to"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), number.cast("int").alias("_own"))
    to = F.concat(F.array(F.struct(F.col("_own").alias("_bucket"), F.lit(0).alias("_guest"))), F.coalesce("_to", F.array().cast("array<struct<_bucket:int,_guest:int>>")))
    dealt = own.join(F.broadcast(firsts), F.col("key") == F.col("_first"), "left").select("doc_id", "text", "key", F.explode(to).alias("to"))
    return dealt.select("doc_id", "text", "key", F.col("to._bucket").alias("bucket"), F.col("to._guest").alias("guest")).repartition("bucket").withColumn("tie", F.xxhash64("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last half replaced by as much of the start of the next document in
    descending doc_id order.
    """
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "tie")
    x = with_next(docs).withColumn("fingerprint", fingerprint(tree(F.col("text"))))
    x = x.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    x = x.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(tree(F.col("edited"))).alias("edited_fingerprint")).drop("edited")
    x = x.withColumns({"a": leaves(F.col("fingerprint")), "b": leaves(F.col("edited_fingerprint")), "c": leaves(F.col("next_fingerprint"))})
    near = lambda other, held: likeness(F.col("fingerprint"), F.col(other), F.col("a"), F.col(held))
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "b").alias("near_edited"), near("next_fingerprint", "c").alias("near_next"))
