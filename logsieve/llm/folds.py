"""Folds by doc_id and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is a multiple of FOLDS. A null doc_id counts as the empty text, which is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sampled(df: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ``df`` (doc_id, ...), those with the smallest hashes of their doc_id; all of them if they are fewer."""
    return df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def labelled(labels: DataFrame, column: str, most: int, seed: int = 3) -> DataFrame:
    """Up to ``most`` training rows (doc_id, label) for each value, 0 and 1, of ``column``. A doc_id with both values, or none, is left out."""
    value = F.col(column).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & value.isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(value).alias("label"), F.max(value).alias("_most")).where("label = _most").drop("_most")
    return sampled(one.where("label = 0"), most, seed).unionByName(sampled(one.where("label = 1"), most, seed))
