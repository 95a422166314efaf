"""Mixing sources to target weights by Poisson replication.

Each source s has a mean repetition rate r = total x weight / rows of s. A document's number of copies is the
inverse of the Poisson distribution function with mean r at a uniform number hashed from (seed, doc_id, text),
so it depends on nothing but the row and its rate: no state, no order, the same on every replay. Means over
STEP are split into equal independent draws that are added up. Copies are dealt by the hash of (seed, row,
copy) and sorted by it, which is the global shuffle.

Defined results: a null source is a source of its own; null text draws as empty; rows alike in doc_id and text
draw alike; a source whose weight is 0 or missing goes; an empty table gives an empty result. Extra columns
are kept; ``copy_no`` and ``mix_key`` are added and replace columns of those names, and names that start with
``__mix_`` are this operator's own and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import checked_broadcast, cut

STEP = 32.0
#: Terms of the distribution function: beyond them, at a mean of STEP, less than 1e-16 is left.
TERMS = 128
SALTS = 64


def uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_table(mean: Column) -> Column:
    """Distribution function of a Poisson number with that mean (at most STEP) at 0, 1, ... TERMS - 1."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + acc["p"] * mean / k)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), zero, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, budget: float = 1.0) -> DataFrame:
    """Of each source: source_key, rate (mean copies of its documents), draws, table.

    ``weights`` are relative target shares by source; without them a source's share is its row count to the
    power ``temper``. The expected number of rows out is ``budget`` times that of rows in.
    """
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.count("*").alias("n"))
    n = cut(n, "source-rows")
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        share = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source_key string, w double")
        n = n.join(share, "source_key", "left").fillna(0.0, ["w"])
    total = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rate = F.lit(budget * (total.n or 0)) * F.col("w") / (F.lit(total.w or 1.0) * F.col("n"))
    n = n.select("source_key", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    return cut(n.withColumn("table", poisson_table(F.col("rate") / F.col("draws"))), "source-rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, budget: float = 1.0, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with each row as many times as its draw says, shuffled; adds copy_no int and mix_key string.

    The rates have a row for each source. They are broadcast if counted few enough; else the join is dealt by
    source and a salt, so that a source with a third of all rows is spread over SALTS tasks.
    """
    columns = [c for c in docs.columns if c not in ("copy_no", "mix_key") and not c.startswith("__mix_")]
    rows = docs.select(*columns).withColumns({"__mix_source": F.coalesce("source", F.lit("")), "__mix_row": F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    table = rates(docs, weights, temper, budget).select(F.col("source_key").alias("__mix_source"), F.col("draws").alias("__mix_draws"), F.col("table").alias("__mix_table"))
    few = checked_broadcast(table, 20_000)
    if few is not table:
        rows = rows.join(few, "__mix_source")
    else:
        salted = table.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__mix_salt", F.pmod(F.xxhash64("__mix_row"), F.lit(SALTS)).cast("int")).join(salted, ["__mix_source", "__mix_salt"]).drop("__mix_salt")
    draw = lambda i: F.size(F.filter("__mix_table", lambda c: c <= uniform(F.lit(seed), "__mix_row", i.cast("string"))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("__mix_draws")), F.lit(0), lambda n, i: n + draw(i))
    made = rows.withColumn("__mix_copies", copies).where("__mix_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    made = made.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("__mix_row"), F.lit("copy"), F.col("copy_no").cast("string"))))
    return made.select(*columns, "copy_no", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
