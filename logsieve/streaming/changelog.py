"""Change logs of tables: micro-batches of upserts and deletes, each counted once, with a view of what is current.

A log is a folder of Parquet with one part for each micro-batch, ``batch=<number>``. A batch that a restarted stream
delivers again replaces its part, so it counts once. The current rows are the last of each key by batch and order
inside it; a key whose last change is a delete is gone. Compaction folds a log into one batch of a new log, where the
writer goes on; batches up to that one are then passed over when they come again.

Findings of ``droppable`` verdicts may be left out of a batch that is larger than its room; others never are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a change: upsert or delete.
OP = "op"


def droppable(verdict: str = "verdict") -> Column:
    """Whether a finding may be lost under pressure: recon, allowed and suppressed ones; a null verdict is kept."""
    return F.coalesce(F.col(verdict).isin("recon", "allow", "suppress"), F.lit(False))


def shed(batch: DataFrame, room: int | None) -> DataFrame:
    """``batch`` (verdict, ...) as it is if it has at most ``room`` rows (counted) or no bound is set, else without its droppable rows."""
    return batch if room is None or batch.limit(room + 1).count() <= room else batch.where(~droppable())


def writer(path: str, *, after: int = -1, room: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a micro-batch as part of the log at ``path``; those up to ``after`` are there already and passed over."""

    def write(batch: DataFrame, number: int) -> None:
        if number > after:
            shed(batch, room).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All changes of a log, with the ``batch`` long that each came in."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def current(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key by batch and ``order`` (of equal ones, any), deletes gone; null keys are keys like others."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", order)).alias("r")).select(*keys, "r.*")
    return last.where(F.coalesce(F.col(OP), F.lit("")) != "delete").select(*[c for c in log.columns if c not in (OP, "batch")])


def compact(spark: SparkSession, path: str, into: str, schema: str, keys: list[str], order: str) -> int:
    """Writes what is current in the log at ``path`` as the one batch of the log ``into``, under the number of the last batch, which it returns; an empty log gives -1 and no batch."""
    log = changes(spark, path, schema)
    upto = log.agg(F.max("batch")).first()[0]
    if upto is None:
        return -1
    current(log, keys, order).withColumn(OP, F.lit("upsert")).write.mode("overwrite").parquet(f"{into}/batch={upto}")
    return upto
