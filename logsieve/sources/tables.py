"""Cut points in the shared folder, and small inputs spread over the cluster."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log lines, or rows of like size, that one task works on.
TASK_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. In a local session without it, as in tests, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='logsieve-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that what follows neither recomputes it nor depends on executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions among which ``df`` (counted) has about ``rows`` rows each, but no fewer than the cluster has cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def held(condition: Column) -> Column:
    """``condition`` for a filter that stays where it is written. Moved below, it would compute what it reads once more, and before rows are dealt (the number of a row is never negative, which Spark does not know)."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``key`` among ``parts``, so that a task's work does not grow with the table, whatever the row groups of its files.

    Filters above stay above: moved below, they would be tried by the few tasks that read the files.
    """
    return df.repartition(parts(df, rows), key).where(held(F.lit(True)))


def apart(df: DataFrame) -> DataFrame:
    """``df`` with a border for generated code: expressions above and below are compiled apart, and none is moved across. Nothing is shuffled or written (a coalesce to more partitions than there are)."""
    return df.coalesce(1 << 20)


def release() -> None:
    """Gives memory that a task no longer uses back to the system; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
