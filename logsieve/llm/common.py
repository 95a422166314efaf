"""What the operators of this subpackage share: cut points, global order, checked broadcasts, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small tables are broadcast up to this many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A key with more rows than this is joined apart from the others.
HOT_ROWS = 20_000
#: Bytes of the rows that a Python worker gets at a time while a cut point is written; Spark's own setting allows 64 MB, of which the worker, Spark and Arrow's pools each hold a copy.
ARROW_BYTES = 4 << 20
#: The characters that part words, as a class of a Java regex.
SPACE = r"[\x20\x09-\x0D]"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut points: ``spark.checkpoint.dir``. In a local session without it, as in tests, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='logsieve-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"__{base}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that what follows neither recomputes it nor depends on executors that made it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{ARROW_BYTES}b")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else as it is. Meant for narrow tables that are cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: Column, sizes: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` (cut; one row for each ``key``), keys of many rows apart.

    ``sizes`` (key, ...; cut) tells by ``hot`` which keys have so many rows that they must not meet in one task:
    those keys' rows of the table are broadcast (there are few of them, as each stands for many rows), all others
    are shuffled.
    """
    many = cut(sizes.where(hot).select(key), "hot-keys")
    if not many.limit(1).count():
        return rows.join(table, key)
    few = checked_broadcast(many)
    large = rows.join(few, key, "left_semi").join(checked_broadcast(table.join(few, key, "left_semi")), key)
    return rows.join(few, key, "left_anti").join(table, key).unionByName(large)


def in_global_order(df: DataFrame, keys: list, name: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """``df`` sorted by ``keys`` over the whole table, with ``row_index`` long (gapless from 0); its number of rows.

    The order is made by a range shuffle, so no task holds more than its range. Rows are numbered inside
    each range without a window; the ranges' row counts (one per range) are what the driver adds up.
    With ``weight``, ``weight_before`` is the sum of that column over the ranges before this row's range,
    for callers that go on to add inside the range themselves.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place), name)
    part = F.shiftright("_place", 33)
    sums = [F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).cast("long").alias("w")]
    ranges = sorted((r.part, r.n, r.w or 0) for r in ordered.groupBy(part.alias("part")).agg(*sums).collect())
    starts, n, total = [], 0, 0
    for p, rows, w in ranges:
        starts.append((p, n, total))
        n, total = n + rows, total + w
    before = spark.createDataFrame(starts or [(0, 0, 0)], "_part long, _rows long, weight_before long")
    out = ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("row_index", F.col("_rows") + F.col("_place").bitwiseAND((1 << 33) - 1))
    out = out.drop("_place", "_rows", "_part")
    return (out if weight else out.drop("weight_before")), n


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: any long ids): a row (id, component) for each id, component being its smallest id.

    Each round hands every id the smallest label among its neighbours and then follows labels one step
    (so paths halve); it ends when no label changes, and as labels only ever fall it does end. Every step is an
    equi-join or a grouped minimum, so a hub only adds to a partial aggregate. Rounds are cut into the shared folder.
    """
    both = cut(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-0")
    changed, i = 1, 0
    while changed:
        i += 1
        told = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("told"))
        near = labels.join(told, labels["id"] == told["a"], "left").select("id", "label", F.least("label", F.coalesce("told", "label")).alias("next"))
        onward = labels.select(F.col("id").alias("next"), F.col("label").alias("after"))
        moved = cut(near.join(onward, "next", "left").select("id", F.col("label").alias("was"), F.least("next", F.coalesce("after", "next")).alias("label")), f"{name}-{i}")
        changed = moved.where("was <> label").limit(1).count()
        labels = moved.select("id", "label")
    return labels.select("id", F.col("label").alias("component"))


def release() -> None:
    """Gives memory that a task no longer uses back to the system; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
