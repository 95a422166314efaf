"""Change logs count a batch once, also through a stream that starts again; what may be dropped is, and nothing else."""

from pyspark.sql import functions as F

from logsieve.streaming import changelog

SCHEMA = "k string, v int, at int, op string"


def rows(spark, path):
    return sorted(((r.k or "", r.v) for r in changelog.current(changelog.changes(spark, path, SCHEMA), ["k"], "at").collect()))


def test_replays_deletes_and_compaction(spark, tmp_path):
    log, new = f"{tmp_path}/log", f"{tmp_path}/new"
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    write = changelog.writer(log)
    write(make(("a", 1, 1, "upsert"), ("b", 1, 2, "upsert"), (None, 5, 3, "upsert")), 0)
    write(make(("a", 2, 1, "upsert"), ("b", 9, 5, "delete"), ("b", 8, 4, "upsert")), 1)
    write(make(("a", 2, 1, "upsert"), ("b", 9, 5, "delete"), ("b", 8, 4, "upsert")), 1)
    assert rows(spark, log) == [("", 5), ("a", 2)] and changelog.changes(spark, log, SCHEMA).count() == 6
    upto = changelog.compact(spark, log, new, SCHEMA, ["k"], "at")
    assert upto == 1 and rows(spark, new) == rows(spark, log) and changelog.changes(spark, new, SCHEMA).count() == 2
    write = changelog.writer(new, after=upto)
    write(make(("a", 7, 9, "upsert")), 1)  # folded already
    write(make(("b", 3, 1, "upsert")), 2)
    assert rows(spark, new) == [("", 5), ("a", 2), ("b", 3)]


def test_a_stream_that_starts_again_writes_each_batch_once(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.concat(F.lit("k"), F.col("id") % 7).alias("k"), F.col("id").cast("int").alias("v"), F.col("id").cast("int").alias("at"), F.when(F.col("id") % 9 == 4, "delete").otherwise("upsert").alias("op")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for checkpoint in ("a", "b"):  # the second time all batches come again
        q = stream.writeStream.foreachBatch(changelog.writer(log)).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {i % 7: i for i in range(30)}
    assert changelog.changes(spark, log, SCHEMA).count() == 30
    assert rows(spark, log) == sorted((f"k{k}", v) for k, v in last.items() if v % 9 != 4)


def test_only_droppable_rows_are_shed(spark):
    batch = spark.createDataFrame([(v,) for v in ("recon", "allow", "suppress", "alert", "malicious", None)], "verdict string")
    assert changelog.shed(batch, None).count() == changelog.shed(batch, 6).count() == 6
    assert {r.verdict for r in changelog.shed(batch, 5).collect()} == {"alert", "malicious", None}


def test_an_empty_log(spark, tmp_path):
    changelog.writer(f"{tmp_path}/log")(spark.createDataFrame([], SCHEMA), 0)
    assert rows(spark, f"{tmp_path}/log") == [] and changelog.compact(spark, f"{tmp_path}/log", f"{tmp_path}/new", SCHEMA, ["k"], "at") == -1
