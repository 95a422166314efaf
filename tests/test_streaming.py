import pytest

from logsieve.streaming import limits


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, tmp_path, batches, schema, build, name):
    """All rows that the streaming query makes of the batches, one file and one trigger each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, name
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_rate_limit_keeps_state_over_batches(rocks, tmp_path):
    schema = "channel string, container string, event_id long, at double"
    batches = [[("webhook", "a", 1, 0.0), ("webhook", "a", 2, 3.0), ("webhook", "b", 3, 3.0)], [("webhook", "a", 4, 5.0), ("webhook", "a", 5, 9.9), ("email", "a", 6, 9.0)]]
    got = {r.event_id: r.allowed for r in run(rocks, tmp_path, batches, schema, limits.rate_limited, "rate")}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_investigation_does_not_extend(rocks, tmp_path):
    schema = "key string, event_id long, at double"
    batches = [[("k", 1, 1.0), ("k", 2, 5.0)], [("k", 3, 10.5), ("k", 4, 12.0), ("k", 5, 311.0)]]
    got = {r.event_id: (r.opened, r.role) for r in run(rocks, tmp_path, batches, schema, limits.investigations, "huddle")}
    assert got == {1: (1.0, "opens"), 2: (1.0, "joins"), 3: (1.0, "joins"), 4: (1.0, "late"), 5: (311.0, "opens")}


def test_anchors_in_batch(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate((1, 5, 12, 12, 30))], "key string, event_id long, at double")
    got = sorted((r.event_id, r.opened) for r in limits.anchors(rows, ["key"], F.lit(10.0)).collect())
    assert got == [(0, 1.0), (1, 1.0), (2, 12.0), (3, 12.0), (4, 30.0)]


def test_anchors_keep_fractions_and_agree_with_a_plain_fold(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [("a", 0, 0.9), ("a", 1, 5.1)] + [(r.choice(["k", "m", None]), i, round(r.uniform(0, 200), 3)) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "key string, event_id long, at double").repartition(5)
    got = {x.event_id: x.opened for x in limits.anchors(df, ["key"], F.lit(5.0)).collect()}
    assert got[0] == got[1] == 0.9
    want, opened = {}, {}
    for key, i, at in sorted(rows, key=lambda x: x[2]):
        if key not in opened or at - opened[key] >= 5:
            opened[key] = at
        want[i] = opened[key]
    assert got == want
    assert limits.anchors(df.limit(0), ["key"], F.lit(5.0)).count() == 0
