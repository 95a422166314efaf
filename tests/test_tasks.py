"""Tasks are bounded by rows, and generated methods are small enough for the JVM to compile."""

import pytest
from pyspark.sql import functions as F

from logsieve.operators import classify, investigate, retry, sweep
from logsieve.plans import catalog, upkeep
from logsieve.sources.tables import cut, spread

SF = "/root/testdata/sf0.001"


def test_spread_bounds_tasks_whatever_the_row_groups(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "one"))
    out = spread(spark.read.parquet(str(tmp_path / "one")), "id", 100)
    assert out.rdd.getNumPartitions() == 50 and out.count() == 5000
    plan = out.where(F.sha2(F.col("id").cast("string"), 256) > "8")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("name", ["parse_http", "classify_verdicts", "parse_answers"])
def test_generated_methods_are_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = catalog.queries()[name](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and 0 <= min(sizes) and max(sizes) < 8000, sizes


def test_redact_json_is_dealt_like_the_log_lines(spark):
    assert catalog.queries()["redact_json"](spark, SF).rdd.getNumPartitions() == 8


@pytest.mark.parametrize("name", ["retried_events", "pipeline_counters"])
def test_generated_methods_are_compiled_at_every_cut_point(spark, name, monkeypatch):
    sizes = []

    def noted(df, *args):
        stages = df._jdf.queryExecution().debug().codegenToSeq()
        sizes.extend(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
        return cut(df, *args)

    for module in (classify, retry, upkeep):
        monkeypatch.setattr(module, "cut", noted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        noted(catalog.queries()[name](spark, SF), "result")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and 0 <= min(sizes) and max(sizes) < 8000, sizes


def test_rules_of_decisions_are_made_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(investigate, "cut", lambda df, name: names.append(name) or cut(df, name))
    catalog.queries()["evidence_decisions"](spark, SF)
    assert names == ["endpoints", "catch-alls", "evidence"]


def test_a_sweep_gives_memory_back_when_its_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(sweep, "release", lambda: given.append(1))
    assert list(sweep._pages(1)(iter([]))) == [] and given == [1]
