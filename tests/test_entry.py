import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 3


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
