import __spark_entry__ as entry


def test_registry():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 50


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
