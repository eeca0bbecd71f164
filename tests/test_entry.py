import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["n", "cnt"]
