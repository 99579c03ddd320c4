"""Driver contract smoke test and registry shape."""


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_query_has_unique_name():
    import __spark_entry__ as e
    q = e.queries()
    assert len(q) == len(set(q)) and len(q) > 80
