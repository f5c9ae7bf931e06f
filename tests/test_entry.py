import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    df = entry.entry(spark)
    assert df.count() > 0 and "query_id" in df.columns
