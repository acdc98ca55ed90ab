import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["pickup_area", "revenue"] or len(df.columns) >= 2
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 130 and len(sql) >= 110


def test_queries_read_the_tables(spark):
    # A registered query's plan must scan the driver's parquet tables.
    plan = E.queries()["hourly_demand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem.parquet" in plan
