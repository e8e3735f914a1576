import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 150


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["trace_id", "rank", "chunk_id", "doc_id", "score", "classification", "snippet"]
    assert df.count() > 0


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["latest_verdict"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan
