from pyspark.sql import functions as F

from lexmill.operators import lifecycle

DOCUMENT = "document_id int, title string, publish_date date, issuing_authority string, document_number string, region string, document_type string, version int, index_status string, final_status string"


def test_edits_make_versions(spark):
    docs = spark.createDataFrame([(i, "t", None, "a", None, "r", "d", 1, "indexed", "approved") for i in (1, 2, 3, 4)], DOCUMENT)
    edits = spark.createDataFrame([(1, "title", "u", 1), (1, "title", "v", 2), (1, "region", "r", 1), (1, "content", "x", 1), (2, "issuing_authority", None, 1), (2, "publish_date", "2024-05-01", 1), (3, "title", "t", 1), (9, "title", "z", 1)], "document_id int, field string, value string, seq int")
    after, versions = lifecycle.edit_documents(docs, edits, spark.createDataFrame([(2,)], "document_id int"))
    told = {r.document_id: r for r in after.collect()}
    assert [(told[i].title, told[i].version, told[i].index_status) for i in (1, 2, 3, 4)] == [("v", 2, "stale"), ("t", 2, "stale"), ("t", 1, "indexed"), ("t", 1, "indexed")]
    assert told[2].issuing_authority is None and str(told[2].publish_date) == "2024-05-01"
    rows = {(r.document_id, r.version): (r.changed_fields, r.metadata) for r in versions.collect()}
    assert rows == {
        (1, 1): ([], '{"title":"t","issuing_authority":"a","region":"r","document_type":"d"}'),
        (1, 2): (["title"], '{"title":"v","issuing_authority":"a","region":"r","document_type":"d"}'),
        (2, 2): (["publish_date", "issuing_authority"], '{"title":"t","publish_date":"2024-05-01","region":"r","document_type":"d"}'),
    }
    points = spark.range(1, 6).select(F.col("id").alias("point_id"), F.col("id").cast("int").alias("document_id"))
    assert sorted(r.point_id for r in lifecycle.valid_points(points, after).collect()) == [3, 4]


def test_admission(spark):
    columns = spark.createDataFrame([(1, True, True, "local", None), (2, True, True, "coze", "legacy_single_article"), (3, False, True, "coze", None), (4, True, None, "coze", None), (5, True, True, "coze", None)], "column_id int, enabled boolean, source_enabled boolean, crawl_provider string, contract_mode string")
    requests = [(1, 1, None, None), (2, 1, None, "legacy_single_article"), (3, 2, None, None), (4, 2, None, "batch_crawl"), (5, 3, None, None), (6, 4, None, None), (7, 9, None, None), (8, 5, "playwright", None), (9, 2, "local", None), (10, 5, None, None), (11, 5, "other", "x")]
    told = {r.request_id: (r.refusal, r.provider, r.contract) for r in lifecycle.admit(spark.createDataFrame(requests, "request_id int, column_id int, provider string, contract string"), columns).collect()}
    assert told == {
        1: (None, "local", "batch_crawl"), 2: ("LOCAL_CONTRACT_UNSUPPORTED", None, None), 3: ("COZE_LEGACY_SINGLE_ARTICLE_ONLY", None, None), 4: (None, "coze", "batch_crawl"), 5: ("SOURCE_DISABLED", None, None), 6: ("SOURCE_DISABLED", None, None),
        7: ("NOT_FOUND", None, None), 8: ("CRAWL_PROVIDER_NOT_IMPLEMENTED", None, None), 9: (None, "local", "batch_crawl"), 10: (None, "coze", "batch_crawl"), 11: (None, "other", "x"),
    }


def test_merged_failures_equal_their_sql_for_large_supplier_keys(spark, tmp_path):
    """The last line counts by part, then supplier, whatever the keys' sizes; the message names its part."""
    import duckdb

    import __spark_entry__

    rows = [(1, 3, 12_345, 1, "N"), (1, 6, 5, 1, "N"), (1, 3, 400_000, 3, "N"), (2, 3, 99_995, 1, "A"), (2, 9, 10, 3, "A"), (2, 3, 123_455, 1, "N")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").withColumn("l_shipdate", F.lit("1996-01-01").cast("timestamp"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    told = sorted(tuple(r) for r in __spark_entry__.queries()["merged_failures"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert told == sorted(db.sql(__spark_entry__.oracle_sql()["merged_failures"]).fetchall())
    assert {r[0]: r[4] for r in told} == {1: "m6", 2: "m3"}


def test_citations_are_not_gathered_by_answer(spark):
    from lexmill.registry import queries

    told = queries()["answer_lineage"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in told._jdf.queryExecution().optimizedPlan().toString()
