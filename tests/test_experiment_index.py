from lexmill.operators import experiments


def test_texts_of_a_variant_are_cut_once(spark):
    """Hits find their documents in the index; the chunks are not made again for them."""
    docs = spark.createDataFrame([(i, f"t{i}", f"# t{i}\nred fox {'word ' * 300}") for i in range(4)], "doc_id long, title string, content string")
    asked = spark.createDataFrame([(1, "t3"), (2, "none such")], "query_id long, query string")
    relevant = spark.createDataFrame([(1, 3), (2, 0)], "query_id long, doc_id long")
    cases = experiments.variant_cases(experiments.Variant("a", {"top_k": 10}), docs, asked, relevant)
    assert "EvalPython" not in cases._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: (r.recall, r.mrr, r.passed) for r in cases.collect()} == {1: (1.0, 1.0, True), 2: (0.0, 0.0, False)}
