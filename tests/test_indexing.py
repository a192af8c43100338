import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval
from lexmill.operators.indexing import KeywordIndex
from lexmill.sources import tables


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, content string, approved boolean")


def state(index):
    parts = index.parts()
    return (
        sorted((r.term, r.df, round(r.idf, 9)) for r in parts["terms"].collect()),
        sorted(tuple(r) for r in parts["postings"].collect()),
        sorted(tuple(r) for r in parts["chunk_stats"].collect()),
        tuple(parts["corpus"].first()),
    )


def rebuilt(spark, path, rows):
    index = KeywordIndex(spark, path)
    index.apply(batch(spark, rows))
    return state(index)


FIRST = [(1, "a", "red fox", True), (2, "b", "red hen red", True), (3, "c", "blue", False), (4, "d", "last fox", True), (5, "", " - ", True), (None, "e", "f", True)]


def outcomes(df):
    return {r.id: r.outcome for r in df.collect()}


def test_batches_equal_a_rebuild(spark, tmp_path):
    index = KeywordIndex(spark, f"{tmp_path}/i")
    assert outcomes(index.apply(batch(spark, FIRST))) == {1: "added", 2: "added", 3: "rejected", 4: "added", 5: "empty", None: "rejected"}
    gone = spark.createDataFrame([(4,), (4,), (77,)], "id long")
    told = index.apply(batch(spark, [(1, "a", "red fox", True), (2, "b", "green", True), (3, "c", "blue", True), (6, "g", "fox fox", True)]), removed=gone)
    assert outcomes(told) == {1: "unchanged", 2: "replaced", 3: "added", 4: "removed", 6: "added", 77: "absent"}
    now = [(1, "a", "red fox", True), (2, "b", "green", True), (3, "c", "blue", True), (6, "g", "fox fox", True)]
    want = rebuilt(spark, f"{tmp_path}/r", now)
    assert state(index) == want == state(KeywordIndex(spark, f"{tmp_path}/i"))
    index.apply(batch(spark, [(4, "d", "last fox", True)]))  # comes back after it was removed
    want = rebuilt(spark, f"{tmp_path}/r2", [*now, (4, "d", "last fox", True)])
    assert state(index) == want
    assert index.apply(batch(spark, now)).where("outcome <> 'unchanged'").count() == 0 and index.manifest["version"] == 3
    index.compact()
    index.vacuum()
    assert state(index) == want == state(KeywordIndex(spark, f"{tmp_path}/i"))
    assert len(tables.Folder(spark, f"{tmp_path}/i/segments").names()) == 1
    asked = spark.createDataFrame([(9, "red fox")], "query_id long, query string")
    assert [r.id for r in retrieval.bm25(asked, index.parts()).orderBy("rank").collect()][0] == 1


def test_a_failed_batch_leaves_the_index(spark, tmp_path):
    index = KeywordIndex(spark, f"{tmp_path}/i")
    index.apply(batch(spark, FIRST))
    before, segments = state(index), tables.Folder(spark, f"{tmp_path}/i/segments").names()

    def fail():
        raise OSError("lost")

    for act in (lambda: index.apply(batch(spark, [(1, "a", "other", True)]), before_swap=fail), lambda: index.apply(batch(spark, [(8, "x", "y", True)]), before_swap=fail)):
        with pytest.raises(OSError, match="lost"):
            act()
        assert state(index) == before == state(KeywordIndex(spark, f"{tmp_path}/i"))
        assert tables.Folder(spark, f"{tmp_path}/i/segments").names() == segments


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = (KeywordIndex(spark, f"{tmp_path}/i") for _ in range(2))
    one.apply(batch(spark, FIRST))
    with pytest.raises(RuntimeError, match="another"):
        two.apply(batch(spark, [(1, "a", "other", True)]))
    assert state(KeywordIndex(spark, f"{tmp_path}/i")) == state(one)
    with pytest.raises(ValueError, match="twice"):
        one.apply(batch(spark, [(1, "a", "b", True), (1, "a", "c", True)]))


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = KeywordIndex(spark, f"{tmp_path}/i")
    assert index.apply(batch(spark, FIRST).limit(0)).count() == 0 and index.manifest["version"] == 0
    asked = spark.createDataFrame([(9, "red fox")], "query_id long, query string")
    assert retrieval.bm25(asked, index.parts()).count() == 0


def test_the_mean_weight_keeps_its_digits(spark):
    """Of a million terms, nearly all of equal weight, the mean is that of an exact sum."""
    n, rare = 100_001, 1_000_000
    counted = spark.range(rare + 1).select(F.col("id").cast("string").alias("term"), F.when(F.col("id") == rare, 100_000).otherwise(1 + F.col("id") % 3).alias("df"))
    found = retrieval.inverse_frequencies(counted, spark.createDataFrame([(n, 1.0)], "n long, mean double"))
    weight = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    exact = math.fsum([weight(100_000), *(weight(1 + i % 3) for i in range(rare))]) / (rare + 1) * retrieval.EPSILON
    assert abs(found.where("df = 100000").first().idf / exact - 1) < 2e-15


def test_terms_are_counted_where_the_document_is(spark, tmp_path, monkeypatch):
    """Terms of documents are told without a shuffle, texts of untouched documents are not cut again, and an index that is saved and loaded finds the same."""
    words = spark.createDataFrame([(1, ["b", "a", "b"], "x"), (2, [], "y"), (3, None, "z"), (4, ["c"], None)], "id long, tokens array<string>, more string")
    told = retrieval.counted(words)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.dl, None if r.terms is None else dict(zip(r.terms, r.tfs, strict=True)), r.more) for r in told.collect()}
    assert got == {1: (3, {"a": 1, "b": 2}, "x"), 2: (0, {}, "y"), 3: (None, None, "z"), 4: (1, {"c": 1}, None)}
    docs = spark.createDataFrame([(i, f"t{i}", "red fox " * (i % 3) + "hen") for i in range(40)], "doc_id long, title string, content string")
    asked = spark.createDataFrame([(9, "red fox"), (10, "hen t3"), (11, "none such")], "query_id long, query string")
    index = retrieval.keyword_index(docs)
    tables.save_index(index, f"{tmp_path}/s")
    saved = retrieval.index_of(**tables.load_index(spark, f"{tmp_path}/s"))
    by_postings = {k: v for k, v in saved.items() if k != "words"}
    hits = lambda i: sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in retrieval.bm25(asked, i, 5).collect())
    assert hits(index) == hits(saved) == hits(by_postings) != []
    batch_of = lambda: docs.select(F.col("doc_id").alias("id"), "title", "content", F.lit(True).alias("approved"))
    kept = KeywordIndex(spark, f"{tmp_path}/k")
    kept.apply(batch_of())
    assert hits(kept.parts()) == hits(index)
    cut = []
    real = retrieval.counted
    monkeypatch.setattr(retrieval, "counted", lambda w: cut.append(sorted(r.id for r in w.select("id").collect())) or real(w))
    kept.apply(batch_of().withColumn("content", F.when(F.col("id") == 7, "other").otherwise(F.col("content"))))
    assert cut == [[7]]
