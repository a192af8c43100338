import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_keyword_search_by_documents_and_by_postings_agree(spark, monkeypatch, limit):
    """Copies, ties beyond the limit, texts without a token, and more blocks and slices than one."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(300)] + ["w1 w2 w3"] * 60 + ["", None, "--"]
    docs = spark.createDataFrame([(i * 7 % 1009, "t", t) for i, t in enumerate(texts)], "doc_id long, title string, content string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(30)] + [(99, "nothing here"), (100, None), (101, "w1 w2 w3 w1")], "query_id long, query string")
    index = retrieval.keyword_index(docs)
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 17)
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 50)
    saved = {k: v for k, v in index.items() if k != "words"}
    want = hits(retrieval.bm25(asked, saved, limit))
    assert hits(retrieval.bm25(asked, index, limit)) == want and any(r[0] == 101 for r in want)
    some = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    assert hits(retrieval.bm25(asked, index, limit, some)) == hits(retrieval.bm25(asked, saved, limit, some))


def test_vectors_and_needles_go_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3 if i % 5 else 2)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    asked = [(i, v) for i, v in vectors[:20]] + [(300, None)]

    def cosine(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = []
    for q, a in asked:
        if a is not None:
            best = sorted((-round(cosine(a, v), 9), i) for i, v in vectors if v is not None)[:4]
            want += [(q, n, i, round(-s, 8)) for n, (s, i) in enumerate(best, 1)]
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)
    found = retrieval.vector(spark.createDataFrame(asked, "query_id int, query_vector array<double>"), spark.createDataFrame(vectors, "id int, vector array<double>").repartition(3), 4)
    assert hits(found) == sorted(want)
    docs = spark.createDataFrame([(1, "abcabc"), (2, "bcd"), (3, None), (4, "")], "doc_id int, text string")
    needles = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "bc", "", "zz", "cd", "abc"] + ["x" * 90] * 3)], "query_id int, text string")
    assert sorted(tuple(r) for r in retrieval.containing(docs, "doc_id", needles, "query_id").collect()) == [(0, 1), (1, 1), (1, 2), (4, 2), (5, 1)]


def test_scores_of_many_queries_are_bounded_in_memory():
    """A task scores fewer documents at once for 40,000 queries."""
    import tracemalloc

    import pyarrow as pa

    n = 40_000
    weights = pa.table({"query_id": pa.array(range(n), pa.int64()), "term": ["t"] * n, "weight": [1.0] * n})
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([["t", "u"]] * 4 + [["u"]] * 396, pa.list_(pa.string()))], names=["id", "tokens"])
    run = retrieval._scorer(weights, 2.0, 2)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * n and peak < 200 << 20
