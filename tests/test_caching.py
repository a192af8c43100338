from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.operators import caching

START = datetime(2024, 1, 1)


def test_replay_serves_in_order(spark):
    def row(key, seconds, ident, kept=True):
        return (key, START + timedelta(seconds=seconds) if seconds is not None else None, ident, kept)

    rows = [
        row("a", 0, 1), row("a", 0, 2), row("a", 9.999, 3), row("a", 10, 4), row("a", 69.9, 5), row("a", 70, 6), row("a", 75, 7),
        row("b", 0, 8, False), row("b", 5, 9), row("b", 10, 10), row("b", 25, 11),
        row("c", 0, 12, None), row("c", 11, 13), row(None, 0, 14), row(None, 0, 15), row("c", None, 16),
    ]
    df = spark.createDataFrame(rows, "key string, ts timestamp, request_id long, kept boolean").repartition(3)
    told = {r.request_id: r.outcome for r in caching.replay(df, 10, 60).collect()}
    want = "miss coalesced coalesced hit hit expired coalesced miss coalesced miss hit miss miss miss miss miss".split()
    assert [told[i] for i in range(1, 17)] == want
    assert caching.replay(df.limit(0), 10, 60).count() == 0


def test_keys_and_vectors(spark):
    df = spark.createDataFrame([("q",), (None,)], "text string")
    one = lambda **k: df.select(caching.cache_key(**({"provider": "p", "model": "m", "endpoint": "e", "version": "v1"} | k), text=F.col("text"))).collect()
    assert one()[0][0] != one(version="v2")[0][0] != one(endpoint="f")[0][0] and one()[1][0] is None
    assert one()[0][0].startswith("query-embedding:p:m:") and "e" != one()[0][0].split(":")[3]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0, float("nan")],), ([1.0, None],), ([float("inf"), 1.0],), (None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(caching.usable_vector(F.col("v"), 2)).collect()] == [True, False, False, False, False, False, False]
    assert [r[0] for r in vectors.select(caching.usable_vector(F.col("v"))).collect()] == [True, False, False, False, False, False, True]
