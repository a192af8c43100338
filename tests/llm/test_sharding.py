import zlib

from lexmill.llm import sharding


def plain(rows, shards):
    sized = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out, slots = sum(s for _, s, _ in sized), 0, [], {}
    for i, s, c in sized:
        shard = min(shards - 1, (2 * at + s) * shards // (2 * total))
        at += s
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, s, c, shard, slots[shard]))
    return out


def test_matches_prefix_sums(spark):
    rows = [(i * 37 % 997, "é" * (i % 13) + "x" * (i * i % 211)) for i in range(500)] + [(2000, None), (2001, ""), (3, "twice"), (3, "twice"), (4000, "long" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as part", "'x' as size")
    for shards in (1, 7, 40):
        got = sorted(tuple(r) for r in sharding.balanced_shards(docs, shards, partitions=5).collect())
        assert got == sorted(plain(rows, shards))


def test_balance_and_edges(spark):
    docs = spark.createDataFrame([(i, "w" * (i % 50)) for i in range(2000)], "doc_id long, text string")
    sums = {r.shard: r.s for r in sharding.balanced_shards(docs, 10).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()}
    assert max(sums.values()) - min(sums.values()) <= 2 * 66
    assert sharding.balanced_shards(docs.limit(0), 10).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.size, r.slot) for r in sharding.balanced_shards(nulls, 1).collect()) == [(False, 16, 1), (True, 17, 0)]
