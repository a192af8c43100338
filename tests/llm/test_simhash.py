import random

import pyspark.sql.types as T
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import simhash
from lexmill.llm.components import connected_components

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_bit_majority():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "two Words", "É È café\x0bA b", "x " * 70_000]
    texts += [" ".join(rng.choice("aBcdE") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    for t in texts:
        assert simhash.text_fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n * 7 % 1009, " ".join(own)))
            n += 1
    rows += [(5000, None), (5001, ""), (5002, " \n")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(spark.createDataFrame(rows, DOCS)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert got == components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert len(set(got.values())) < len(got)


def test_links_within_large_groups_are_exact(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6]))) for _ in range(260)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for limit in (2, 48, 10_000):
        found = {r.node: r.component for r in connected_components(simhash.link_fingerprints(frame, limit)).collect()}
        assert {f: found.get(f, f) for f in signed} == want


def test_variants_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint becomes 64 rows that Spark sizes as one: no join of theirs may send them through the driver."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    rng = random.Random(4)
    signed = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    written = {}
    real = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.setdefault(name, df) and real(df, name))
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed + [f ^ 5 for f in signed[:50]]], "fp long"))
    for frame in (written["variants"], links):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert links.distinct().count() == 50


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "zz yy xx ww"), (None, None)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicate_components(frame).collect() if r.component_id is not None)
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert simhash.near_duplicate_components(frame).count() == 5
    assert simhash.near_duplicate_components(frame.limit(0)).count() == 0
    assert simhash.keep_one_per_component(frame).count() == 5
    assert simhash.keep_one_per_component(spark.createDataFrame([(1, "a b c d"), (2, "A b c d")], DOCS)).collect()[0].doc_id == 1


def test_long_chain_settles(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0
    assert isinstance(connected_components(edges).schema["node"].dataType, T.LongType)
