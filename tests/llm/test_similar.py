import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import components, similar

DOCS = "doc_id long, text string, extra string"


def jaccard(a, b):
    a, b = (set(similar.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_pairs_of_runs_in_any_batches():
    """Every row meets the first of its run, where sizes and places allow it; rows of long runs are told once each."""
    rng = np.random.default_rng(1)
    rows = sorted((int(k), i, int(rng.integers(8, 12)), int(rng.integers(0, 3))) for k in range(12) for i in rng.choice(60, rng.integers(1, 14), replace=False).tolist())
    columns = tuple(np.array(c) for c in zip(*rows, strict=True))
    runs = {k: [r[1:] for r in rows if r[0] == k] for k in range(12)}
    want = {(i, j) for r in runs.values() for k, (j, m, b) in enumerate(r) for i, n, a in r[: min(k, 4)] if min(n - a, m - b) >= 0.8 / 1.8 * (n + m) - 1e-9}
    long = sorted((k, i) for k, r in runs.items() if len(r) > 4 for i, *_ in r)
    assert long and len(long) < len(rows) and want
    for size in (1, 3, 5, 1000):
        parts = (tuple(c[at : at + size] for c in columns) for at in range(0, len(rows), size))
        told = list(similar.pairs_of_runs(parts, 0.8, pivots=4))
        assert {(int(a), int(b)) for kind, u, v, *_ in told if not kind for a, b in zip(u, v, strict=True)} == want
        assert sorted((int(a), int(b)) for kind, u, v, *_ in told if kind for a, b in zip(u, v, strict=True)) == long


def test_sketches_exclude_no_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, rng.integers(1, 3000)).astype(np.uint64)
        b = np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 62, rng.integers(0, 50)).astype(np.uint64)))
        x, y = similar.parity_sketch(np.unique(a)), similar.parity_sketch(np.unique(b))
        short = min(len(x), len(y))
        apart = np.bitwise_count((similar.folded(x, short) ^ similar.folded(y, short)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b)) and (len(a) > 1024) == (len(x) > similar.RUN_WORDS)


def test_near_copies_are_found_and_clean_texts_stay(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, copies = [], []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // 80)):
            other[at] = rng.choice(words)
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join(other), None)]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.85:
            copies.append(k)
    base = [rng.choice(words) for _ in range(200)]
    crowd = range(1000, 1100)
    for i in crowd:
        own = list(base)
        own[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(own), "x"))
    rows += [(2000, None, None), (2001, "", None), (2002, "one two", None), (2003, "One  two", None), (2003, "One  two", None), (None, "one two", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    assert len(copies) >= 40 and sum(got[2 * k + 1] == 2 * k for k in copies) >= 0.9 * len(copies)
    assert all(got[2 * k + 1] in (2 * k, 2 * k + 1) and got[2 * k] == 2 * k for k in range(60))
    assert {got[i] for i in crowd} == {1000}
    assert got[2001] == 2000 and got[2003] == 2002 and got[2002] == 2002
    kept = [r.doc_id for r in similar.keep_one_of_similar(docs).collect()]
    assert kept.count(None) == 1 and 2003 not in kept and 1000 in kept and 1001 not in kept


def test_empty_table(spark):
    assert similar.similar_components(spark.createDataFrame([], DOCS)).collect() == []


def test_thinned_edges_keep_components(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.5] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    monkeypatch.setattr(components, "FOREST_EDGES", 100)
    thin = components.thin_edges(spark.createDataFrame(edges, "u long, v long"))
    assert thin.count() < len(edges) // 2
    got = {r.node: r.component for r in components.connected_components(thin).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 100}


def test_bits_apart_in_columns(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(40):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(900, 2600)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: len(a) * 9 // 10], rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64))))
        x, y = similar.parity_sketch(a), similar.parity_sketch(b)
        short = min(len(x), len(y))
        want.append(int(np.bitwise_count((similar.folded(x, short) ^ similar.folded(y, short)).view(np.uint64)).sum()))
        rows.append((k, x.tolist(), y.tolist()))
    frame = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    assert [r.d for r in frame.select("k", similar._bits_apart(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()] == want
    assert len({len(r[1]) for r in rows}) > 1


def test_every_pair_of_a_long_run_meets_or_is_joined():
    keys, node = np.repeat(np.arange(3), 40), np.tile(np.arange(40), 3)
    n, sketch = np.full(120, 10), np.zeros((120, similar.RUN_WORDS), np.uint64)
    sketch[node == 7] = np.uint64(0xFFFFFFFF)
    n[node == 9] = 13
    for label in (np.arange(40), np.arange(40) // 10):
        want = {(a, b) for a in range(40) for b in range(a + 1, 40) if label[a] != label[b] and not {a, b} & {7, 9}}
        for size in (7, 50, 120):
            parts = [(keys[at : at + size], node[at : at + size], np.tile(label, 3)[at : at + size], n[at : at + size], 0 * n[at : at + size], sketch[at : at + size]) for at in range(0, 120, size)]
            assert [len(set(k.tolist())) * 40 for k, *_ in similar.whole_runs(parts)] == [len(k) for k, *_ in similar.whole_runs(parts)]
            assert {(int(a), int(b)) for u, v in similar.pairs_apart(parts, 0.8) for a, b in zip(u, v, strict=True)} == want


def test_links_beyond_the_first_of_a_long_run(spark, monkeypatch):
    """Unlike texts in one run: each has its copy somewhere behind the members that all are paired with."""
    monkeypatch.setattr(similar, "_first_keys", lambda classes: classes.selectExpr("0L as key", "node", "cast(n as int) as n", "0 as at"))
    monkeypatch.setattr(similar, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join([*base[:-1], "other"]), None)]
    got = {r.doc_id: r.component_id for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_links_are_those_of_exact_similarity(spark):
    """Short texts and pairs about 0.8."""
    rng, rows = random.Random(12), []
    for k in range(150):
        base = [f"w{rng.randrange(9000)}" for _ in range(10 if k % 3 == 0 else rng.randint(20, 150))]
        other = list(base)
        for at in [len(base) - 1] if k % 3 == 0 else rng.sample(range(len(base)), max(1, len(base) // rng.randint(35, 60))):
            other[at] = f"v{rng.randrange(9000)}"
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join(other), None)]
    want = {2 * k + 1: 2 * k if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 else 2 * k + 1 for k in range(150)}
    got = {r.doc_id: r.component_id for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id % 2}
    assert 40 < sum(v % 2 for v in want.values()) < 110
    assert got == want


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(3)
    common = np.arange(0, 400, 3, dtype=np.uint64), rng.integers(4, 9, 134)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: rng.integers(1, len(a) + 1)], rng.integers(0, 400, rng.integers(0, 8)).astype(np.uint64))))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(similar.first_shingles(a, 0.8, common), similar.first_shingles(b, 0.8, common)))


def test_pairs_of_a_long_run_are_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(similar, "TOLD_PAIRS", 1000, raising=False)
    n = 300
    rows = (np.zeros(n, np.int64), np.arange(n), np.arange(n), np.full(n, 10), np.zeros(n, np.int64), np.zeros((n, similar.RUN_WORDS), np.uint64))
    parts = list(similar.pairs_apart(iter([rows]), 0.8))
    assert max(len(u) for u, _ in parts) < 1000 + n
    assert {(a, b) for u, v in parts for a, b in zip(u.tolist(), v.tolist(), strict=True)} == {(a, b) for b in range(n) for a in range(b)}


def test_fingerprint_variants_link_close_copies(spark, monkeypatch):
    """Without the exact step: SimHash variants link copies that differ in a word, and no pair below the similarity."""
    monkeypatch.setattr(similar, "_first_keys", lambda classes: classes.selectExpr("0L as key", "node", "cast(n as int) as n", "0 as at").where("false"))
    rng, rows = random.Random(21), []
    for k in range(60):
        base = [f"w{rng.randrange(9000)}" for _ in range(300)]
        other = list(base)
        for at in rng.sample(range(300), 1 if k < 30 else 12):
            other[at] = "other"
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join(other), None)]
    far = [k for k in range(30, 60) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 0.8]
    got = {r.doc_id: r.component_id for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 120 and far
    assert all(got[2 * k + 1] == 2 * k for k in range(30))
    assert all(got[2 * k + 1] == 2 * k + 1 for k in far)


def test_set_fingerprint_is_the_bit_majority():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 600, 40_000):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        got = np.unpackbits(similar.set_fingerprint(hashes).view(np.uint8))
        assert len(got) == similar.SEGMENTS * similar.SEGMENT_BITS == 64 * similar.PRINT_WORDS
        alone = [np.unpackbits(similar.set_fingerprint(h[None]).view(np.uint8)) for h in hashes[:600]]
        if n <= 600:
            assert got.tolist() == (2 * np.sum(alone, axis=0) > n).tolist() if n else not got.any()


def test_pairs_of_variants_are_those_within_a_bit_of_a_segment():
    rng = np.random.default_rng(7)
    bits = np.repeat(rng.integers(0, 2, (12, 192)), 4, axis=0)
    bits ^= rng.random(bits.shape) < rng.choice([0, 0.02, 0.1, 0.16], (48, 1))
    prints, n = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64), rng.integers(80, 110, 48)
    key, bit, beside = similar.segment_variants(prints)
    assert key.min() >= 0 and bit.tolist() == bits.tolist()
    rows = sorted((int(key[i, j]), i, int((n[i] * 2 + bit[i, j]) << 32 | beside[i, j])) for i in range(48) for j in range(192))
    columns = tuple(np.array(c) for c in zip(*rows, strict=True))

    def meets(a, b):
        apart = bits[a] ^ bits[b]
        near = [s for s in range(8) if apart[24 * s : 24 * s + 24].sum() <= 1 and np.roll(apart, -24 * (s + 1))[:32].sum() <= 10]
        return bool(near) and min(n[a], n[b]) >= 0.8 * max(n[a], n[b]) - 1e-9

    want = {(a, b) for b in range(48) for a in range(b) if meets(a, b)}
    assert 30 < len(want) < 48 * 47 // 2
    for size in (1, 5, 100, len(rows)):
        parts = (tuple(c[at : at + size] for c in columns) for at in range(0, len(rows), size))
        assert {(int(a), int(b)) for u, v in similar.pairs_of_variants(parts, 0.8, pivots=48) for a, b in zip(u, v, strict=True)} == want
