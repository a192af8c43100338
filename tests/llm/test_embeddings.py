import numpy as np

from lexmill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.9):
    good = {i: np.array(v, np.float64) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    x = np.array([np.float32(good[i]).astype(np.float64) for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= least) & ~np.eye(len(ids), dtype=bool)
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        u, v = find(ids[a]), find(ids[b])
        root[max(u, v)] = min(u, v)
    links = dict(zip(ids, near.sum(1).tolist(), strict=True))
    return {i: (links.get(i, 0), find(i), find(i) == i) for i, *_ in rows}


def clustered(rng, n, d):
    centres = rng.normal(size=(n // 12, d))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 0.4], size=(n, 1))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    for d in (64, 12, 5, 3, 2, 1):
        x = clustered(rng, 700, d).astype(np.float32)
        rows = [(i * 3 % 701, [float(v) for v in row], i % 3) for i, row in enumerate(x)]
        rows += [(900, None, 1), (901, [0.0] * d, 1), (902, [None] + [1.0] * (d - 1), 0), (903, [float("nan")] * d, 0), (904, [float("inf")] * d, 0), (905, [], 0)]
        frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_links", "2 as strip")
        for strip_rows, group_rows in ((90, 180), (4096, 65_536)) if d > 3 else ((200, 400),):
            got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_embeddings(frame, strip_rows=strip_rows, group_rows=group_rows).collect()}
            assert got == plain(rows)


def test_one_dense_group(spark):
    rng = np.random.default_rng(5)
    x = (np.ones(64) + rng.normal(size=(900, 64)) * 0.1).astype(np.float32)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_embeddings(spark.createDataFrame(rows, SCHEMA), strip_rows=128).collect()}
    assert got == plain(rows)


def test_repeated_rows_and_lengths(spark):
    """Rows repeat, share an id or have another length; each of these sets is a group of its own."""
    a, near, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 0), (5, a, 0), (7, near, 0), (8, far, 0), (9, [1.0, 0.0], 0), (4, [2.0, 0.1], 0), (3, [-0.0, 1.0], 0), (2, [0.0, 1.0], 0), (6, [4.0], 0), (8, near, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 3, 5, True), (5, 3, 5, True), (6, 0, 6, True), (7, 3, 5, False), (8, 0, 8, True), (8, 3, 5, False), (9, 1, 4, False)]
    copies = spark.range(3000).selectExpr("id as vec_id", "array(1.0f, 2.0f) as embedding", "1 as label")
    assert {(r.n_links, r.component_id) for r in embeddings.link_embeddings(copies).collect()} == {(2999, 0)}


def test_strips_apart_are_not_compared(spark):
    """Clusters far from each other: most pairs of strips are never copied together."""
    rng = np.random.default_rng(6)
    axes = np.eye(16)
    boxes = [(axes[k] * 0.95, axes[k] * 1.05) for k in range(8)]
    lows, highs = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    assert [int((embeddings._apart(lows[k], highs[k], lows, highs) <= 0.2).sum()) for k in range(8)] == [1] * 8
    x = np.repeat(np.eye(16)[:8], 100, 0) + rng.normal(size=(800, 16)) * 0.02
    table = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA)
    classes = embeddings._valid(table, "vec_id", "embedding").selectExpr("vec_id as id", "1L as weight", "v")
    packed = embeddings._deal(classes, 16, 800, embeddings.principal_axes(classes, 16), 100).collect()
    lows, highs = (np.array([r[c] for r in packed]) for c in ("low", "high"))
    met = sum(int((embeddings._apart(a, b, lows, highs) <= 0.2).sum()) for a, b in zip(lows, highs, strict=True))
    assert met < len(packed) ** 2 / 2


def test_empty_and_null(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, None, None)], SCHEMA)
    assert sorted((r.vec_id or 0, r.n_links) for r in embeddings.link_embeddings(frame).collect()) == [(0, 0), (3, 0)]
    assert embeddings.link_embeddings(frame.limit(0)).count() == 0
