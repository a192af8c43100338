import math
import random
import re
from collections import Counter

import numpy as np

from lexmill.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if absent else doc_id, -score) for r, (score, absent, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def texts(rng, count, longest=60):
    words = [f"{rng.choice('abcdeé')}{i // 3}" for i in range(400)]
    own = lambda: " ".join(words[min(399, int(rng.expovariate(1 / 60)))].upper() if rng.random() < 0.1 else words[min(399, int(rng.expovariate(1 / 60)))] for _ in range(rng.randrange(longest)))
    return [own() for _ in range(count)]


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as score").repartition(3),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id", "2 as rank"),
    )


def test_matches_scores_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    body = texts(rng, 700)
    docs = [(i * 13 % 1009, t) for i, t in enumerate(body)] + [(2000 + i, body[i % 5]) for i in range(60)] + [(None, body[3]), (None, None), (3000, ""), (3001, "-- !"), (3002, body[7] * 400), (5, body[9]), (5, body[9])]
    items = [(i, t) for i, t in enumerate(texts(rng, 90, 30))] + [(7, body[0]), (7, body[1]), (None, body[3]), (100, None), (101, " ... "), (102, "nowhere"), (103, body[7] * 400)]
    want = plain(docs, items)
    for batch, block in ((4096, 1024), (50, 20)):
        monkeypatch.setattr(ranked, "BATCH_DOCS", batch)
        monkeypatch.setattr(ranked, "BLOCK_ITEMS", block)
        monkeypatch.setattr(ranked, "DOC_LEAF", 8)
        monkeypatch.setattr(ranked, "SPLIT_BYTES", 100)
        assert sorted((tuple(r) for r in ranked.search(*tables(spark, docs, items)).collect()), key=repr) == want


def test_bounds_hold_and_prune(spark):
    rng = random.Random(12)
    weights = np.array([rng.randrange(0, 9000) for _ in range(500)], np.int64)
    items = [(i, sorted(rng.sample(range(500), rng.randrange(1, 40)))) for i in range(50)]
    tree = ranked.ItemTree.build(items, weights)
    assert sorted(tree.item_ids) == list(range(50))
    of = dict(items)
    docs = [sorted(rng.sample(range(500), 30)) for _ in range(64)]
    values = [{t: int(weights[t]) * rng.randrange(1, 10**6) for t in d} for d in docs]
    maxima = np.zeros(500, np.int64)
    for d in values:
        for t, v in d.items():
            maxima[t] = max(maxima[t], v)
    bounds = tree.leaf_bounds(maxima, np.arange(len(tree.leaf_terms)))
    for place, i in enumerate(tree.item_ids):
        assert bounds[place // ranked.ITEM_LEAF] >= max(sum(d.get(t, 0) for t in of[i]) for d in values)
    search = ranked.Search(tree, 1, np.full(50, 1 << 60))
    search.add(list(range(64)), np.repeat(np.arange(64), 30), np.array(docs).reshape(-1), np.array([v for d in values for v in d.values()], np.int64))
    assert search.scored == 0 and not any(search.best)


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("false"), items.where("false"))):
        found = ranked.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    assert ranked.search(docs, items).count() == 1
