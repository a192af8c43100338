import math
import random

from lexmill.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ala", "emo", "iru", "onk", "upe", "ast", "ill", "ord")]
    common = ["the", "of", "and", "to", "is"]
    some = lambda n: [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) + rng.choice(["", "x", "y", "z"]) for _ in range(n)]
    items = [(k, some(rng.randint(8, 70))) for k in range(40)]
    docs = []
    for i in range(120):
        words = some(rng.randint(0, 500))
        if i % 4 == 0:
            own = list(items[i % 40][1])
            if i % 8 == 0 and len(own) > 40:
                own[len(own) // 3] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own if i % 12 else own[: len(own) // 2]
        docs.append((i, " ".join(words).capitalize() + "."))
    return docs, [(k, " ".join(w)) for k, w in items]


def plain(docs, items, threshold, overlap):
    """Every passage against every item."""
    worded = [(k, D.words_of(t)) for k, t in items if D.words_of(t)]
    n, mean = len(worded), sum(len(w) for _, w in worded) / len(worded)
    df = {}
    for _, w in worded:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    half = max(D.PASSAGE_WORDS, 2 * (max(len(w) for _, w in worded) + 1)) // 2
    out = set()
    for i, t in docs:
        words = D.words_of(t)
        starts = [0] if len(words) <= 2 * half else range(0, half * (-(-len(words) // half) - 1), half)
        for start in starts:
            passage = words[start : start + 2 * half]
            grams = {tuple(passage[k : k + 5]) for k in range(len(passage))}
            for k, w in worded:
                weight = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
                if sum(v for x, v in weight.items() if x in passage) / sum(weight.values()) < threshold:
                    continue
                q, a = D.split_item(w)
                if len(q & grams) + len(a & grams) >= overlap * (len(q) + len(a)) and q & grams and (a & grams or not a):
                    out.add((i, k))
    return out


def test_matches_brute_force(spark):
    docs, items = corpus()
    found = D.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == plain(docs, items, D.THRESHOLD, D.OVERLAP)
    assert len(got) >= 20 and found.count() == len(got)


def test_search_scores_everything_above_threshold():
    docs, items = corpus(5)
    worded = [D.words_of(t) for _, t in items]
    df = {x: sum(x in w for w in worded) for w in worded for x in w}
    index = D.ItemIndex.build(list(range(len(items))), worded, df, len(items), sum(map(len, worded)) / len(worded), 142)
    for _, t in docs[:40]:
        words = D.words_of(t)
        scored = {}
        last = max(0, -(-len(words) // 71) - 2)
        for p in range(last + 1):
            passage = set(words[71 * p : 71 * p + 142])
            for k in range(len(items)):
                s = sum(w for x in passage if x in index.terms for i, w in zip(index.post_item[index.post_at[index.terms[x]] : index.post_at[index.terms[x] + 1]], index.post_weight[index.post_at[index.terms[x]] : index.post_at[index.terms[x] + 1]], strict=True) if i == k)
                if s >= 0.2:
                    scored[71 * p, k] = s
        got = {(a, b): s for a, b, s in index.search(words, 0.2)}
        assert got.keys() == scored.keys()
        assert all(abs(got[k] - scored[k]) < 1e-9 for k in got)


def test_edges(spark):
    docs, items = corpus()
    rows = spark.createDataFrame([*docs[:9], docs[4], (None, items[3][1]), (800, None), (801, ""), (802, items[5][1] * 3)], DOCS).selectExpr("*", "'x' as item_id", "0 as score")
    tests = spark.createDataFrame([*items, (None, "a b c"), (70, None), (71, ""), (72, items[3][1])], ITEMS)
    got = sorted((r.doc_id or -1, r.item_id) for r in D.find_leaks(rows, tests).collect())
    assert [(i, k) for i, k in got if i == -1] == [(-1, 3), (-1, 72)]
    assert got.count((4, 4)) == 2
    assert D.find_leaks(rows, tests.limit(0)).count() == 0
    assert D.find_leaks(rows.limit(0), tests).count() == 0
    kept = {r.doc_id for r in D.drop_leaking(rows, tests).collect()}
    assert 4 not in kept and {800, 801, 1}.issubset(kept)


def test_null_ids_and_rows_with_one_id(spark):
    docs, items = corpus()
    rows = spark.createDataFrame([(None, items[3][1]), (None, "a clean text"), (7, items[4][1]), (7, "another clean text"), (8, items[6][1])], DOCS)
    tests = spark.createDataFrame([*items[:6], (None, items[6][1])], ITEMS)
    got = [(r.doc_id, r.item_id) for r in D.find_leaks(rows, tests).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (7, 4), (8, None)], key=str)
    assert sorted(r.text for r in D.drop_leaking(rows, tests).collect()) == ["a clean text", "another clean text"]


def test_a_long_item_makes_no_other_passage_long(spark):
    """Items of very different lengths are each found, in passages of their own class."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(1, " ".join(word() for _ in range(20))), (2, " ".join(word() for _ in range(150))), (3, " ".join(word() for _ in range(2500)))]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{filler(300)} {text} {filler(700)}") for i, text in items] + [(9, filler(3000))]
    got = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 3)]
