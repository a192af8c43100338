import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import fingerprints
from lexmill.llm.fingerprints import Digest, Piece

W = fingerprints.WINDOW
WORDS = ["alpha", "beta", "ten", "of", "and", "río", "the", "qu", "einer", "0x7f", "été", "zz", "=-"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "."]) for _ in range(n))


def plain_entropy(window):
    total = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())
    whole = fingerprints.WINDOW * round(math.log2(fingerprints.WINDOW)) << 20
    return 1000 * (whole - total) // whole


def plain_features(data, ranks):
    w, run = fingerprints.WINDOW, fingerprints.RUN
    rank = [ranks[plain_entropy(data[i : i + w])] for i in range(len(data) - w + 1)]
    votes = Counter()
    for start in range(-run + 1, len(rank)):
        held = [(rank[i], i) for i in range(max(0, start), min(len(rank), start + run)) if rank[i] >= 0]
        if held:
            votes[min(held)[1]] += 1
    return sorted(i for i, n in votes.items() if n >= fingerprints.POPULAR)


@pytest.fixture(scope="module")
def ranks():
    rng = np.random.default_rng(5)
    told = rng.permutation(fingerprints.BINS)
    told[: fingerprints.LOW] = -1
    return told


def test_entropies_and_features_match_plain_counts(ranks, monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n).encode() for n in (0, 1, 6, 7, 12, 40, 300)] + [b"a" * 90, b"ab" * 60, b"-" * 40 + prose(rng, 9).encode() + b"-" * 40]
    for t in texts:
        assert fingerprints.entropies(np.frombuffer(t, np.uint8)).tolist() == [plain_entropy(t[i : i + W]) for i in range(len(t) - W + 1)]
    want = [plain_features(t, ranks) for t in texts]
    whole = [Piece(t, 0, max(0, len(t) - W + 1)) for t in texts]
    for step in (64, 257, 1 << 20):
        monkeypatch.setattr(fingerprints, "STEP_BYTES", step)
        found = fingerprints.features(whole, ranks)
        assert [f[0].tolist() for f in found] == want
        again = fingerprints.features(list(reversed(whole)), ranks)
        assert all(np.array_equal(a[1], b[1]) for a, b in zip(found, reversed(again), strict=True))


def test_statistics_cover_every_window(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (3, 30, 90, 200)] + [None, "", "short"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = Counter(plain_entropy(t.encode()[i : i + W]) for t in texts if t for i in range(len(t.encode()) - W + 1))
    order = sorted(range(fingerprints.BINS), key=lambda b: (counts[b], b))
    assert fingerprints.fit(docs).tolist() == [-1 if b < fingerprints.LOW else order.index(b) for b in range(fingerprints.BINS)]
    assert len(fingerprints.fit(docs.limit(0))) == fingerprints.BINS


def test_comparison_matches_plain_walk(spark, ranks):
    rng = random.Random(3)
    rows = [(i * 7 % 501, prose(rng, rng.choice([0, 1, 5, 9, 40, 200]))) for i in range(120)]
    rows += [(600, None), (None, "no id " * 20), (None, None), (601, prose(rng, 9000)), (7, "same id " * 30), (7, "same id " * 30), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as peek", "2 as tie")
    ties = {(r.doc_id, r.text): r.tie for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as tie").collect()}
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), ties[r], r[1].encode()))

    def digest(text):
        data = text.encode()
        at = np.array(plain_features(data, ranks), np.int64)
        return Digest.build(data, fingerprints._hashes(np.frombuffer(data, np.uint8), at) if len(at) else np.zeros(0, np.uint64))

    want = []
    for (i, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = digest(t), digest(changed), digest(after)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    for size in (1500, 32 << 20):
        got = [tuple(r) for r in fingerprints.compare_with_edits(docs, ranks, range_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fingerprints.compare_with_edits(docs.limit(0), ranks).count() == 0
    one = fingerprints.compare_with_edits(docs.limit(1), ranks).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_tells_shared_texts(spark, ranks):
    rng = random.Random(4)
    base = [f"{rng.getrandbits(40):x}" for _ in range(1200)]
    text, other = " ".join(base), " ".join(f"{rng.getrandbits(40):x}" for _ in range(900))
    mixed = " ".join(base[:800]) + " " + other
    a, b, c = fingerprints.digests([t.encode() for t in (text, other, mixed)], ranks)
    assert a.likeness(b) < 0.05 and 0.5 < a.likeness(c) < 0.8 and a.likeness(a) == 1.0
    assert Digest.parse(str(a)).likeness(Digest.parse(str(c))) == a.likeness(c) == c.likeness(a)
    empty = Digest.build(b"", np.zeros(0, np.uint64))
    assert str(empty) == "0:" and empty.likeness(empty) == 1.0 and empty.likeness(a) == 0.0
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs, ranks).collect()}
    assert found[1].fingerprint == found[2].fingerprint == str(a) and found[3].fingerprint == "0:" and found[3].n_chars == 0
    pairs = spark.createDataFrame([(str(a), str(c)), (None, str(a))], "x string, y string")
    assert [r[0] for r in pairs.select(fingerprints.likeness(pairs.x, pairs.y)).collect()] == [a.likeness(c), None]
