import hashlib
import random

import pytest

from lexmill.functions.text import token_simhash
from lexmill.operators import quality


@pytest.mark.parametrize("crowd", [2, 8, 512])
def test_near_pairs_miss_nothing_in_crowds(spark, crowd):
    """Prints that share a half, or differ from it in a bit, however many there are."""
    rng = random.Random(5)
    common = rng.getrandbits(32)
    prints = [(common, rng.getrandbits(32)) for _ in range(120)] + [(rng.getrandbits(32), common) for _ in range(60)]
    prints += [(hi ^ (1 << rng.randrange(32)) if rng.random() < 0.5 else hi, lo ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32))) for hi, lo in prints[:80]]
    prints = sorted(set(prints))
    want = set()
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[i + 1 :], i + 1):
            d = (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
            if d <= 3:
                want.add((i, j, d))
    df = spark.createDataFrame([(i, hi, lo) for i, (hi, lo) in enumerate(prints)], "id long, hi long, lo long")
    assert {tuple(r) for r in quality.near_pairs(df, "id", crowd=crowd).collect()} == want and len(want) > 60


def test_votes_are_summed_where_the_text_is(spark):
    """Fingerprints told token by token; tokens are not shuffled."""

    def want(text):
        votes = [0] * 64
        for token in text.split():
            h = int.from_bytes(hashlib.sha256(token.encode()).digest()[-8:])
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        print_ = sum(1 << b for b, v in enumerate(votes) if v >= 0) if text else 0
        return print_ >> 32, print_ & 0xFFFFFFFF

    texts = ["a b c", "", "one two", "x " * 300 + "y " * 299 + "z 9", "same same"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = token_simhash(df, "id", "text")
    assert "token#" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.hi, r.lo) for r in found.collect()} == {i: want(t) for i, t in enumerate(texts)}
