import hashlib
import random
import re

from lexmill.llm import substring


def plain(rows, window):
    seen, out = set(), {}
    texts = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for i, t in rows}
    for i in sorted(texts):
        words, gone = texts[i], set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def corpus(rng):
    vocabulary = [f"w{i}é" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(18, 70))] for _ in range(8)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
                words += p[rng.randint(0, 5) :]
        if rng.random() < 0.1:
            words += ["same"] * rng.randint(5, 60)
        rows.append((i * 13 % 97, " ".join(w + rng.choice(["", "\n", "\t "]) for w in words)))
    return rows


def test_matches_brute_force(spark):
    for seed, batches in ((1, 1), (2, 3), (3, 6)):
        rows = [*corpus(random.Random(seed)), (500, None), (501, ""), (502, "one two")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as row_id", "3 as spans")
        got = result(substring.remove_repeated_windows(docs, batches=batches))
        want = plain(rows, 20)
        assert got == want
        assert sum(n for _, n, _ in want.values()) > 100


def test_two_letter_texts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.remove_repeated_windows(docs, window=8, anchor=3)) == plain(rows, 8)


def test_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeated_windows(docs).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (9, 25)]
    assert substring.remove_repeated_windows(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    index = substring.FingerprintIndex(spark, fan_in=2, buckets=2)
    text = " ".join(f"t{i}" for i in range(60))
    again = [index.add(spark.createDataFrame([(f"{k} {text}" if k % 2 else f"{k}",)], "text string")).count() for k in range(5)]
    assert again[0] == again[1] == again[2] == again[4] == 0
    assert again[3] > 0
    assert [len(level) for level in index.levels] == [1, 0, 1]
    index.drop()


def test_index_is_saved_opened_and_compacted(spark):
    """Batches one after another, the index opened anew for each, remove what one run over all removes."""
    rows = sorted(corpus(random.Random(11)))
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as row_id", "0L as tie", "doc_id", "text")
    name = substring.FingerprintIndex(spark, fan_in=2).name
    substring.FingerprintIndex(spark, fan_in=2, name=name).save()
    found, sizes = {}, []
    for low in range(0, 100, 20):
        index = substring.FingerprintIndex.open(spark, name)
        batch = texts.where(f"row_id >= {low} and row_id < {low + 20}")
        spans = substring.repeats_of_batch(index, texts.where(f"row_id < {low}"), batch)
        found |= {r.row_id: r.spans for r in spans.collect()}
        sizes.append(len(index.runs()))
    # Two runs of a level become one of the next: as many runs as the number of batches has binary digits that are one.
    assert sizes == [1, 1, 2, 1, 2]
    want = {r.doc_id: r.spans for r in substring.remove_repeated_windows(texts.select("doc_id", "text")).collect()}

    def covered(spans):
        return {k for s in spans or [] for k in range(s["start"], s["stop"])}

    assert any(want.values()) and {i: covered(found.get(i)) for i in want} == {i: covered(s) for i, s in want.items()}
    substring.FingerprintIndex.open(spark, name).drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(name)]
