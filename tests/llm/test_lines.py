import random

from lexmill.llm import lines

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, depth=3, min_texts=8, fixed_share=0.6, max_loss=0.5):
    """Template tree by dictionaries."""
    seen = {}
    for _, t, _ in rows:
        for line in (t or "").split("\n"):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split())
            if tokens:
                seen.setdefault((len(tokens), tokens[:depth]), {}).setdefault(tokens, set()).add(t)
    gone = set()
    for kinds in seen.values():
        if len(set().union(*kinds.values())) < min_texts:
            continue
        count = {}
        for tokens, texts in kinds.items():
            for k, w in enumerate(tokens):
                count[k, w] = count.get((k, w), 0) + len(texts)
        templates = {}
        for tokens, texts in kinds.items():
            fixed = [w != "<*>" and count[k, w] >= min_texts for k, w in enumerate(tokens)]
            if sum(fixed) >= fixed_share * len(tokens):
                shape = tuple(w if f else "<*>" for w, f in zip(tokens, fixed, strict=True))
                templates.setdefault(shape, []).append((tokens, len(texts)))
        for members in templates.values():
            if sum(n for _, n in members) >= min_texts:
                gone.update(tokens for tokens, _ in members)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        bad = [tuple("<*>" if any(c in "0123456789" for c in w) else w for w in x.split()) in gone for x in parts]
        if sum(len(x) for x, b in zip(parts, bad, strict=True) if b) > max_loss * len(t):
            bad = [False] * len(parts)
        out.append((i, "\n".join(x for x, b in zip(parts, bad, strict=True) if not b), len(parts), sum(bad)))
    return out


def corpus():
    rng, rows = random.Random(6), []
    for i in range(60):
        body = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14)) for _ in range(3)]
        body.insert(i % 3, "All rights reserved.")
        if i % 2:
            body.append(f"Posted on 2021-03-{i:02d} by user {'anna bert carl dora'.split()[i % 4]}{'' if i % 3 else 'x'} in the forum")
        if i % 5 == 0:
            body.append(f"Posted on the wall by reader {chr(97 + i % 26)}{chr(97 + i // 3)} in this forum")
        rows.append((i, "\n".join(body), "en"))
    whole = "\n".join(f"the very same line {w} in every copy" for w in ("one", "two", "three"))
    rows += [(100 + i, whole, "en") for i in range(30)]
    rows += [(200 + i, f"{whole}\nmy own word{i} is here in this line alone", "en") for i in range(12)]
    return rows


def test_matches_plain_tree(spark):
    rows = [*corpus(), (500, None, None), (501, "", "en"), (502, "\n \n", "en"), (None, "All rights reserved.\nfree text of a row that has no id but has words", "en"), (3, corpus()[3][1], "en")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as gone_id", "3 as n_lines")
    got = lines.rewrite(docs, counts=("n_lines", "n_dropped"))
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert found == sorted(plain(rows), key=str)
    assert sum(r[3] for r in found) > 90
    assert all(r[3] == 0 for r in found if r[0] is not None and 100 <= r[0] < 300)


def test_empty_table(spark):
    assert lines.rewrite(spark.createDataFrame([], SCHEMA)).count() == 0


def by_sets(rows, depth=3, min_texts=8, fixed_share=0.6):
    """Lines (as masked tokens) to drop, by sets of texts."""
    leaves = {}
    for _, t, _ in rows:
        for line in (t or "").split("\n"):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split())
            if tokens:
                leaves.setdefault((len(tokens), tokens[:depth]), {}).setdefault(tokens, set()).add(t)
    gone = set()
    for kinds in leaves.values():
        places, shapes = {}, {}
        for tokens, texts in kinds.items():
            for k, w in enumerate(tokens):
                places.setdefault((k, w), set()).update(texts)
        for tokens, texts in kinds.items():
            fixed = [w != "<*>" and len(places[k, w]) >= min_texts for k, w in enumerate(tokens)]
            if sum(fixed) >= fixed_share * len(tokens):
                shape = tuple(w if f else "<*>" for w, f in zip(tokens, fixed, strict=True))
                shapes.setdefault(shape, []).append((tokens, texts))
        for members in shapes.values():
            if len(set().union(*(t for _, t in members))) >= min_texts:
                gone.update(tokens for tokens, _ in members)
    return gone


def test_a_text_with_many_lines_of_one_shape_counts_once(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(n))
    rows = [(600 + i, f"{prose(30)}\nitem of the {prose(1)} {prose(1)} {prose(1)} {prose(1)}\nread more of this here", "en") for i in range(9)]
    listed = "\n".join(f"item of the red big {prose(1)} list" for _ in range(12))
    rows += [(650, f"{prose(60)}\n{listed}", "en"), *corpus()]
    gone = by_sets(rows)
    got = {r.doc_id: r for r in lines.rewrite(spark.createDataFrame(rows, SCHEMA), counts=("n_lines", "n_dropped")).collect()}
    assert got[650].n_dropped == 0 and got[650].text == rows[9][1]
    assert all(got[600 + i].n_dropped == 1 for i in range(9))
    masked = lambda x: tuple("<*>" if any(c in "0123456789" for c in w) else w for w in x.split())
    for i, t, _ in rows:
        if not 100 <= i < 300:
            assert got[i].text == "\n".join(x for x in t.split("\n") if masked(x) not in gone), i


def test_pages_of_mostly_boilerplate_are_cleaned(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(n))
    head, foot = "Welcome to the page of our club", "All rights are reserved by the club, ask us first"
    own = [prose(n) for n in (4, 8, 9, 20, 4, 5, 6, 7, 30, 3)]
    rows = [(i, f"{head}\n{x}\n{foot}", "en") for i, x in enumerate(own)]
    # Near copies that each lack a line: all lines recur, no two texts have the same.
    whole = [f"line {w} of the text that is in many copies" for w in "a b c d e f g h i j k l".split()]
    rows += [(100 + i, "\n".join(x for k, x in enumerate(whole) if k != i), "en") for i in range(12)]
    got = {r.doc_id: r.text for r in lines.rewrite(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == x for i, x in enumerate(own) if i)
    assert sorted(x for i in range(100, 112) for x in got[i].split("\n") if x) == whole
