import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from lexmill.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """All edit strings by cost and then ASCII, by a uniform-cost search: (cost, audit, repaired turns)."""
    heap = [(0, "", 0, 0, ())]
    best = None
    seen = {}
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if seen.get((at, state), (cost, audit)) < (cost, audit):
            continue
        seen[at, state] = (cost, audit)
        if at == len(turns) and state in (0, 3):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
        role, then = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 3, audit + "I", at, then, (*out, (role, ""))))
        if at < len(turns):
            own, text, fault = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, then, (*out, (role, text))))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((own[:1], state))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*out, (own, text))))
    return best


def plain(rows):
    out, groups = [], {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, repaired = cheapest(marked)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        faults = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        way, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if way:
            row = (conv, turn, "user" if way == 4 else role, "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text)
            out += [row, row] if way == 3 else [row]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "'x' as block", "2 as place", "3 as kind")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_matches_search_of_all_edits(spark, chunk):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Yes.", "No", "", None, "Well! ", "what\n", "é?", "a. b"]
    rows = [(rng.choice([1, 2, 3, 4, None]) if n % 3 else 9 + n // 12, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for n in range(140)]
    rows += [(50, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(21)]
    assert found(conversations.repair_summary(table(spark, rows), chunk)) == plain(rows)


def test_turns_that_no_state_prefers_go_by_matrices(spark, monkeypatch):
    """Unknown roles and empty texts keep costs apart for ever, so that passes do not converge."""
    used = []
    product = conversations._product
    monkeypatch.setattr(conversations, "_product", lambda a, b: used.append(1) or product(a, b))
    rows = [(1, i, "tool", f"{i}.") for i in range(41)] + [(2, i, "user", "") for i in range(33)] + [(3, i, "tool" if i < 20 else "user", f"{i}" if i % 3 else f"{i}.") for i in range(30)]
    assert found(conversations.repair_summary(table(spark, rows), 2)) == plain(rows)
    assert used


def test_damage_and_conversations_without_turns(spark):
    rng = random.Random(3)
    rows = [(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", rng.choice(["Hm.", "So it is!", "no"])) for i in range(400)]
    rows += [(None, 1, "user", "x."), (None, None, None, None), (5, 2, "user", "Hm."), (900, 1, "user", "Hm.")]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hm."))
    t = table(spark, rows)
    want = plain(harmed(rows)) + [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(conversations.summary_of_all(conversations.damaged(t), t)) == sorted(want, key=repr)


def test_repaired_turns_are_the_digest(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B"), (1, 2, "user", "C."), (2, None, "system", "S."), (2, 3, "user", "Q?"), (2, 4, "assistant", "long " * 50_000 + "end.")]
    summary = {r.conv_id: r for r in conversations.repair_summary(table(spark, rows)).collect()}
    turns = {}
    for r in sorted(conversations.repaired_turns(table(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for conv, got in turns.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == summary[conv].repaired_sha256
        assert [r.edit for r in got] == [e for e in summary[conv].audit if e != "D"]
    assert [r.place for r in turns[2]] == [0, 1, 2]


def test_empty_table(spark):
    t = table(spark, [(1, 1, "user", "x.")]).limit(0)
    assert conversations.repair_summary(t).count() == 0
    assert conversations.summary_of_all(conversations.damaged(t), t).count() == 0
