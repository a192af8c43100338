"""Conversation structure repair by a rank-convergent parallel Viterbi search (Maleki et al., 2014).

A conversation's turns are cut into chunks. Costs to go run backwards through each chunk from a
speculative vector of one cost per state; fix-up passes run a chunk again from what its successor
found, and stop where the new vector differs from the old one by a constant only. Where passes stop
converging (a run of turns that no state prefers), chunks hand over tropical transfer matrices instead,
multiplied in a logarithmic number of joins. With every chunk's costs known, each chunk traces its cheapest
edits, least in ASCII, from every entry state; the states at its borders are composed the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

#: Turns of one chunk.
CHUNK = 4096
SPACE = " \t\n\x0b\x0c\r"
INFINITE = 1 << 40
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
#: States say what the repaired turns so far end in: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more turn of a user or an assistant, whichever fits.
AFTER = (USER, USER, ASSISTANT, USER)
#: Costs to go after the last turn, and the edits that end a conversation, by state.
END, ENDING = (0, 6, 3, 0), ("", "II", "I", "")
UNKNOWN = (0, 0, 0, 0)
OK, TRUNCATED, BLANK, DUPLICATE = range(4)


def _symbol(initial: Column, fault: Column) -> Column:
    """One letter for a turn: its role's initial and its fault are all that costs depend on."""
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + kind * 4 + fault)


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that use up a turn."""
    kind, fault = divmod(ord(symbol) - 65, 4)
    moves = [(DELETE, DELETE_COST, state)]
    if fault in (OK, TRUNCATED):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if (kind == 0 and state == START) or (kind == 1 and state != USER) or (kind == 2 and state == USER):
            moves.append((KEEP, more, kind + 1))
        moves.append((REROLE, REROLE_COST + more, AFTER[state]))
    return moves


@cache
def _step(right: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """Costs before a turn from those after it: (vector with least cost 0, what was taken off, (edits, exit state) by entry state)."""
    cost = [min(c + right[to] for _, c, to in _moves(symbol, s)) for s in range(4)]
    for _ in range(3):
        cost = [min(c, INSERT_COST + cost[AFTER[s]]) for s, c in enumerate(cost)]
    traces = []
    for state in range(4):
        edits = ""
        while cost[state] < INFINITE:
            best = [(e, to) for e, c, to in _moves(symbol, state) if c + right[to] == cost[state]]
            if INSERT_COST + cost[AFTER[state]] == cost[state]:
                best.append((INSERT, AFTER[state]))
            edit, state = min(best)
            edits += edit
            if edit != INSERT:
                break
        traces.append((edits, state))
    least = min(cost)
    return tuple(min(c, INFINITE) - least if c < INFINITE else INFINITE for c in cost), least, tuple(traces)


def backward(symbols: str, right: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before the first of ``symbols``, as (vector with least cost 0, constant)."""
    base = 0
    for symbol in reversed(symbols):
        right, more, _ = _step(right, symbol)
        base += more
    return right, base


def fixed(symbols: str, right: tuple[int, ...], old_right: tuple[int, ...], old_left: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before ``symbols``, from ``right``; stops where it meets the walk from ``old_right``, which led to ``old_left``."""
    for symbol in reversed(symbols):
        if right == old_right:
            return old_left
        right, old_right = _step(right, symbol)[0], _step(old_right, symbol)[0]
    return right


def transfer(symbols: str) -> list[int]:
    """The 4 x 4 matrix (row after row) that takes the costs after ``symbols`` to those before."""
    columns = [backward(symbols, tuple(0 if s == to else INFINITE for s in range(4))) for to in range(4)]
    return [min(INFINITE, columns[to][0][s] + columns[to][1]) for s in range(4) for to in range(4)]


def traced(symbols: str, right: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """Cheapest edits, least in ASCII, and exit states of ``symbols``, by entry state."""
    steps = []
    for symbol in reversed(symbols):
        right, _, traces = _step(right, symbol)
        steps.append(traces)
    edits, exits = [], []
    for state in range(4):
        parts = []
        for traces in reversed(steps):
            part, state = traces[state]
            parts.append(part)
        edits.append("".join(parts))
        exits.append(state)
    return edits, exits


def _mapped(df: DataFrame, run: Callable, inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """``df`` (key, block, ...) with ``outputs`` told by ``run`` from the columns ``inputs`` of each row."""
    names = [c for c in df.columns if c not in outputs]
    kinds = {"array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [run(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            made = [pa.array([f[i] for f in found], kinds[kind]) for i, kind in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *outputs])

    types = dict(df.dtypes)
    return map_batches(df, rows, ", ".join([*(f"{c} {types[c]}" for c in names), *(f"{c} {k}" for c, k in outputs.items())]))


def _composed(table: DataFrame, combine: Callable[[Column, Column], Column], step: int, longest: int) -> DataFrame:
    """(key, block, m): ``m`` combined over all blocks of a key from this one on, in the direction of ``step``; a join for each doubling."""
    reach = 1
    while reach < longest:
        far = table.select("key", (F.col("block") - step * reach).alias("block"), F.col("m").alias("far"))
        joined = table.join(far, ["key", "block"], "left")
        after = materialize(joined.select("key", "block", F.when(F.col("far").isNull(), F.col("m")).otherwise(combine(F.col("m"), F.col("far"))).alias("m")), "composed")
        if reach > 1:
            discard(table)
        table, reach = after, 2 * reach
    return table


def _product(a: Column, b: Column) -> Column:
    """The tropical product of two 4 x 4 matrices."""
    cell = lambda i, j: F.array_min(F.array(*(a[4 * i + k] + b[4 * k + j] for k in range(4)), F.lit(INFINITE)))
    return F.array(*(cell(i, j) for i in range(4) for j in range(4)))


def _rights(chunks: DataFrame, longest: int) -> DataFrame:
    """(key, block, symbols, right) of conversations of several chunks: the costs after each chunk, up to a constant.

    Passes go on while each leaves at most half as many chunks to fix as the one before.
    """
    ints = {"left": "array<bigint>"}
    last = F.array(*(F.lit(c).cast("long") for c in END))
    first = chunks.withColumn("right", F.when(F.col("more"), F.array(*(F.lit(c).cast("long") for c in UNKNOWN))).otherwise(last))
    now = materialize(_mapped(first, lambda s, r: (backward(s, tuple(r))[0],), ["symbols", "right"], ints), "costs")
    before = None
    while True:
        told = now.select("key", (F.col("block") - 1).alias("block"), F.col("left").alias("want"))
        wanted = now.join(told, ["key", "block"], "left").withColumn("want", F.coalesce("want", last))
        stale = materialize(wanted.where("want <> right"), "stale")
        n = stale.count()
        if not n or (before is not None and 2 * n > before):
            discard(stale)
            break
        mended = _mapped(stale.withColumnsRenamed({"left": "old"}), lambda s, w, r, o: (fixed(s, tuple(w), tuple(r), tuple(o)),), ["symbols", "want", "right", "old"], ints)
        after = materialize(wanted.where("want = right").select(*now.columns).unionByName(mended.drop("old", "right").withColumnRenamed("want", "right")), "costs")
        discard(now, stale)
        now, before = after, n
    if not n:
        return now.select("key", "block", "symbols", "right")
    matrices = materialize(_mapped(now.select("key", "block", "symbols"), lambda s: (transfer(s),), ["symbols"], {"m": "array<bigint>"}).select("key", "block", "m"), "matrices")
    ends = _composed(matrices, _product, 1, longest)
    cost = [F.array_min(F.array(*(F.col("m")[4 * s + k] + END[k] for k in range(4)))) for s in range(4)]
    left = ends.select("key", (F.col("block") - 1).alias("block"), F.array(*cost).alias("cost"))
    return now.select("key", "block", "symbols").join(left, ["key", "block"], "left").select("key", "block", "symbols", F.coalesce(F.transform("cost", lambda c: c - F.array_min("cost")), last).alias("right"))


def _edits(chunks: DataFrame) -> DataFrame:
    """(key, block, symbols, edits): the cheapest edits of every chunk, least in ASCII for the whole conversation."""
    told = chunks.select("key", (F.col("block") - 1).alias("block"), F.lit(True).alias("more"))
    prior = chunks.select("key", (F.col("block") + 1).alias("block"), F.lit(True).alias("less"))
    placed = materialize(chunks.join(told, ["key", "block"], "left").join(prior, ["key", "block"], "left").select("key", "block", "symbols", F.coalesce("more", F.lit(False)).alias("more"), F.coalesce("less", F.lit(False)).alias("less")), "chunks")
    traces = {"edits": "array<string>", "exits": "array<int>"}
    single = _mapped(placed.where("not more and not less"), lambda s: traced(s, END), ["symbols"], traces).withColumn("entry", F.lit(START))
    long = placed.where("more or less").drop("less")
    longest = long.groupBy("key").count().agg(F.max("count")).first()[0]
    found = single.select("key", "block", "symbols", F.lit(True).alias("last"), F.col("edits")[START].alias("edits"), F.col("exits")[START].alias("exit"))
    if longest:
        known = _rights(long, longest).join(long.select("key", "block", "more"), ["key", "block"])
        done = materialize(_mapped(known, lambda s, r: traced(s, tuple(r)), ["symbols", "right"], traces), "traces")
        # The last exit of a chunk is where the next one enters: maps of four states, composed from the first chunk on.
        upto = _composed(done.select("key", "block", F.col("exits").alias("m")), lambda m, far: F.transform(far, lambda s: m[s]), -1, longest)
        entries = upto.select("key", (F.col("block") + 1).alias("block"), F.col("m")[START].alias("entry"))
        at = F.coalesce("entry", F.lit(START))
        found = found.unionByName(done.join(entries, ["key", "block"], "left").select("key", "block", "symbols", (~F.col("more")).alias("last"), F.get("edits", at).alias("edits"), F.get("exits", at).alias("exit")))
    ending = F.array(*map(F.lit, ENDING))
    return found.select("key", "block", "symbols", F.when(F.col("last"), F.concat("edits", F.get(ending, F.col("exit")))).otherwise(F.col("edits")).alias("edits"))


def _ordered_turns(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text): nulls of role and text are one space; ``key`` tells a null conversation from all others."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(key.alias("key"), "conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """(key, block, symbols): turns in order as one letter each, cut at every ``chunk`` rows of the whole table.

    Turns are range-partitioned, so a conversation of any length is spread over tasks; only marks, no texts,
    leave that stage. A turn is a repeat if it is not the first of its role and text, which one aggregation
    tells; marks and firsts meet at places, which are unique.
    """
    order = ["key", "turn", "role", "text"]
    count = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(count, *order, "tie").sortWithinPartitions(*order, "tie")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    marks = materialize(
        ranged.select("key", F.monotonically_increasing_id().alias("place"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same")),
        "marks",
    )
    firsts = marks.groupBy("key", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    task = F.shiftright("place", 33)
    sizes = marks.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()  # a row for each task of the stage above
    before, upto = {}, 0
    for r in sizes:
        before[r.task], upto = upto, upto + r.n
    starts = F.broadcast(turns.sparkSession.createDataFrame(list(before.items()), "task long, before long"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    told = marks.join(firsts, "place", "left").withColumn("task", task).join(starts, "task")
    told = told.select("key", (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), _symbol(F.col("initial"), fault).alias("symbol"))
    grouped = told.groupBy("key", F.expr(f"at div {chunk}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("all"))
    return materialize(grouped.select("key", "block", F.array_join(F.transform("all", lambda s: s["symbol"]), "").alias("symbols")), "symbols")


def _walk(turns: DataFrame, chunk: int, make: Callable, schema: str) -> DataFrame:
    """Every conversation's turns in order beside its edits, walked through by a new ``make(conv_id, symbols, edits)``.

    One task streams a conversation's rows: a digest of the whole repaired text can only be taken in order. It holds the edits
    (about two bytes a turn, as long as the audit that it returns) and one turn at a time.
    """
    edits = _edits(_chunks(turns, chunk))
    marks = edits.select("key", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("block").cast("long").alias("turn"), F.col("symbols").alias("role"), F.col("edits").alias("text"))
    both = marks.unionByName(turns.select("key", F.lit(1).alias("kind"), "conv_id", F.col("turn").cast("long"), "role", "text"))
    sorted_rows = both.repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "text")
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, symbols, edits, now = None, [], [], None
        for batch in batches:
            for at, kind, conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "conv_id", "turn", "role", "text")), strict=True):
                if at != key:
                    if now:
                        yield from now.close()
                    key, symbols, edits, now = at, [], [], None
                if kind == 0:
                    symbols.append(role)
                    edits.append(text)
                    continue
                now = now or make(conv_id, "".join(symbols), "".join(edits))
                yield from now.turn(turn, role, text)
        if now:
            yield from now.close()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for row in run(batches):
            kept.append(row)
            size += 200 + sum(len(v) for v in row if isinstance(v, str))
            if size > 1 << 20:
                yield _batch(kept, names, kinds)
                kept, size = [], 0
        if kept:
            yield _batch(kept, names, kinds)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[part.split(" ")[1]] for part in schema.split(", ")]
    return map_batches(sorted_rows, rows, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _Repair:
    """Applies edits to a conversation's turns as they come."""

    def __init__(self, conv_id, symbols: str, edits: str):
        self.conv_id, self.symbols, self.edits = conv_id, symbols, edits
        self.at = self.row = self.spoken = 0

    def _next_role(self) -> str:
        self.spoken += 1
        return "user" if self.spoken % 2 else "assistant"

    def _applied(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns that this turn leaves, inserted ones before it."""
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        self.row += 1
        if edit == REROLE:
            yield edit, self._next_role(), text
        elif edit == KEEP:
            self.spoken += role[:1] != "s"
            yield edit, role, text

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield INSERT, self._next_role(), ""


class _Turns(_Repair):
    place = 0

    def _rows(self, turns, turn) -> Iterator[tuple]:
        for edit, role, text in turns:
            yield self.conv_id, self.place, None if edit == INSERT else turn, role, text, edit
            self.place += 1

    def turn(self, turn, role, text):
        yield from self._rows(self._applied(role, text), turn)

    def close(self):
        yield from self._rows(self._inserted(), None)


class _Summary(_Repair):
    def __init__(self, conv_id, symbols: str, edits: str):
        super().__init__(conv_id, symbols, edits)
        self.hash, self.first, self.before = hashlib.sha256(), True, None
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = None

    def _add(self, turns) -> None:
        for _, role, text in turns:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def turn(self, turn, role, text):
        initial = role[:1]
        if self.row:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        fault = (ord(self.symbols[self.row]) - 65) % 4
        self._add(self._applied(role, text))
        if fault == TRUNCATED and self.edits[self.at - 1] != DELETE:
            self.cost += TRUNCATED_COST
        return ()

    def close(self):
        self._add(self._inserted())
        faults = [sum(self.symbols.count(chr(65 + kind * 4 + fault)) for kind in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        self.cost += DELETE_COST * self.edits.count(DELETE) + INSERT_COST * self.edits.count(INSERT) + REROLE_COST * self.edits.count(REROLE)
        yield self.conv_id, gaps, *faults, self.illegal, self.cost, self.edits, self.hash.hexdigest()


def repaired_turns(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of every repaired conversation, ``place`` from 0.

    ``edit`` says K for kept, R for a changed role, I for an inserted turn (no text, ``turn`` null). Deleted turns have no row. Faults, costs
    and order are those of ``repair_summary``.
    """
    return _walk(_ordered_turns(rows), chunk, _Turns, "conv_id long, place long, turn long, role string, text string, edit string")


def repair_summary(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation of ``rows``.

    Turns are taken by turn (nulls first), ties by role and text; repeated rows are turns of their own, and all but the first are
    duplicates. A null role or text is one space; rows with a null conversation are a conversation. Other columns are ignored,
    an empty table gives no row. Any number of turns may be of one conversation.
    """
    return _walk(_ordered_turns(rows), chunk, _Summary, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by the CRC-32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops a turn, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    planted = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    return planted.withColumn("copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def summary_of_all(rows: DataFrame, every: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``repair_summary`` of ``rows`` with a row of zeros, no audit and the digest of no text for the conversations of ``every`` that have no turn left."""
    ids = every.select("conv_id").distinct()
    found = repair_summary(rows, chunk).withColumnRenamed("conv_id", "of")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.join(found, ids["conv_id"].eqNullSafe(found["of"]), "left").drop("of").fillna({**zeros, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
