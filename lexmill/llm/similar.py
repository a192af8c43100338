"""Near-duplicates at a given Jaccard similarity: SimHash fingerprints linked through deletion-variant signatures, verified exactly.

A text is its set of word shingles, with a SimHash fingerprint of 192 bits in eight segments. Texts that differ in one bit of
a segment at most share a one-wildcard variant of it, meet by an equality join on variants, and are verified on their sets.
At a similarity of 0.8 a pair meets so with a chance of about 0.6, at 0.9 of 0.9.

An exact step follows for the pairs that these links leave apart. They meet at equal shingles among the first of each in one
common order, common shingles last: sets of similarity t share one of the first n - ceil(t n) + 1
of each, so every pair at the similarity meets. Of the pairs that meet, most are excluded by sizes, by places (what comes
after the first shared shingle must be enough to share) and by parity sketches: an element that one set has and the other
lacks turns one bit of a sketch, so two sketches differ in no more bits than their sets in elements.
What remains is verified on the sets themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, discard, held, hot_join, in_steps, map_batches, materialize, salted_join, utf8_list
from .components import connected_components, thin_edges
from .simhash import majority

#: Words of 64 bits of a fingerprint, its segments, and bits beside a segment that texts are compared by where they meet.
PRINT_WORDS, SEGMENTS, SEGMENT_BITS, BESIDE_BITS = 3, 8, 24, 32
#: Members of a run of equal variants that all its members meet. What that leaves apart the exact step compares.
PRINT_PIVOTS = 4
#: Classes that one task makes variants of.
TASK_PRINTS = 20_000
#: Words of 64 bits of the parity sketches that runs are compared by, and of the longest sketch; a set of n elements has one of n / 2 bits or more up to that.
RUN_WORDS, MAX_WORDS = 8, 256
#: Pairs of one text that a task verifies, and compares by sketches.
TASK_SETS, TASK_SKETCHES = 500, 50_000
#: Members of a run of equal shingles that all its members meet at once. Members of longer runs meet each other too, where the links found first leave them apart.
PIVOTS = 8
#: Members of a long run that one task compares with as many others.
BLOCK_ROWS = 10_000
#: Pairs of a run that a task gathers before it passes them on, and those of one more row.
TOLD_PAIRS = 500_000
#: Texts that the order of shingles is taken from, and shingles counted there that come last, at most. Any order finds the same pairs.
ORDER_DOCS, ORDER_SHINGLES, ORDER_COUNT = 20_000, 100_000, 4


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles; the whole sequence where it has fewer words, none without a word."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e]) for s, e in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def _shingles(docs: DataFrame, shingle_words: int, id_col: str, text_col: str, only: BitFilter | None = None) -> DataFrame:
    """(node, hashes): the set of every row, or of those whose ids ``only`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            if only is not None:
                step = step.filter(pa.array(only.passes(step.column(0).to_numpy())))
            sets = [shingle_hashes(t, shingle_words).view(np.int64) for t in utf8_list(step.column(1))]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).transform(map_batches, run, "node long, hashes array<long>")


def _common_shingles(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are common in a sample of the texts, drawn by hash."""
    share = min(1.0, ORDER_DOCS / max(1, docs.count()))
    some = docs.where(F.xxhash64(text_col).bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(share * (1 << 53)))).dropDuplicates([text_col])
    counts = _shingles(some, shingle_words, id_col, text_col).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= ORDER_COUNT).orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def first_shingles(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Those of sorted ``hashes`` of which every set of ``similarity`` or more has one among its own: by count in ``common``, then hash."""
    known, counts = common
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]]


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set as PRINT_WORDS words: the majority of each bit over its hashes, each mixed with the number of the word."""
    mixed = np.empty((len(hashes), PRINT_WORDS), np.uint64)
    for k in range(PRINT_WORDS):
        x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = x ^ (x >> np.uint64(31))
    return majority(mixed.view(np.uint8)).view(np.int64)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit for each value of the hash's low bits, 64 to a word: whether an odd number of the set's elements has it."""
    words = RUN_WORDS
    while words < MAX_WORDS and 128 * words < len(hashes):
        words *= 2
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same set's sketch of fewer words."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _signatures(docs: DataFrame, shingle_words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, same, print, sketch, brief, first): number, digest, fingerprint, parity sketches (whole, of RUN_WORDS) and first of the distinct shingles of every row."""
    sent, name = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle_words, id_col, text_col)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held(f"shingles {name}", lambda: sent.value)
        for step in in_steps(batches):
            sizes, digests, prints, sketches, brief, first = [], [], [], [], [], []
            for text in utf8_list(step.column(1)):
                hashes = shingle_hashes(text, shingle_words)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                prints.append(set_fingerprint(hashes))
                sketches.append(parity_sketch(hashes))
                brief.append(folded(sketches[-1], RUN_WORDS))
                first.append(first_shingles(hashes, similarity, common).view(np.int64) if len(hashes) else [])
            columns = [step.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in (prints, sketches, brief, first))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "same", "print", "sketch", "brief", "first"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, run, "doc_id long, n long, same binary, print array<long>, sketch array<long>, brief array<long>, first array<long>", model=True)


def _ordered(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(u, v), np.maximum(u, v)


def _may_be(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements, the first of them shared at places ``at`` and ``to`` of their orders, may have the similarity."""
    return np.minimum(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - 1e-9


def segment_variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, bit, beside) of each place of each row of ``prints``: its segment with this bit left open, the bit, and the bits that follow the segment."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1).astype(np.int64)
    segments = bits.reshape(-1, SEGMENTS, SEGMENT_BITS)
    parts = segments << np.arange(SEGMENT_BITS)
    number = np.arange(SEGMENTS * SEGMENT_BITS).reshape(SEGMENTS, SEGMENT_BITS)
    key = (parts.sum(2, keepdims=True) - parts) * number.size + number
    after = (number[:, -1:] + 1 + np.arange(BESIDE_BITS)) % number.size
    beside = np.repeat((bits[:, after] << np.arange(BESIDE_BITS)).sum(2), SEGMENT_BITS, axis=1)
    return key.reshape(bits.shape), bits, beside


def _variants(classes: DataFrame) -> DataFrame:
    """(key, node, told): the one-wildcard variants of every class's fingerprint; ``told`` is its set's size, the open bit and the bits beside the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            key, bit, beside = segment_variants(step.column(2).flatten().to_numpy().reshape(-1, PRINT_WORDS))
            node, n = (np.repeat(step.column(k).to_numpy(), key.shape[1]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.ravel(), node, (n * 2 + bit.ravel()) << BESIDE_BITS | beside.ravel())], names=["key", "node", "told"])

    full = classes.where("n > 0").select("node", "n", "print")
    # Each row becomes as many as a fingerprint has bits, so rows are dealt out by number before.
    return full.repartition(-(-full.count() // TASK_PRINTS) or 1, "node").transform(map_batches, run, "key long, node long, told long")


def pairs_of_variants(batches: Iterator[tuple[np.ndarray, ...]], similarity: float, pivots: int = PRINT_PIVOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of rows (key, node, told) in order of key and node: each with the first ``pivots`` of its run, where sizes and the bits beside the segment allow the similarity.

    Of the variants that two rows share in a segment one pairs them: that in whose open bit they differ, or that of the first place.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    room = BESIDE_BITS * share + 3 * math.sqrt(BESIDE_BITS * share * (1 - share))
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        if not len(batch[0]):
            continue
        old = len(kept[0])
        key, node, told = rows = tuple(np.concatenate((a, b)) for a, b in zip(kept, batch, strict=True))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = np.arange(old, len(key))
        n = told >> BESIDE_BITS + 1
        for j in range(pivots):
            later = later[start[later] + j < later]
            if not len(later):
                break
            pivot = start[later] + j
            apart = told[later] ^ told[pivot]
            fit = ((apart >> BESIDE_BITS & 1 == 1) | (key[later] % SEGMENT_BITS == 0)) & (np.bitwise_count(apart & (1 << BESIDE_BITS) - 1) <= room)
            fit &= _may_be(n[later], 0, n[pivot], 0, similarity) & (node[later] != node[pivot])
            if fit.any():
                yield _ordered(node[later[fit]], node[pivot[fit]])
        kept = tuple(c[start[-1] : start[-1] + pivots].copy() for c in rows)


def _near_prints(classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): classes that share a variant of their fingerprints and may have the similarity, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in pairs_of_variants((tuple(c.to_numpy() for c in batch.columns) for batch in batches), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    met = _variants(classes).repartition("key").sortWithinPartitions("key", "node")
    return materialize(met.transform(map_batches, run, "u long, v long").distinct(), "near")


def pairs_of_runs(batches: Iterator[tuple[np.ndarray, ...]], similarity: float, pivots: int = PIVOTS) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (key, node, n, at) in order of key and node: (False, u, v, -, -) of each row with the first ``pivots`` of its run, where
    sizes and places allow the similarity, and (True, key, node, n, at) for the rows of longer runs. Only a run's pivots are held."""
    kept, seen = tuple(np.zeros(0, np.int64) for _ in range(4)), 0
    for batch in batches:
        if not len(batch[0]):
            continue
        old = len(kept[0])
        key, node, n, at = rows = tuple(np.concatenate((a, b)) for a, b in zip(kept, batch, strict=True))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        index = np.arange(len(key))
        place = index - start
        place[old:][start[old:] == 0] += seen - old
        new = index >= old
        for j in range(pivots):
            later = np.flatnonzero(new & (place > j))
            if not len(later):
                break
            pivot = start[later] + j
            fit = _may_be(n[later], at[later], n[pivot], at[pivot], similarity) & (node[later] != node[pivot])
            if fit.any():
                u, v = _ordered(node[later[fit]], node[pivot[fit]])
                yield False, u, v, np.zeros_like(u), np.zeros_like(u)
        # The pivots of a run are told when it turns out to be a long one.
        turned = start[new & (place == pivots)]
        long = np.concatenate((np.flatnonzero(new & (place >= pivots)), (turned[:, None] + np.arange(pivots)).ravel()))
        if len(long):
            yield True, key[long], node[long], n[long], at[long]
        last = start[-1]
        seen = int(place[-1]) + 1
        kept = tuple(c[last : last + pivots].copy() for c in rows)


def _first_keys(classes: DataFrame) -> DataFrame:
    """(key, node, n, at): the first shingles of every class and their places."""
    return classes.select(F.posexplode("first").alias("at", "key"), "node", "n").select("key", "node", F.col("n").cast("int").alias("n"), "at")


def _met(keys: DataFrame, similarity: float) -> DataFrame:
    """(long, a, b, n, at): not long, pairs that share a key and may have the similarity, but in long runs only those with a pivot; long, rows of long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, *columns in pairs_of_runs((tuple(c.to_numpy().astype(np.int64) for c in batch.columns) for batch in batches), similarity):
            yield pa.RecordBatch.from_arrays([pa.array([long] * len(columns[0])), *map(pa.array, columns)], names=["long", "a", "b", "n", "at"])

    return materialize(keys.repartition("key").sortWithinPartitions("key", "node").transform(map_batches, run, "long boolean, a long, b long, n long, at long"), "met")


def _room(similarity: float, m: Column, n: Column) -> Column:
    """Elements that two sets of the similarity may differ in."""
    return (1 - similarity) / (1 + similarity) * (m + n) + 1e-9


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; where one is twice as long as the other its halves are folded. Any further ones differ in no bit."""
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    a, b = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda s, n: s + n)


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sketches do not exclude the similarity."""
    a = classes.select(F.col("node").alias("u"), F.col("n").alias("m"), F.col("sketch").alias("a")).dropDuplicates(["u"])
    b = classes.select(F.col("node").alias("v"), "n", F.col("sketch").alias("b")).dropDuplicates(["v"])
    met = salted_join(pairs, a, "u", "v", TASK_SKETCHES).join(b, "v")
    return met.where(_bits_apart(F.col("a"), F.col("b")) <= _room(similarity, F.col("m"), F.col("n"))).select("u", "v").distinct()


def whole_runs(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows (key first, in order of key), cut so that no run is parted."""
    waiting: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not len(batch[0]):
            continue
        run = batch[0]
        at = int(np.searchsorted(run, run[-1]))
        if at or (waiting and waiting[0][0][0] != run[0]):
            yield tuple(map(np.concatenate, zip(*waiting, tuple(c[:at] for c in batch), strict=True)))
            waiting = []
        waiting.append(tuple(c[at:] for c in batch))
    if waiting:
        yield tuple(map(np.concatenate, zip(*waiting, strict=True)))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of ``pairs`` that ``parts`` (node, component) do not join."""
    a, b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in ("u", "v"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where(F.coalesce("u_part", "u") != F.coalesce("v_part", "v")).select("u", "v")


def pairs_apart(batches: Iterator[tuple[np.ndarray, ...]], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of rows (key, node, label, n, at, sketch) in order of key: pairs of a run with different labels that sizes, places and sketches allow."""
    share = (1 - similarity) / (1 + similarity)
    for key, node, label, n, at, sketch in whole_runs(batches):
        us, vs, told = [], [], 0
        for i, end in enumerate(np.searchsorted(key, key, side="right").tolist()):
            later = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
            later = later[_may_be(n[later], at[later], n[i], at[i], similarity)]
            if len(later):
                later = later[np.bitwise_count(sketch[later] ^ sketch[i]).sum(1, dtype=np.int64) <= share * (n[later] + n[i]) + 1e-9]
                us.append(np.full(len(later), node[i]))
                vs.append(node[later])
                told += len(later)
                if told >= TOLD_PAIRS:
                    yield _ordered(np.concatenate(us), np.concatenate(vs))
                    us, vs, told = [], [], 0
        if us:
            yield _ordered(np.concatenate(us), np.concatenate(vs))


def _parted(crowd: DataFrame, labels: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs of long runs (key, node, n, at) that ``labels`` (node, component) do not join yet and that sketches allow, each once.

    A run is compared in pairs of blocks of BLOCK_ROWS members, so no task holds more than two blocks of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((*(b.column(k).to_numpy() for k in range(5)), b.column(5).flatten().to_numpy().view(np.uint64).reshape(-1, RUN_WORDS)) for b in batches)
        for u, v in pairs_apart(columns, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    named = crowd.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"), "n", "at")
    named = materialize(named, "crowd")
    # Runs within one component are done.
    runs = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low <> high").select("key", "rows", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    rest = hot_join(named, runs, ["key"], "rows").join(classes.select("node", F.col("brief").alias("sketch")).dropDuplicates(["node"]), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rest.select("key", "node", "label", "n", "at", "sketch", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "label", "n", "at", "sketch")
    found = materialize(dealt.repartition("key").sortWithinPartitions("key").transform(map_batches, run, "u long, v long").where("u <> v").distinct(), "parted")
    discard(named)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` whose sets have a Jaccard similarity of ``similarity`` or more; sets are made only of texts that are in a pair."""
    pairs = materialize(pairs, "asked")
    nodes = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    rows = docs.where(F.col(id_col).isNotNull())
    sets = materialize(_shingles(rows, shingle_words, id_col, text_col, BitFilter(nodes, "node")).join(nodes, "node", "left_semi"), "sets")
    a, b = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    met = salted_join(pairs, a, "u", "v", TASK_SETS).join(b, "v").where((F.size("a") >= similarity * F.size("b") - 1e-9) & (F.size("b") >= similarity * F.size("a") - 1e-9))
    shared = met.select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("both"))
    found = materialize(shared.where(F.col("both") >= similarity * (F.col("m") + F.col("n") - F.col("both")) - 1e-9).select("u", "v").distinct(), "links")
    discard(pairs, nodes, sets)
    return found


def similar_components(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest id reachable by links of ``similarity`` or more.

    The similarity is that of the sets of word shingles, exactly. Texts with equal sets are one
    class and compared once. Those that meet at variants of their fingerprints are verified and linked. Pairs that
    these links do not join meet at first shingles. In a run of equal keys that is longer than ``PIVOTS`` all members first
    meet ``PIVOTS`` of it. Of the pairs that meet those that join parts are verified first, then every
    pair, of long runs too, that the links found do not join: none is left out, and a run of copies
    is not paired in full. Null
    texts and texts without a word are one class and link with nothing else; rows with a null id
    are left out; rows with one id count as one document; an empty table gives an empty result.
    """
    how = (docs, shingle_words, similarity, id_col, text_col)
    prints = materialize(_signatures(*how).where("doc_id is not null"), "prints")
    classes = materialize(prints.groupBy("n", "same").agg(F.min("doc_id").alias("node"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"), F.first("first").alias("first"), F.count("*").alias("rows")), "classes")
    members = materialize(hot_join(prints.select("doc_id", "n", "same"), classes.select("n", "same", "node", "rows"), ["n", "same"], "rows").select("doc_id", "node"), "members")
    discard(prints)
    near = _near_prints(classes, similarity)
    close = _verified(thin_edges(_likely(near, classes, similarity)), *how)
    joined = materialize(connected_components(close), "joined")
    discard(near)
    met = _met(_first_keys(classes), similarity)
    unjoined = materialize(_apart(met.where("not long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), joined), "unjoined")
    pairs = materialize(_likely(unjoined, classes, similarity), "pairs")
    discard(unjoined)
    links = materialize(close.unionByName(_verified(thin_edges(pairs), *how)), "linked")
    parts = materialize(connected_components(links), "parts")
    apart = _apart(pairs, parts)
    parted = _parted(met.where("long").select(F.col("a").alias("key"), F.col("b").alias("node"), "n", "at"), parts, classes, similarity)
    rest = _verified(apart.unionByName(_likely(parted, classes, similarity)).distinct(), *how)
    # A class links its members to the member with the smallest id.
    own = members.where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    labels = connected_components(links.unionByName(rest).unionByName(own))
    discard(classes, close, joined, met, pairs, links, parts, parted, rest)
    ids = members.select("doc_id").distinct()
    found = ids.join(labels, ids.doc_id == labels.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    return members.select("doc_id").join(found, "doc_id")


def keep_one_of_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the rows with the smallest id stay, and rows with a null id."""
    id_col = options.get("id_col", "doc_id")
    gone = similar_components(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
