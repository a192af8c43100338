"""Improbable-feature digests of documents (after Roussev, 2010).

Every window of bytes has an entropy; windows of an entropy that is rare in the corpus are improbable.
A window is selected if it is the least probable of enough of the runs of windows that hold it, its hash sets bits in a Bloom
filter, and full filters are chained. Two digests are compared by the overlap of their bits beyond what chance gives.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Bytes of a window, windows of a run, and runs that a selected window must be the least probable of.
WINDOW, RUN, POPULAR = 16, 16, 4
#: Entropies are thousandths of the largest; windows below LOW (runs of few characters) say nothing.
BINS, LOW = 1001, 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 128, 5
#: Bytes that a step inside a task works on together, lanes that it counts in, and bytes of texts in a range of documents.
STEP_BYTES, LANES, RANGE_BYTES = 1 << 20, 2048, 32 << 20
_NEVER = np.iinfo(np.int64).max

_SCALE = 1 << 20
_WEIGHT = np.array([0, *(round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1))], np.int32)
_UP = np.append(_WEIGHT[1:] - _WEIGHT[:-1], 0).astype(np.int32)
_DOWN = np.insert(_WEIGHT[1:] - _WEIGHT[:-1], 0, 0).astype(np.int32)
_WHOLE = int(_WEIGHT[WINDOW])


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, 0 to 1000, of every window of ``data``; windows slide side by side in lanes, in whole numbers so that places do not matter."""
    count = len(data) - WINDOW + 1
    if count < 1:
        return np.zeros(0, np.int64)
    lanes = min(LANES, max(1, count // 256))
    steps = -(-count // lanes)
    padded = np.zeros(lanes * steps + WINDOW, np.uint8)
    padded[: len(data)] = data
    rows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (steps + WINDOW - 1, lanes), (1, steps)))
    base = np.arange(lanes) * 256
    seen = np.zeros(lanes * 256, np.uint8)
    sums = np.zeros(lanes, np.int32)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps + WINDOW - 1):
        at = base + rows[t]
        n = seen[at]
        sums += _UP[n]
        seen[at] = n + 1
        if t >= WINDOW - 1:
            out[t - WINDOW + 1] = sums
            at = base + rows[t - WINDOW + 1]
            n = seen[at]
            sums -= _DOWN[n]
            seen[at] = n - 1
    return 1000 * (_WHOLE - out.T.reshape(-1)[:count].astype(np.int64)) // _WHOLE


@dataclass
class Piece:
    """Windows ``low`` to ``high`` (not itself) of ``data``."""

    data: bytes
    low: int
    high: int


def _cut(pieces: list[Piece]) -> Iterator[list[tuple[int, Piece]]]:
    """Pieces with their numbers, long ones cut, in groups of about STEP_BYTES."""
    group, size = [], 0
    for number, p in enumerate(pieces):
        for low in range(p.low, p.high, STEP_BYTES):
            part = Piece(p.data, low, min(p.high, low + STEP_BYTES))
            group.append((number, part))
            size += part.high - part.low + 3 * WINDOW
            if size >= STEP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _laid_out(group: list[tuple[int, Piece]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Bytes of a group one after another, which windows are of one piece, and (number, place of the first window asked for, count, its offset)."""
    parts, places, at = [], [], 0
    valid_from, valid_to = [], []
    for number, p in group:
        low, high = max(0, p.low - RUN + 1), min(len(p.data) - WINDOW + 1, p.high + RUN - 1)
        part = np.frombuffer(p.data, np.uint8, high - low + WINDOW - 1, low)
        parts.append(part)
        places.append((number, at + p.low - low, p.high - p.low, p.low))
        valid_from.append(at)
        valid_to.append(at + high - low)
        at += len(part)
    data = np.concatenate(parts)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, valid_from, 1)
    np.add.at(edge, valid_to, -1)
    return data, np.cumsum(edge)[: len(data) - WINDOW + 1] > 0, places


def _popular(rank: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the windows that are the least by (rank, place) of POPULAR runs or more. Between two pieces lie WINDOW - 1 windows of neither, so no run holds both."""
    count = len(rank)
    key = np.full(count + 2 * (RUN - 1), _NEVER)
    key[RUN - 1 : RUN - 1 + count] = np.where(valid & (rank >= 0), rank.astype(np.int64) * count + np.arange(count), _NEVER)
    width = 1
    while width < RUN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return np.flatnonzero(np.bincount(key[key != _NEVER] % count, minlength=count) >= POPULAR)


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]).view("<u8")
    value = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        value = (value ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value = value * np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(32)
    return value


def features(pieces: list[Piece], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offsets, hashes) of the selected windows of each piece."""
    found: list[list] = [[] for _ in pieces]
    for group in _cut(pieces):
        data, valid, places = _laid_out(group)
        chosen = _popular(ranks[entropies(data)], valid)
        hashes = _hashes(data, chosen)
        for number, at, count, offset in places:
            a, b = np.searchsorted(chosen, (at, at + count))
            found[number].append((chosen[a:b] - at + offset, hashes[a:b]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return [tuple(np.concatenate(x) for x in zip(*f, strict=True)) if f else none for f in found]


@dataclass
class Digest:
    """Chained Bloom filters: ``count`` features, FILTER_FEATURES in each filter but the last."""

    count: int
    filters: np.ndarray

    @classmethod
    def build(cls, data: bytes, hashes: np.ndarray) -> Digest:
        """A text without a selected window is one feature as a whole; an empty one has none."""
        hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
        if not len(hashes) and data:
            hashes = np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8")
        bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), bool)
        nth = np.arange(len(hashes)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[nth, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
        return cls(len(hashes), np.packbits(bits, axis=1))

    def __str__(self) -> str:
        return f"{self.count}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        count, filters = text.split(":")
        return cls(int(count), np.frombuffer(base64.b64decode(filters), np.uint8).reshape(-1, FILTER_BITS // 8))

    def likeness(self, other: Digest) -> float:
        """0 to 1: how much of the digest of fewer features is in the other.

        For each filter the best filter of the other counts: overlapping bits less those that chance gives, over the most there can
        be less the same. An overlap within three standard deviations of chance counts nothing. Equal digests give 1, none and some 0.
        """
        if not self.count or not other.count:
            return float(self.count == other.count)
        few, many = sorted((self, other), key=lambda d: (d.count, d.filters.tobytes()))
        if few.count == many.count and np.array_equal(few.filters, many.filters):
            return 1.0
        b = np.unpackbits(many.filters, axis=1).astype(np.float32)
        on_b, total = b.sum(1), 0.0
        for at in range(0, len(few.filters), 256):
            a = np.unpackbits(few.filters[at : at + 256], axis=1).astype(np.float32)
            on_a = a.sum(1)[:, None]
            most, share = np.minimum(on_a, on_b), np.maximum(on_a, on_b) / FILTER_BITS
            chance = most * share
            overlap = a @ b.T
            value = np.where(overlap > chance + 3 * np.sqrt(chance * (1 - share)), (overlap - chance) / np.maximum(most - chance, 1e-9), 0.0)
            of = np.minimum(FILTER_FEATURES, few.count - FILTER_FEATURES * np.arange(at, at + len(a)))
            total += float((value.max(1).clip(0, 1) * of).sum())
        return total / few.count


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy, rarest first, counted over every window of every text of ``docs``; -1 for those below LOW.

    Null texts, and texts shorter than a window, count nothing; equally rare entropies rank by size. Tasks send one row for each entropy.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            pieces = [Piece(t, 0, len(t) - WINDOW + 1) for t in texts if len(t) >= WINDOW]
            for group in _cut(pieces):
                data, _, places = _laid_out(group)
                found = entropies(data)
                for _, at, n, _ in places:
                    counts += np.bincount(found[at : at + n], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(counts)], names=["entropy", "n"])

    told = docs.select(F.col(text_col).alias("text")).transform(map_batches, count, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for r in told:
        counts[r.entropy] = r.n
    order = np.lexsort((np.arange(BINS), counts))
    ranks = np.empty(BINS, np.int64)
    ranks[order] = np.arange(BINS)
    ranks[:LOW] = -1
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    found = features([Piece(t, 0, max(0, len(t) - WINDOW + 1)) for t in texts], ranks)
    return [Digest.build(t, h) for t, (_, h) in zip(texts, found, strict=True)]


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint), one row for each row of ``docs``; a null text is an empty one, whose fingerprint is ``0:``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = digests([(t or "").encode() for t in texts], ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(map(str, found), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, run, "doc_id long, n_chars long, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def told(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else Digest.parse(p).likeness(Digest.parse(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return told(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``, as long."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _edited_digest(text: str, whole: bytes, other: str, own: tuple[np.ndarray, np.ndarray], ranks: np.ndarray) -> tuple[int, Piece, np.ndarray]:
    """What an edited text keeps of the features of ``text``, and the piece that has to be looked at anew."""
    kept = len(text[: len(text) - len(text) // 3].encode())
    data = other.encode()
    # A window this far from the cut, and every run that holds it, is made of kept bytes alone.
    low = max(0, min(kept - WINDOW - RUN + 2, len(data) - WINDOW + 1))
    return data, Piece(data, low, max(low, len(data) - WINDOW + 1)), own[1][own[0] < low]


def compare_with_edits(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of ``docs``.

    The next document is the one of the next smaller id (null ids last, ties by the text's hash, then the text), after the last one the first; the
    edited text is ``edited``. Null texts are empty; likeness of two empty ones is 1. Ranges of ids are cut by the
    ids and hashes alone; the first document of each range is also sent to the range before it, so texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.isnull("doc_id").alias("absent"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("tie")]
    keys = rows.select(*order, F.octet_length("text").cast("long").alias("size"))
    total = keys.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], _COMPARED)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    ranged = keys.repartitionByRange(count, "absent", "down", "tie")
    firsts = sorted((r.first.absent, r.first.down, r.first.tie) for r in ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("absent", "down", "tie")).alias("first")).collect())  # a row for each range

    @F.pandas_udf("array<int>")
    def placed(absent: pd.Series, down: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for key in zip(absent, down, tie, strict=True):
            part = bisect.bisect_right(firsts, key) - 1
            out.append([part, (part - 1) % len(firsts)] if key == firsts[part] else [part])
        return pd.Series(out)

    dealt = rows.select("*", *order).select("*", F.posexplode(placed("absent", "down", "tie")).alias("peek", "part"))
    streamed = dealt.repartition(count, "part").sortWithinPartitions("part", "peek", "absent", "down", "tie", "text").select("peek", "doc_id", "text")
    return streamed.transform(map_batches, lambda batches: _compared(batches, ranks), _COMPARED)


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Walks through ranges of documents, each closed by the first document of the next range."""
    held: list[tuple[int, int, str, bytes, tuple, Digest]] = []
    for batch in batches:
        peeks, ids, texts = (c.to_pylist() for c in batch.columns)
        start, size = 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size < STEP_BYTES and at + 1 < len(texts):
                continue
            new = texts[start : at + 1]
            raw = [t.encode() for t in new]
            found = features([Piece(t, 0, max(0, len(t) - WINDOW + 1)) for t in raw], ranks)
            held += [(p, i, t, r, f, Digest.build(r, f[1])) for p, i, t, r, f in zip(peeks[start : at + 1], ids[start : at + 1], new, raw, found, strict=True)]
            if rows := _with_next(held, ranks):
                yield rows
            held, start, size = held[-1:], at + 1, 0


def _with_next(run: list[tuple], ranks: np.ndarray) -> pa.RecordBatch | None:
    pairs = [(a, b) for a, b in zip(run, run[1:], strict=False) if not a[0]]
    if not pairs:
        return None
    changed = [edited(a[2], b[2]) for a, b in pairs]
    todo = [_edited_digest(a[2], a[3], e, a[4], ranks) for (a, _), e in zip(pairs, changed, strict=True)]
    tails = features([piece for _, piece, _ in todo], ranks)
    other = [Digest.build(data, np.concatenate((kept, tail[1]))) for (data, _, kept), tail in zip(todo, tails, strict=True)]
    columns = [
        pa.array([a[1] for a, _ in pairs], pa.int64()),
        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(d).hexdigest() for d, _, _ in todo], pa.string()),
        pa.array([str(a[5]) for a, _ in pairs], pa.string()),
        pa.array([str(o) for o in other], pa.string()),
        pa.array([a[5].likeness(o) for (a, _), o in zip(pairs, other, strict=True)], pa.float64()),
        pa.array([a[5].likeness(b[5]) for a, b in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[part.split(" ")[0] for part in _COMPARED.split(", ")])
