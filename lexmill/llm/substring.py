"""Exact substring dedup with a log-structured index of window hashes.

The index is a set of immutable runs, Parquet tables sorted by hash, one per batch
of documents, with a count of every hash. It holds the anchors
of the texts: the short windows with the least hash among all short windows of some
longer window, so that equal long windows have equal anchors at equal offsets. A
new batch makes a run, which is merge-joined with the older runs; hashes that have
occurred before are verified on 128-bit digests of the long windows around them.
Runs of similar size are merged, so their number stays logarithmic.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitFilter, hot_join, in_steps, map_batches, materialize, utf8_list

#: Words of the short windows whose hashes are indexed.
ANCHOR_WORDS = 6
#: Runs that are merged into one.
FAN_IN = 3
_EMPTY = np.zeros(0, np.int64)
_ODD_A, _ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _roll(hashes: np.ndarray, words: int, odd: np.uint64) -> np.ndarray:
    """Hash of each window of ``words`` consecutive word hashes."""
    n = len(hashes) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = total * odd + hashes[k : k + n]
    return _mix(total)


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: for every anchor its hash, the first window it stands for, and how many."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), _EMPTY, _EMPTY
    short = _roll(hashes, anchor, _ODD_A)
    # The leftmost least of each window's short windows.
    least = np.lib.stride_tricks.sliding_window_view(short, window - anchor + 1).argmin(1) + np.arange(len(hashes) - window + 1)
    # Equal consecutive choices are one anchor occurrence.
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.append(first, len(least)))
    return short[least[first]], first, counts


class FingerprintIndex:
    """Runs of anchor hashes, each a table bucketed and sorted by hash so that joins between runs merge without a shuffle.

    Runs are immutable. Which of them make up the index is kept in a manifest table, written anew after every batch, so that a
    later session can open the index by name and add to it.
    """

    def __init__(self, spark: SparkSession, window: int = 20, anchor: int = ANCHOR_WORDS, fan_in: int = FAN_IN, buckets: int | None = None, name: str | None = None):
        self.spark, self.window, self.anchor, self.fan_in = spark, window, anchor, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"lexmill_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> FingerprintIndex:
        """The index that ``save`` left under this name."""
        kept = spark.table(f"{name}_manifest").collect()  # one row, and one for each run
        head = next(r for r in kept if r.level < 0)
        index = cls(spark, *head.settings[:4], name=name)
        index.made = head.settings[4]
        for r in sorted((r for r in kept if r.level >= 0), key=lambda r: (r.level, r.place)):
            while len(index.levels) <= r.level:
                index.levels.append([])
            index.levels[r.level].append(r.run)
        return index

    def save(self) -> None:
        """Write the manifest. Runs are tables already."""
        rows = [(level, place, run, None) for level, runs in enumerate(self.levels) for place, run in enumerate(runs)]
        settings = [self.window, self.anchor, self.fan_in, self.buckets, self.made]
        table = self.spark.createDataFrame([*rows, (-1, 0, "", settings)], "level int, place int, run string, settings array<int>")
        table.coalesce(1).write.mode("overwrite").saveAsTable(f"{self.name}_manifest")

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, run: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        run.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(table)
        self.made += 1
        return table

    def add(self, batch: DataFrame) -> DataFrame:
        """Index ``batch`` (text); return the anchor hashes (hash) in it that occur twice in it or occurred in an earlier batch."""
        window, anchor = self.window, self.anchor

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step in in_steps(batches):
                parts = [_anchors(_word_hashes(w)[0], window, anchor)[0] for t in utf8_list(step.column(0)) if t and len(w := t.split()) >= window]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], names=["hash"])

        hashes = batch.select("text").transform(map_batches, run, "hash long")
        older = self.runs()
        mine = self._write(hashes.groupBy("hash").agg(F.count("*").alias("n")))
        known = self.spark.table(mine)
        again = known.where("n > 1").select("hash")
        for table in older:
            again = again.unionByName(known.join(self.spark.table(table).hint("merge"), "hash", "left_semi").select("hash"))
        again = materialize(again.distinct(), "again")
        self._push(mine, 0)
        return again

    def _push(self, table: str, level: int) -> None:
        """Put a run on its level; a full level is compacted into one run of the next, and its runs are dropped."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merged.unionByName(self.spark.table(other))
            compacted = self._write(merged.groupBy("hash").agg(F.sum("n").alias("n")))
            for run in old:
                self.spark.sql(f"DROP TABLE {run}")
            self._push(compacted, level + 1)

    def drop(self) -> None:
        for table in [*self.runs(), f"{self.name}_manifest"]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


_KEY = "row_id long, tie long"


def _arrow(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _occurrences(texts: DataFrame, again: DataFrame, window: int, anchor: int) -> DataFrame:
    """(hash, segment, row_id, tie, start, n): the anchors in ``again``, each with the digest of the windows it stands for."""
    likely = BitFilter(again, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            rows = []
            for i, tie, t in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), utf8_list(step.column(2)), strict=True):
                if t and len(w := t.split()) >= window:
                    a, b = _word_hashes(w)
                    hashes, first, counts = _anchors(a, window, anchor)
                    some = np.flatnonzero(likely.passes(hashes.view(np.int64)))
                    if len(some):
                        hashes, first, counts = hashes[some].view(np.int64), first[some], counts[some]
                        raw = _roll(b, window, _ODD_B).tobytes()
                        segment = np.array([xxhash.xxh64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(first.tolist(), (first + counts).tolist(), strict=True)], np.uint64).view(np.int64)
                        rows.append((hashes, segment, np.full(len(some), i, np.int64), np.full(len(some), tie, np.int64), first.astype(np.int32), counts.astype(np.int32)))
            if rows:
                yield _arrow([np.concatenate(x) for x in zip(*rows, strict=True)], "hash segment row_id tie start n")

    every = texts.select("row_id", "tie", "text").transform(map_batches, run, f"hash long, segment long, {_KEY}, start int, n int")
    return every.join(again, "hash", "left_semi")


def _texts_in(texts: DataFrame, likely: BitFilter, inside: bool = True) -> DataFrame:
    """The texts whose row_id may be (or, not ``inside``, cannot be) among the filter's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likely.passes(batch.column(0).to_numpy()) == inside
            yield batch.filter(pa.array(found))

    rows = texts.select("row_id", "tie", "doc_id", "text")
    return rows.transform(map_batches, run, rows.schema)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(a, b, row_id, tie, start): 128-bit digests of the windows in each text's ``segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches, 64):
            rows = []
            for i, tie, text, segments in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), utf8_list(step.column(2)), step.column(3).to_pylist(), strict=True):
                a, b = _word_hashes(text.split())
                at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in segments]))
                rows.append((_roll(a, window, _ODD_A)[at].view(np.int64), _roll(b, window, _ODD_B)[at].view(np.int64), np.full(len(at), i, np.int64), np.full(len(at), tie, np.int64), at.astype(np.int32)))
            if rows:
                yield _arrow([np.concatenate(x) for x in zip(*rows, strict=True)], "a b row_id tie start")

    return texts.select("row_id", "tie", "text", "segments").transform(map_batches, run, f"a long, b long, {_KEY}, start int")


def repeated_spans(texts: DataFrame, again: DataFrame, window: int, anchor: int) -> DataFrame:
    """(row_id, tie, spans): word ranges [start, stop) covered by windows that also start earlier.

    Whole segments (the windows that one anchor stands for) come first: of equal
    segments the first in (row_id, tie, start) order stands for all, and the windows
    of the others are repeats. Where an anchor has different segments, their windows
    are compared one by one, among first segments only: each window's earliest place is in one.
    """
    met = materialize(_occurrences(texts, again, window, anchor), "segments")
    spot = F.struct("row_id", "tie", "start")
    same = ["hash", "segment", "n"]
    firsts = materialize(met.groupBy(*same).agg(F.min(spot).alias("first"), F.count("*").alias("rows")), "firsts")
    # A segment that very many texts have, or a window, is a hot key.
    copied = hot_join(met, firsts.where("rows > 1"), same, "rows").where(spot != F.col("first")).select("row_id", "tie", "start", (F.col("start") + F.col("n") + F.lit(window - 1)).alias("stop"))

    several = firsts.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1").select("hash")
    lead = firsts.join(several, "hash", "left_semi").select("first.row_id", "first.tie", F.struct("first.start", "n").alias("segment"))
    lead = materialize(lead.groupBy("row_id", "tie").agg(F.collect_set("segment").alias("segments")), "lead")
    some = _texts_in(texts, BitFilter(lead, "row_id"))
    windows = materialize(_windows(some.join(lead, ["row_id", "tie"]).where("text is not null"), window), "windows")
    least = materialize(windows.groupBy("a", "b").agg(F.min(spot).alias("first"), F.count("*").alias("seen")).where("seen > 1"), "repeats")
    later = hot_join(windows, least, ["a", "b"], "seen").where(spot != F.col("first")).select("row_id", "tie", "start", (F.col("start") + F.lit(window)).alias("stop"))
    return copied.unionByName(later).groupBy("row_id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in in_steps(batches):
        n_words, removed, shas = [], [], []
        for t, spans in zip(utf8_list(step.column(1)), step.column(2).to_pylist(), strict=True):
            words = kept = t.split() if t else []
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [s["start"] for s in spans], 1)
                np.add.at(change, [s["stop"] for s in spans], -1)
                kept = [w for w, covers in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not covers]
            n_words.append(len(words))
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield _arrow([step.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), step.column(2)], "doc_id n_words n_removed kept_sha256 spans")


def repeats_of_batch(index: FingerprintIndex, history: DataFrame, batch: DataFrame) -> DataFrame:
    """(row_id, tie, spans) of a new batch (row_id, tie, doc_id, text): what it repeats of itself or of ``history``, which ``index`` knows already.

    The batch is added to the index. Only texts with an anchor that occurs again are compared. Rows of the batch come after those of history.
    """
    again = index.add(batch)
    index.save()
    return repeated_spans(history.unionByName(batch), again, index.window, index.anchor).join(batch.select("row_id", "tie").distinct(), ["row_id", "tie"], "left_semi")


def remove_repeated_windows(docs: DataFrame, window: int = 20, batches: int = 4, anchor: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): words of repeated windows are removed but for their first place.

    Words are parted by ASCII white space. Of windows with the same words, the one in the
    smallest doc_id (there, with the smallest start) stays; all are judged on the
    input. Documents are indexed in ``batches`` of ascending ids. Null and empty
    texts have no words; a text shorter than a window loses none. Different texts
    with one id take an order of their own; repeated rows (same id and text) count as one document
    and get the same result each. Rows with a null id come before all others; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = named.withColumn("row_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    twice = not rows.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    texts = rows.withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0)) if twice else F.lit(0).cast("long"))

    cuts = rows.stat.approxQuantile("row_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    index = FingerprintIndex(spark, window, anchor)
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    again = None
    try:
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            part = texts if low is None else texts.where(F.col("row_id") > low)
            part = part if high is None else part.where(F.col("row_id") <= high)
            found = index.add(part)
            again = found if again is None else again.unionByName(found)
    finally:
        index.drop()
    spans = materialize(repeated_spans(texts, materialize(again.distinct(), "again"), window, anchor), "spans")

    # Texts without a span are done where they are read; the rest meet their spans.
    likely = BitFilter(spans, "row_id")
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    whole = _texts_in(texts, likely, inside=False).select("doc_id", "text", none.alias("spans")).transform(map_batches, _cut, _RESULT)
    cut = _texts_in(texts, likely).join(spans, ["row_id", "tie"], "left").select("doc_id", "text", "spans").transform(map_batches, _cut, _RESULT)
    return whole.unionByName(cut)
