"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Every passage of every document is a query. Weights are divided by an item's score
with itself, so that one threshold serves all items. A passage is dropped when its
terms' largest weights cannot reach the threshold (WAND), a block of items when the
block's maxima cannot (block-max); only what remains is scored, and what reaches the threshold
is verified by the overlap of five-word shingles with the item's question and answer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_steps, map_batches, materialize

SHINGLE_WORDS, OVERLAP, THRESHOLD = 5, 0.8, 0.6
#: Passages overlap by half and are at least this long; half a passage holds the longest item.
PASSAGE_WORDS = 128
#: Items and words of one index; with more, indexes are built and asked one after another.
MAX_ITEMS, MAX_WORDS, BLOCK_ITEMS = 50_000, 4_000_000, 16
K1, B = 1.5, 0.75
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def _shingles(words: list[str], n: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def split_item(words: list[str]) -> tuple[set, set]:
    """Shingles of an item's question and of its answer: the last third (five words at least) is the answer.

    Shingles that begin before the answer are the question's; a very short item is all question.
    """
    every = [tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))] if words else []
    at = len(words) - max(SHINGLE_WORDS, len(words) // 3)
    return set(every[: max(1, at)]), set(every[max(1, at) :])


@dataclass
class ItemIndex:
    """Postings by term, grouped in blocks of items; all weights are shares of an item's score with itself."""

    item_ids: np.ndarray
    items: list[list[str]]
    terms: dict[str, int]
    post_at: np.ndarray
    post_item: np.ndarray
    post_weight: np.ndarray
    block_at: np.ndarray
    block_no: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    passage_words: int

    @classmethod
    def build(cls, item_ids: list, items: list[list[str]], df: dict[str, int], n: int, mean_len: float, passage_words: int) -> ItemIndex:
        terms: dict[str, int] = {}
        rows = []
        for i, words in enumerate(items):
            count: dict[str, int] = {}
            for w in words:
                count[w] = count.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / max(mean_len, 1e-9))
            weights = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in count.items()}
            whole = sum(weights.values())
            for w, x in weights.items():
                rows.append((terms.setdefault(w, len(terms)), i, x / whole))
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        item = np.array([r[1] for r in rows], np.int64)
        weight = np.array([r[2] for r in rows], np.float64)
        size = len(terms)
        block = item // BLOCK_ITEMS
        start = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(rows) else np.zeros(0, np.int64)
        block_max = np.maximum.reduceat(weight, start) if len(rows) else weight
        term_max = np.zeros(size + 1)
        np.maximum.at(term_max, term, weight)
        return cls(np.array(item_ids, object), items, terms, np.searchsorted(term, np.arange(size + 1)), item, weight, np.searchsorted(term[start], np.arange(size + 1)), block[start], block_max, term_max, passage_words)

    def search(self, words: list[str], threshold: float) -> list[tuple[int, int, float]]:
        """(passage start, place of item, score) for every passage of ``words`` and item with score >= threshold."""
        half = self.passage_words // 2
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        # A word of half h belongs to the passages h - 1 and h; the last half is its own passage only if there is one half.
        halves = known // half
        last = max(0, -(-len(words) // half) - 2)
        passage = np.concatenate((np.minimum(halves, last), np.maximum(np.minimum(halves - 1, last), 0)))
        width = len(self.terms) + 1
        keys = np.unique(passage * width + np.concatenate((ids[known], ids[known])))
        passage, term = keys // width, keys % width
        slack = threshold - 1e-9
        bound = np.bincount(passage, self.term_max[term])
        live = bound[passage] >= slack
        passage, term = passage[live], term[live]
        if not len(term):
            return []
        # Bounds of blocks of items.
        at, row = self._expand(self.block_at, term)
        blocks = int(self.block_no.max()) + 1
        pairs, where = np.unique(passage[row] * blocks + self.block_no[at], return_inverse=True)
        live_pairs = pairs[np.bincount(where, self.block_max[at]) >= slack]
        if not len(live_pairs):
            return []
        keep = np.isin(passage, live_pairs // blocks)
        passage, term = passage[keep], term[keep]
        at, row = self._expand(self.post_at, term)
        alive = np.isin(passage[row] * blocks + self.post_item[at] // BLOCK_ITEMS, live_pairs)
        at, row = at[alive], row[alive]
        pairs, where = np.unique(passage[row] * len(self.items) + self.post_item[at], return_inverse=True)
        scores = np.bincount(where, self.post_weight[at])
        good = scores >= slack
        return [(int(p // len(self.items)) * half, int(p % len(self.items)), float(s)) for p, s in zip(pairs[good], scores[good], strict=True)]

    @staticmethod
    def _expand(offsets: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the given terms' lists, and the row of ``term`` that each is from."""
        start, count = offsets[term], offsets[term + 1] - offsets[term]
        row = np.repeat(np.arange(len(term)), count)
        return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row], row

    def leaks(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(place of item, score, question overlap, answer overlap, word offset) of verified leaks, the best passage of each item."""
        words = words_of(text)
        best: dict[int, tuple] = {}
        shingles: dict[int, set] = {}
        for start, item, score in self.search(words, threshold):
            if start not in shingles:
                shingles[start] = _shingles(words[start : start + self.passage_words])
            question, answer = split_item(self.items[item])
            q, a = len(question & shingles[start]), len(answer & shingles[start])
            if q + a >= overlap * (len(question) + len(answer)) and q and (a or not answer):
                found = (score, q / len(question), a / len(answer) if answer else 1.0, start)
                if item not in best or found[:3] > best[item][:3]:
                    best[item] = found
        return [(item, *found) for item, found in sorted(best.items())]


def _index(name: str, sent) -> ItemIndex:
    """One index for each Python worker."""
    return held(f"items {name}", lambda: sent.value)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at_word): verified leaks, one row per row of ``docs`` and item.

    Words are runs of letters and digits in lower case. Items and texts that are null or
    without a word leak nothing; items with equal texts are each reported; repeated rows are reported
    again; a row with a null id is reported with it, and so is an item with a null id. Other columns of both tables are ignored.
    """
    return _leaking(docs, items, threshold, overlap, id_col, text_col).drop("tie")


def _leaking(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``find_leaks`` returns, with ``tie``, the hash of the text."""
    spark = docs.sparkSession
    tests = materialize(items.select("item_id", "text").where("text is not null"), "items")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])

    worded = tests.transform(map_batches, words, "item_id long, words array<string>").where(F.size("words") > 0)
    # An item's words decide how long its passages are: the least power of two times PASSAGE_WORDS of which half holds it.
    worded = materialize(worded.withColumn("doublings", F.greatest(F.lit(0), F.ceil(F.log2(2 * (F.size("words") + 1) / PASSAGE_WORDS))).cast("int")), "worded")
    totals = worded.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    result = "doc_id long, tie long, item_id long, score double, question_overlap double, answer_overlap double, at_word long"
    if not totals.n:
        return spark.createDataFrame([], result)
    document_counts = worded.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    # One row for each doubling of item length: a long item makes its own passages long, and no others.
    sizes = worded.groupBy("doublings").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).orderBy("doublings").collect()
    chunks = [(r.doublings, k, c) for r in sizes for c in [max(-(-r.n // MAX_ITEMS), -(-r.words // MAX_WORDS))] for k in range(c)]
    found = None
    for doublings, k, parts in chunks:
        # Each index holds a bounded number of items, with statistics of all of them.
        passage_words = PASSAGE_WORDS << doublings
        part = worded.where(F.col("doublings") == doublings).where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == k)
        mine = part.orderBy("item_id").toArrow()
        used = part.select(F.explode(F.array_distinct("words")).alias("w")).distinct()
        df = document_counts.join(used, "w", "left_semi").toArrow()
        counts = dict(zip(df.column("w").to_pylist(), df.column("df").to_pylist(), strict=True))
        index = ItemIndex.build(mine.column("item_id").to_pylist(), mine.column("words").to_pylist(), counts, totals.n, totals.mean, passage_words)
        sent, name = spark.sparkContext.broadcast(index), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent)
            for step in in_steps(batches):
                out = [(i, tie, index.item_ids[m[0]], *m[1:]) for i, t, tie in zip(*(c.to_pylist() for c in step.columns), strict=True) for m in index.leaks(t, threshold, overlap)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "tie", "item_id", "score", "question_overlap", "answer_overlap", "at_word"])

        some = rows.transform(map_batches, search, result, model=True)
        found = some if found is None else found.unionByName(some)
    return found


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a verified leak; rows with a null id go too, clean rows with the id of a leaking one stay."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = _leaking(docs, items, **options).select(F.col("doc_id").alias("__gone_id"), F.col("tie").alias("__gone_tie")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs[text_col]) == gone["__gone_tie"])
    return docs.join(gone, same, "left_anti")
