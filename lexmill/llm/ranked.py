"""Ranked lexical search by a dual-tree walk over items and documents.

Nodes of both trees hold coordinate maxima: a node of documents the largest weighted impact of each term, a node
of items the terms of any of them. A pair of nodes is left out, with all its documents and items, if its bound is below the weakest
k-th score that the node's items have so far; what remains is split, and pairs of items and documents are scored in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

#: Items and terms of one block of items; with more, blocks are searched one after another.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 200_000
#: Items of a leaf, documents of a leaf, and documents and terms of a batch, whose tree a task holds.
ITEM_LEAF, DOC_LEAF, BATCH_DOCS, BATCH_ENTRIES = 16, 64, 4096, 1 << 20
#: One document in so many gives the first bounds; every document is searched afterwards.
SEED_SHARE = 64
#: Bytes of a text that are split at once.
SPLIT_BYTES = 1 << 20
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case, in parts of a text."""
    plain = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SPLIT_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class ItemTree:
    """Items in an order that puts similar ones together, their terms, and leaves of ITEM_LEAF items under one root."""

    item_ids: list
    weights: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    leaf_terms: list[np.ndarray]
    leaf_most: list[int]

    @classmethod
    def build(cls, items: list[tuple[object, list[int]]], weights: np.ndarray) -> ItemTree:
        order = _similar_order(items, weights)
        items = [items[i] for i in order]
        term = np.concatenate([np.array(t, np.int64) for _, t in items])
        item = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
        by_term = np.argsort(term, kind="stable")
        leaves = [items[at : at + ITEM_LEAF] for at in range(0, len(items), ITEM_LEAF)]
        return cls(
            [i for i, _ in items],
            weights,
            np.searchsorted(term[by_term], np.arange(len(weights) + 1)),
            item[by_term],
            [np.unique(np.concatenate([t for _, t in leaf])).astype(np.int64) for leaf in leaves],
            [max(len(t) for _, t in leaf) for leaf in leaves],
        )

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the given terms one after another, and the row of ``term`` that each belongs to."""
        start, count = self.post_at[term], self.post_at[term + 1] - self.post_at[term]
        row = np.repeat(np.arange(len(term)), count)
        return self.post_item[np.arange(len(row)) - np.repeat(np.cumsum(count) - count - start, count)], row

    def leaf_bounds(self, maxima: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The most that an item of each of ``leaves`` can score with a document below ``maxima``: no item has more terms than the leaf's longest."""
        out = np.zeros(len(leaves), np.int64)
        for k, leaf in enumerate(leaves):
            values, most = maxima[self.leaf_terms[leaf]], self.leaf_most[leaf]
            out[k] = values.sum() if len(values) <= most else np.partition(values, len(values) - most)[-most:].sum()
        return out


def _similar_order(items: list[tuple[object, list[int]]], weights: np.ndarray, width: int = 256) -> list[int]:
    """Items split in halves along the main direction of their hashed weights, again and again."""
    x = np.zeros((len(items), width))
    for i, (_, terms) in enumerate(items):
        np.add.at(x[i], np.array(terms, np.int64) % width, weights[terms])

    def halves(some: np.ndarray) -> list[int]:
        if len(some) <= ITEM_LEAF:
            return some.tolist()
        centred = x[some] - x[some].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        some = some[np.argsort(centred @ direction, kind="stable")]
        middle = len(some) // 2 // ITEM_LEAF * ITEM_LEAF or ITEM_LEAF
        return halves(some[:middle]) + halves(some[middle:])

    return halves(np.arange(len(items)))


class Search:
    """The best documents of each item so far, while batches of documents come."""

    def __init__(self, tree: ItemTree, k: int, least: np.ndarray):
        self.tree, self.k, self.least = tree, k, np.maximum(least, 1)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in tree.item_ids]
        self.leaf_of = np.arange(len(tree.item_ids)) // ITEM_LEAF
        self.scored = 0

    def weakest(self, leaves: np.ndarray) -> np.ndarray:
        starts = np.arange(0, len(self.least), ITEM_LEAF)
        return np.minimum.reduceat(self.least, starts)[leaves]

    def add(self, ids: list, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """A batch: entries (place in ``ids``, term, weighted impact), by document."""
        tree, width, count = self.tree, len(self.tree.weights), len(ids)
        leaves = np.arange(len(tree.leaf_terms))
        root = np.zeros(width, np.int64)
        np.maximum.at(root, term, value)
        leaves = leaves[tree.leaf_bounds(root, leaves) >= self.weakest(leaves)]
        if not len(leaves):
            return
        # Documents that suit the same leaf of items, and as well, come together.
        suits = np.empty((len(leaves), count))
        for k, leaf in enumerate(leaves):
            inside = np.zeros(width, bool)
            inside[tree.leaf_terms[leaf]] = True
            suits[k] = np.bincount(doc, value * inside[term], count)
        place = np.empty(count, np.int64)
        place[np.lexsort((-suits.max(0), suits.argmax(0)))] = np.arange(count)
        by_place = np.argsort(place[doc], kind="stable")
        doc, term, value = doc[by_place], term[by_place], value[by_place]
        node = place[doc] // DOC_LEAF
        cuts = np.searchsorted(node, np.arange(-(-count // DOC_LEAF) + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                self._leaf(ids, doc[a:b], term[a:b], value[a:b], leaves)

    def _leaf(self, ids: list, doc: np.ndarray, term: np.ndarray, value: np.ndarray, leaves: np.ndarray) -> None:
        tree = self.tree
        maxima = np.zeros(len(tree.weights), np.int64)
        np.maximum.at(maxima, term, value)
        alive = np.zeros(len(tree.leaf_terms), bool)
        alive[leaves] = tree.leaf_bounds(maxima, leaves) >= self.weakest(leaves)
        if not alive.any():
            return
        present = np.flatnonzero(maxima)
        item, row = tree.postings(present)
        bound = np.zeros(len(self.least), np.int64)
        np.add.at(bound, item, maxima[present[row]])
        live = alive[self.leaf_of] & (bound >= self.least)
        if not live.any():
            return
        docs, local = np.unique(doc, return_inverse=True)
        item, row = tree.postings(term)
        kept = live[item]
        item, row = item[kept], row[kept]
        scores = np.zeros((len(docs), len(self.least)), np.int64)
        np.add.at(scores, (local[row], item), value[row])
        self.scored += len(docs) * int(live.sum())
        for i in np.flatnonzero((scores >= self.least).any(0)):
            best = self.best[i]
            best += [(-int(scores[d, i]), ids[docs[d]] is None, ids[docs[d]] or 0) for d in np.flatnonzero(scores[:, i] >= self.least[i])]
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.least[i] = max(self.least[i], -best[-1][0])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms in blocks that a task can hold; items stream past the driver."""
    block, terms = [], 0
    for item_id, text in items.select(id_col, text_col).toLocalIterator():
        own = sorted(set().union(*terms_of(text)))
        if not own:
            continue
        if block and (len(block) == BLOCK_ITEMS or terms + len(own) > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((item_id, own))
        terms += len(own)
    if block:
        yield block


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): of each document with a term, its number of terms, and the counts of those that items have."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, known = 0, []
                for words in terms_of(text):
                    n += len(words)
                    ids = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                    known.append(ids[ids >= 0])
                if n:
                    term, tf = np.unique(np.concatenate(known), return_counts=True)
                    rows.append((doc_id, n, term.tobytes(), tf.astype(np.int64).tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "term", "tf"])

    return map_batches(docs, run, "doc_id long, n long, term binary, tf binary")


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                counts[np.frombuffer(terms, np.int32)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    found = vectors.select("term").transform(map_batches, run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def _best(vectors: DataFrame, tree: ItemTree, n: int, length: int, k: int, least: np.ndarray) -> DataFrame:
    """(place, doc_id, score): the ``k`` best documents of each item, by its place in the tree, that score ``least`` or more."""
    sent = vectors.sparkSession.sparkContext.broadcast((tree, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, least = sent.value
        search = Search(tree, k, least)
        ids, terms, counts, slopes, size = [], [], [], [], 0

        def give() -> None:
            lens = [len(t) for t in terms]
            doc, term, tf = np.repeat(np.arange(len(ids)), lens), np.concatenate(terms).astype(np.int64), np.concatenate(counts)
            value = tree.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(slopes, np.int64), lens)))
            search.add(ids, doc, term, value)

        for batch in batches:
            for doc_id, words, term, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not term:
                    continue
                ids.append(doc_id)
                terms.append(np.frombuffer(term, np.int32))
                counts.append(np.frombuffer(tf, np.int64))
                slopes.append(10 + 90 * words * n // length)
                size += len(terms[-1])
                if len(ids) == BATCH_DOCS or size > BATCH_ENTRIES:
                    give()
                    ids, terms, counts, slopes, size = [], [], [], [], 0
        if ids:
            give()
        rows = [(i, None if absent else doc_id, -score) for i, best in enumerate(search.best) for score, absent, doc_id in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["place", "doc_id", "score"])

    found = map_batches(vectors.select("doc_id", "n", "term", "tf"), run, "place long, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``k`` best rows of ``docs`` with a score above 0, fewer if there are fewer.

    Equal scores rank by ascending id, null ids last; repeated rows of either table count and rank by themselves. Null and empty texts have no
    terms: such items give no row, such documents are not counted. An empty table gives no row. Texts are read once for each block of items;
    each task keeps ``k`` documents an item, and rows below what a first share of the documents reaches leave no task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"place long, item_id {items.schema[item_id].dataType.simpleString()}"
    out = None
    for block in _blocks(items, item_id, item_text):
        terms = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        vectors = materialize(_vectors(rows, terms), "vectors")
        totals = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not totals.n:
            break
        weights = np.array([weight(totals.n, df) for df in _document_counts(vectors, len(terms)).tolist()], np.int64)
        tree = ItemTree.build([(i, [terms[t] for t in own]) for i, own in block], weights)
        least = np.zeros(len(block), np.int64)
        seeds = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0)
        for r in _best(seeds, tree, totals.n, totals.length, k, least).where(F.col("rank") == k).collect():  # a row for each item of the block
            least[r.place] = r.score
        best = materialize(_best(vectors, tree, totals.n, totals.length, k, least), "best")
        discard(vectors)
        names = F.broadcast(spark.createDataFrame(list(enumerate(tree.item_ids)), schema))
        found = best.join(names, "place").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema.split(", ")[1] + ", rank int, doc_id long, score long")
