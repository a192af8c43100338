"""Batch retrieval: BM25 over postings, exact cosine, reciprocal-rank fusion, Jaccard rerank.

A batch of queries is a table. A document's terms are counted where its text is, and stay together: what is searched is a
document's own list, so no postings are shuffled. Statistics are of the whole corpus. Vectors are scored block by block against a matrix of queries, and
each task keeps only its own best.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored

#: Fixed values of the ranking functions.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


#: Query terms that are sent to every task, and bytes of query vectors in a block.
BROADCAST_TERMS, BLOCK_BYTES = 100_000, 16 << 20


def counted(words: DataFrame) -> DataFrame:
    """(id, dl, terms, tfs, ...) of documents (id, tokens, ...): the number of tokens, the different ones and how often each occurs, told where the document is; of null tokens null."""
    kind = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    rest = [c for c in words.columns if c not in ("id", "tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            coded = pc.list_flatten(lists).dictionary_encode()
            size = max(1, len(coded.dictionary))
            key, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=batch.num_rows)))).astype(np.int32)
            of = lambda values: pa.ListArray.from_arrays(pa.array(ends), values, mask=pc.is_null(lists))  # noqa: B023, E731
            columns = [batch.column(0), pc.list_value_length(lists).cast(pa.int64()), of(coded.dictionary.take(pa.array(key % size))), of(pa.array(tf.astype(np.int64))), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dl", "terms", "tfs", *rest])

    more = "".join(f", `{c}` {kind[c]}" for c in rest)
    return words.select("id", "tokens", *rest).mapInArrow(run, f"id {kind['id']}, dl long, terms array<string>, tfs array<long>{more}")


def postings(documents: DataFrame) -> DataFrame:
    """(term, id, tf) of documents as ``counted`` tells them."""
    pairs = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    return documents.select("id", pairs.alias("p")).select("p.term", "id", "p.tf")


def statistics(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) of all terms, and (n, mean) of all documents, from one pass over what ``counted`` tells: the null term counts the documents."""
    rows = documents.select("dl", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    found = stored(rows.groupBy("term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term").isNull(), F.col("dl"))).alias("mean")), "terms")
    return found.where("term is not null").select("term", "df"), found.where("term is null").select(F.col("df").alias("n"), "mean")


def inverse_frequencies(counted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) from the document frequencies of all terms; a negative weight becomes a share of the mean weight.

    The mean is taken over the different weights and their numbers of terms: a sum over all terms loses digits, and which depends on their order.
    """
    raw = counted.join(F.broadcast(corpus.select("n"))).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))  # one row
    weights = raw.groupBy("raw").agg(F.count("*").alias("terms"))
    floor = weights.agg((F.sum(F.col("raw") * F.col("terms")) / F.sum("terms") * EPSILON).alias("floor"))
    return raw.join(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def keyword_index(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """An index of ``docs``, whose texts are read once: words (id, dl, terms, tfs and the columns to ``keep``), terms (term, df, idf), corpus (n, mean), and as views postings (term, id, tf) and chunk_stats (id, dl)."""
    body = F.concat_ws(" ", "title", "content") if text is None else text
    words = stored(counted(docs.select(F.col(id_col).alias("id"), T.tokens(body).alias("tokens"), *keep)), "counted")
    found, corpus = statistics(words)
    return index_of(words, inverse_frequencies(found, corpus), corpus)


def index_of(words: DataFrame, terms: DataFrame, corpus: DataFrame) -> dict[str, DataFrame]:
    return {"words": words, "terms": terms, "corpus": corpus, "postings": postings(words), "chunk_stats": words.select("id", "dl")}


def ranked(hits: DataFrame, query: str, score: str, ident: str, limit: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(ident))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bm25(queries: DataFrame, index: dict[str, DataFrame], limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): min-max normalised over all documents that share a term and are ``allowed`` (id), then the best ``limit``.

    An index that has its documents' words scores each document in one pass against the terms of a stated set of queries, sent in
    blocks; one that has postings only joins them.
    """
    asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = stored(asked.join(index["terms"], "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    scored = (_by_documents if "words" in index else _by_postings)(weights, index, limit, allowed)
    raw = stored(scored, "scores")
    ends = raw.groupBy("query_id").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    share = F.when(F.col("most") == F.col("least"), 1.0).otherwise((F.col("raw") - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0.0)))
    return ranked(raw.join(ends, "query_id").select("query_id", "id", F.round(share, 9).alias("score")), "query_id", "score", "id", limit)


def _by_postings(weights: DataFrame, index: dict[str, DataFrame], limit: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, raw, low, high) of all documents that share a term with a query, by a join with the postings."""
    matches = weights.select("term").distinct().join(index["postings"], "term").join(index["chunk_stats"], "id")
    if allowed is not None:
        matches = matches.join(allowed.select("id"), "id", "left_semi")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    raw = matches.join(weights, "term").join(F.broadcast(index["corpus"].select("mean"))).groupBy("query_id", "id").agg(F.sum(part).alias("raw"))  # one row
    return raw.select("query_id", "id", "raw", F.col("raw").alias("low"), F.col("raw").alias("high"))


#: Documents that a task scores together, and cells of documents by queries at once; with many queries fewer documents.
SCORED_ROWS, SCORED_CELLS = 512, 1 << 18


def _by_documents(weights: DataFrame, index: dict[str, DataFrame], limit: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, raw, low, high): from each task, the documents that can be among its best ``limit`` of a query, and the ends of all its scores of it.

    Scores that differ by less than rounding shows are kept, of equal ones the first ``limit`` ids. Queries are sent in blocks of BROADCAST_TERMS rows.
    """
    words = index["words"].select("id", "dl", "terms", "tfs")
    if allowed is not None:
        words = words.join(allowed.select("id"), "id", "left_semi")
    kinds = [weights.schema["query_id"].dataType.simpleString(), words.schema["id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, raw double, low double, high double"
    mean = index["corpus"].first()["mean"] or 0.0
    blocks = -(-weights.count() // BROADCAST_TERMS)
    found = weights.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        some = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("term").toArrow()
        if some.num_rows:
            found = found.unionByName(words.mapInArrow(_scorer(some, mean, limit), schema))
    return found


def _scorer(weights: pa.Table, mean: float, limit: int):
    names = weights.column("query_id").combine_chunks().dictionary_encode()
    term_names = weights.column("term").combine_chunks().dictionary_encode()
    terms, queries = term_names.dictionary, names.dictionary
    term, query, weight = (np.asarray(x) for x in (term_names.indices, names.indices, weights.column("weight").to_numpy()))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))  # rows are ordered by term
    rows = max(1, min(SCORED_ROWS, SCORED_CELLS // max(1, len(queries))))
    slack = 2e-9 * np.bincount(query, np.abs(weight), len(queries)) * (K1 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(queries), np.inf), np.full(len(queries), -np.inf)
        floor = np.full(len(queries), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                counted = part.num_columns > 2  # (id, dl, terms, tfs), else (id, tokens)
                lists = part.column(2 if counted else 1)
                length = pc.fill_null(part.column(1) if counted else pc.list_value_length(lists), 0).to_numpy().astype(np.float64)
                place = pc.index_in(pc.list_flatten(lists), value_set=terms).to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(lists).to_numpy()
                there = ~np.isnan(place)
                key, at_key, tf = np.unique(row[there] * len(terms) + place[there].astype(np.int64), return_index=True, return_counts=True)
                if counted:
                    tf = pc.list_flatten(part.column(3)).to_numpy()[there][at_key]
                row, place = key // len(terms), key % len(terms)
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
                count = starts[place + 1] - starts[place]
                each = np.repeat(np.arange(len(key)), count)
                post = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + starts[place][each]
                cell = row[each] * len(queries) + query[post]
                size = part.num_rows * len(queries)
                raw = np.bincount(cell, weight[post] * share[each], size).reshape(-1, len(queries))
                matched = np.bincount(cell, minlength=size).reshape(-1, len(queries)) > 0
                low = np.minimum(low, np.where(matched, raw, np.inf).min(0))
                high = np.maximum(high, np.where(matched, raw, -np.inf).max(0))
                docs, asked = np.nonzero(matched & (raw >= floor - slack))
                kept.append((asked, raw[docs, asked], part.column(0).take(pa.array(docs))))
                if sum(len(k[0]) for k in kept) > 8 * limit * len(queries):
                    kept = [_best(kept, limit, slack)]
                    floor = _floors(kept[0], limit, floor)
        if kept:
            asked, raw, ids = _best(kept, limit, slack)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(asked)), ids, pa.array(raw), pa.array(low[asked]), pa.array(high[asked])], names=["query_id", "id", "raw", "low", "high"])

    return run


def _best(kept: list[tuple[np.ndarray, np.ndarray, pa.Array]], limit: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each query what is not below its ``limit``-th score by more than ``slack``; of equal scores the first ``limit`` ids."""
    asked, raw = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    ids = pa.concat_arrays([k[2] for k in kept])
    if not len(asked):
        return asked, raw, ids
    by_id = pc.rank(ids, "ascending", tiebreaker="first").to_numpy()
    order = np.lexsort((by_id, -raw, asked))
    asked, raw = asked[order], raw[order]
    nth = lambda new: np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    fresh = np.concatenate(([True], asked[1:] != asked[:-1]))
    other = fresh | np.concatenate(([True], raw[1:] != raw[:-1]))
    at = nth(fresh)
    last = np.full(len(slack), -np.inf)
    last[asked[at == limit - 1]] = raw[at == limit - 1]
    good = (raw >= (last - slack)[asked]) & (nth(other) < limit)
    return asked[good], raw[good], ids.take(pa.array(order[good]))


def _floors(best: tuple[np.ndarray, np.ndarray, pa.Array], limit: int, floor: np.ndarray) -> np.ndarray:
    """The ``limit``-th score of each query that has as many."""
    asked, raw, _ = best
    at = np.arange(len(asked)) - np.searchsorted(asked, asked)
    floor = floor.copy()
    floor[asked[at == limit - 1]] = raw[at == limit - 1]
    return floor


def vector(queries: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, score, rank) by exact cosine of a stated set of query vectors against all rows, in double precision.

    The cosine of a zero vector, or of vectors of different lengths, is 0. Query vectors are sent in blocks of BLOCK_BYTES; with more,
    rows are read once for each block. A task yields its own best ``limit`` of each query.
    """
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v is not null")
    kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {kind[0]}, id {kind[1]}, score double"
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    found = queries.sparkSession.createDataFrame([], schema)
    for some in _in_blocks(asked, "query_id", 8 * F.size("v")):
        for size in pc.unique(pc.list_value_length(some.column("v"))).to_pylist():
            mine = some.filter(pc.equal(pc.list_value_length(some.column("v")), size))
            names, matrix = mine.column("query_id").combine_chunks(), _unit(np.array(mine.column("v").to_pylist(), np.float64).reshape(-1, size))

            def best(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix, size=size) -> Iterator[pa.RecordBatch]:
                kept: list[pa.Table] = []
                for batch in batches:
                    same = pc.equal(pc.list_value_length(batch.column(1)), size)
                    for part, scores in ((batch.filter(same), True), (batch.filter(pc.invert(same)), False)):
                        if part.num_rows:
                            x = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)) if scores else None
                            told = np.round(matrix @ x.T, 9) if scores else np.zeros((len(names), part.num_rows))
                            kept.append(_top(names, part.column(0), told, limit))
                    if len(kept) > 8:
                        kept = [_cut(pa.concat_tables(kept), limit)]
                if kept:
                    yield from _cut(pa.concat_tables(kept), limit).to_batches()

            found = found.unionByName(rows.mapInArrow(best, schema))
    return ranked(found, "query_id", "score", "id", limit)


def _in_blocks(rows: DataFrame, by: str, size: Column) -> Iterator[pa.Table]:
    """``rows`` in blocks of about BLOCK_BYTES by the hash of a column; the driver holds one block at a time."""
    kept = stored(rows, "asked")
    blocks = -(-(kept.agg(F.sum(size.cast("long"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for block in range(blocks):
        some = kept.where(F.pmod(F.xxhash64(by), F.lit(blocks)) == block).orderBy(by).toArrow()
        if some.num_rows:
            yield some


def containing(docs: DataFrame, id_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """(needle_col, id_col): documents (id, text) that contain each of a stated set of needles (id, text); empty needles are in none.

    Every task walks its texts once with an automaton of the needles. Needles are sent in blocks of BLOCK_BYTES; with more, texts are read once for each block.
    """
    kinds = needles.schema[needle_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    schema = f"`{needle_col}` {kinds[0]}, `{id_col}` {kinds[1]}"
    found = docs.sparkSession.createDataFrame([], schema)
    for mine in _in_blocks(needles.select(needle_col, "text").where("text <> ''"), needle_col, F.octet_length("text")):

        def walk(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            automaton, names = ahocorasick.Automaton(), {}
            for name, text in zip(mine.column(0).to_pylist(), mine.column(1).to_pylist(), strict=True):
                names.setdefault(text, []).append(name)
            for text, same in names.items():
                automaton.add_word(text, tuple(same))
            automaton.make_automaton()
            for batch in batches:
                pairs = [(n, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for n in {n for _, same in automaton.iter(t) for n in same}]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], c.type) for k, c in ((0, mine.column(0)), (1, batch.column(0)))], names=[needle_col, id_col])

        found = found.unionByName(docs.select(id_col, "text").mapInArrow(walk, schema))
    return found.distinct()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _top(names: pa.Array, ids: pa.Array, scores: np.ndarray, limit: int) -> pa.Table:
    """For each query its best ids of a block, by score and then id."""
    order = np.argsort(pc.rank(ids, "ascending", tiebreaker="first").to_numpy())
    ids, scores = ids.take(pa.array(order)), scores[:, order]
    best = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
    rows = np.repeat(np.arange(len(names)), best.shape[1])
    return pa.table({"query_id": names.take(pa.array(rows)), "id": ids.take(pa.array(best.ravel())), "score": pa.array(scores[rows, best.ravel()] + 0.0)})


def _cut(table: pa.Table, limit: int) -> pa.Table:
    """The best ``limit`` rows of each query."""
    table = table.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    code = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return table.filter(pa.array(place < limit))


def fuse(first: DataFrame, second: DataFrame, limit: int = 8, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings: a sum over a union, no join."""
    both = first.select("query_id", "id", "rank", F.lit("bm25").alias("origin")).unionByName(second.select("query_id", "id", "rank", F.lit("vector").alias("origin")))
    summed = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origin"))
    return ranked(summed, "query_id", "score", "id", limit)


#: How many hits each stage keeps where nothing else is asked.
DEPTHS = {"bm25": 20, "vector": 20, "fused": 8, "final": 5}
MODES = ("bm25", "vector", "hybrid", "hybrid_rerank")


def search(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None = None, mode: str = "hybrid_rerank", where: Column | None = None, top_k: int | None = None, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query, query_vector) by one of MODES.

    ``where`` is a condition on documents: it applies to what is returned and normalised, not to the corpus statistics. ``top_k``, 1 to 200,
    makes every stage keep that many at least. ``threshold`` is on the scale of the mode's last score.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if top_k is not None and not 1 <= top_k <= 200:
        raise ValueError("top_k is from 1 to 200")
    depth = {k: max(v, top_k or 0) for k, v in DEPTHS.items()}
    keep = top_k or DEPTHS["final"]
    allowed = None if where is None else stored(docs.where(where).select(F.col("doc_id").alias("id")), "allowed")
    by_words = bm25(queries, keyword_index(docs), depth["bm25"], allowed) if mode != "vector" else None
    if mode == "bm25":
        found = by_words
    else:
        ours = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
        by_vector = vector(queries.where("query_vector is not null"), ours, depth["vector"])
        found = by_vector if mode == "vector" else fuse(by_words, by_vector, depth["fused"])
        if mode == "hybrid_rerank":
            found = rerank(found, queries, docs, depth["final"], threshold)
    kept = found.where(F.col("score") >= threshold).select("query_id", "id", "score")
    return ranked(kept, "query_id", "score", "id", keep)


def rerank_faults(results: DataFrame) -> DataFrame:
    """(query_id, fault) for answers of a rerank provider (query_id, hits, order: array<struct<index, score>>) that cannot be used; null for the others."""
    index, score = F.transform("order", lambda x: x["index"]), F.transform("order", lambda x: x["score"])
    bad_index = (F.size(F.array_distinct(index)) < F.size(index)) | F.exists(index, lambda i: ~i.between(0, F.col("hits") - 1))
    bad_score = F.exists(score, lambda s: s.isNull() | F.isnan(s) | ~s.between(0.0, 1.0))
    return results.select("query_id", F.when(bad_index, "invalid_result_index").when(bad_score, "invalid_result_score").when(F.size("order") == 0, "empty_results").alias("fault"))


def unranked(hits: DataFrame) -> DataFrame:
    """The order as it is, in place of a rerank: scores fall from the number of hits to 1."""
    return hits.withColumn("score", (F.count("*").over(Window.partitionBy("query_id")) - F.col("rank") + 1).cast("double"))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, limit: int = 5, threshold: float = 0.0) -> DataFrame:
    """Jaccard overlap of query and title + content tokens, best ``limit`` at or over ``threshold``."""
    body = docs.select(F.col("doc_id").alias("id"), T.tokens(F.concat_ws(" ", "title", "content")).alias("body"))
    asked = queries.select("query_id", T.tokens(F.col("query")).alias("asked"))
    scored = hits.select("query_id", "id").join(body, "id").join(asked, "query_id").select("query_id", "id", F.round(T.jaccard(F.col("asked"), F.col("body")), 9).alias("score"))
    return ranked(scored.where(F.col("score") >= threshold), "query_id", "score", "id", limit)
