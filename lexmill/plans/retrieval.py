"""Registered queries: keyword, vector, fused and reranked retrieval, answers and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, chunking, evaluation, retrieval
from ..registry import query
from ..sources import tables

#: Documents as the oracles see them, and the tokens of a text.
DOCS = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang AS region, source AS source_name, n_chars AS word_count FROM documents)"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]')"


BM25 = f"""{DOCS},
words AS (SELECT doc_id AS id, {toks("title || ' ' || content")} AS t FROM docs),
stats AS (SELECT id, len(t) AS dl FROM words),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM words) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM words) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM stats)))) AS raw
  FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN stats USING (id) GROUP BY 1, 2),
norm AS (SELECT query_id, id, round(CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END, 9) AS score FROM scored WINDOW w AS (PARTITION BY query_id)),
bm25 AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM norm) WHERE rank <= 20)"""
VECTOR = """qv AS (SELECT b.item_id AS query_id, e.embedding AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cos AS (SELECT query_id, vec_id AS id, round(coalesce(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 0), 9) AS score FROM qv, embeddings),
vec AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos) WHERE rank <= 20)"""
FUSED = """both_lists AS (SELECT query_id, id, rank, 'bm25' AS origin FROM bm25 UNION ALL SELECT query_id, id, rank, 'vector' FROM vec),
sums AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origin FROM both_lists GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, id, score, origin, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sums) WHERE rank <= 8)"""
RERANKED = f"""pairs AS (SELECT f.query_id, f.id, {toks("b.text")} AS q, {toks("d.title || ' ' || d.content")} AS t FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN docs d ON d.doc_id = f.id),
jac AS (SELECT query_id, id, round(len(list_intersect(q, t))::DOUBLE / greatest(len(list_distinct(list_concat(q, t))), 1), 9) AS score FROM pairs),
reranked AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM jac) WHERE rank <= 5)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(questions(spark, sf), retrieval.keyword_index(tables.documents(spark, sf)))


def _vector(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "embeddings")
    asked = tables.read(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.vector(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fuse(_bm25(spark, sf), _vector(spark, sf))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rerank(_fused(spark, sf), questions(spark, sf), tables.documents(spark, sf))


@query("search_bm25", f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25")
def search_bm25(spark, sf):
    return _bm25(spark, sf).select("query_id", "id", "score", "rank")


@query("search_vector", f"WITH {VECTOR} SELECT query_id, id, score, rank FROM vec")
def search_vector(spark, sf):
    return _vector(spark, sf).select("query_id", "id", "score", "rank")


@query("search_hybrid", f"WITH {BM25}, {VECTOR}, {FUSED} SELECT query_id, id, score, origin, rank FROM fused")
def search_hybrid(spark, sf):
    return _fused(spark, sf).select("query_id", "id", "score", "origin", "rank")


@query("search_hybrid_rerank", f"WITH {BM25}, {VECTOR}, {FUSED}, {RERANKED} SELECT query_id, id, score, rank FROM reranked")
def search_hybrid_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "id", "score", "rank")


FILTERED = BM25.replace("norm AS (SELECT query_id, id,", "kept AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'en'), norm AS (SELECT query_id, id,").replace("FROM scored WINDOW w", "FROM kept WINDOW w").replace("rank <= 20", "rank <= 30")


@query("search_filtered", f"WITH {FILTERED} SELECT query_id, id, score, rank FROM bm25 WHERE score >= 0.1")
def search_filtered(spark, sf):
    """Keyword search among documents of one region, thirty hits at most and above a score."""
    asked = questions(spark, sf).withColumn("query_vector", F.lit(None).cast("array<float>"))
    return retrieval.search(asked, tables.documents(spark, sf), mode="bm25", where=F.col("region") == "en", top_k=30, threshold=0.1)


@query("rerank_faults", "SELECT o_orderkey AS query_id, CASE WHEN count(DISTINCT l_linenumber) < count(*) OR max(l_linenumber) > 6 THEN 'invalid_result_index' WHEN max(l_quantity) > 48 THEN 'invalid_result_score' END AS fault FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rerank_faults(spark, sf):
    """Answers of a rerank provider that name a hit twice or none, or a score out of range."""
    line = tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("index"), (F.col("l_quantity") / 48).alias("score"))
    return retrieval.rerank_faults(line.groupBy("query_id").agg(F.lit(6).alias("hits"), F.collect_list(F.struct("index", "score")).alias("order")))


@query("unranked_hits", f"WITH {BM25} SELECT query_id, id, (count(*) OVER (PARTITION BY query_id) - rank + 1)::DOUBLE AS score FROM bm25")
def unranked_hits(spark, sf):
    return retrieval.unranked(_bm25(spark, sf)).select("query_id", "id", "score")


@query("keyword_terms", f"WITH {BM25} SELECT term, df, round(idf, 9) AS idf FROM terms JOIN raw USING (term)")
def keyword_terms(spark, sf):
    return retrieval.keyword_index(tables.documents(spark, sf))["terms"].select("term", "df", F.round("idf", 9).alias("idf"))


_flat = "regexp_replace(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g')"
RELEVANT = f"""rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN docs d ON contains({_flat.format(x="d.content")}, {_flat.format(x="b.text")}))"""


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain the question's passage, white space and punctuation aside."""
    asked = questions(spark, sf).select("query_id", T.normalised(F.col("query")).alias("text"))
    docs = tables.documents(spark, sf).select("doc_id", T.normalised(F.col("content")).alias("text"))
    return retrieval.containing(docs, "doc_id", asked, "query_id")


METRICS = f"""got AS (SELECT query_id, list(id ORDER BY rank) AS retrieved FROM bm25 GROUP BY 1),
want AS (SELECT query_id, list(doc_id) AS relevant FROM rel GROUP BY 1),
s AS (SELECT item_id AS query_id, coalesce(retrieved, []) AS r, coalesce(relevant, []) AS v FROM benchmark LEFT JOIN got ON got.query_id = item_id LEFT JOIN want ON want.query_id = item_id),
place AS (SELECT query_id, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_contains(v, r[i]) THEN i END), lambda i: i IS NOT NULL) AS p FROM s),
m AS (SELECT query_id,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(len(list_intersect(r[1:1], v))::DOUBLE / len(v), 6) END AS recall_1,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(len(list_intersect(r[1:5], v))::DOUBLE / len(v), 6) END AS recall_5,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(len(list_intersect(r[1:10], v))::DOUBLE / len(v), 6) END AS recall_10,
 CASE WHEN len(v) = 0 OR list_has_any(r[1:5], v) THEN 1.0 ELSE 0.0 END AS hit_5,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(coalesce(1.0::DOUBLE / p[1], 0), 6) END AS mrr,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(coalesce(list_sum(list_transform(list_filter(p, lambda i: i <= 5), lambda i: 1 / log2(i + 1.0))), 0) / list_sum(list_transform(range(1, least(5, len(v)) + 1), lambda i: 1 / log2(i + 1.0))), 6) END AS ndcg_5,
 CASE WHEN len(v) = 0 THEN 1.0 ELSE round(coalesce(list_sum(list_transform(list_filter(p, lambda i: i <= 10), lambda i: 1 / log2(i + 1.0))), 0) / list_sum(list_transform(range(1, least(10, len(v)) + 1), lambda i: 1 / log2(i + 1.0))), 6) END AS ndcg_10
 FROM s JOIN place USING (query_id))"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    got = _bm25(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h.id).alias("retrieved"))
    want = _relevant(spark, sf).groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant"))
    none = F.lit([]).cast("array<bigint>")
    return questions(spark, sf).join(got, "query_id", "left").join(want, "query_id", "left").select("query_id", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("relevant", none).alias("relevant"))


@query("relevant_documents", f"WITH {DOCS}, {RELEVANT} SELECT DISTINCT query_id, doc_id FROM rel")
def relevant_documents(spark, sf):
    return _relevant(spark, sf)


@query("retrieval_metrics", f"WITH {BM25}, {RELEVANT}, {METRICS} SELECT query_id, recall_1::DOUBLE AS recall_1, recall_5::DOUBLE AS recall_5, recall_10::DOUBLE AS recall_10, hit_5::DOUBLE AS hit_5, mrr::DOUBLE AS mrr, ndcg_5::DOUBLE AS ndcg_5, ndcg_10::DOUBLE AS ndcg_10 FROM m")
def retrieval_metrics(spark, sf):
    return evaluation.sample_metrics(_samples(spark, sf))


@query("evaluation_summary", f"WITH {BM25}, {RELEVANT}, {METRICS} SELECT count(*) AS questions, round(avg(recall_5), 6) AS recall_5, round(avg(hit_5), 6) AS hit_5, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10 FROM m")
def evaluation_summary(spark, sf):
    m = evaluation.sample_metrics(_samples(spark, sf))
    return m.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "hit_5", "mrr", "ndcg_10")])


_names = ("recall_1", "recall_5", "recall_10", "hit_5", "mrr", "ndcg_5", "ndcg_10")
_means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _names)
_lists = {"bm25": "bm25", "vector": "vec", "hybrid": "fused", "hybrid_rerank": "reranked"}
MATRIX = " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM (WITH {METRICS.replace('FROM bm25', f'FROM {source}')} SELECT count(*) AS questions, {_means} FROM m)" for mode, source in _lists.items())


@query("evaluation_matrix", f"WITH {BM25}, {VECTOR}, {FUSED}, {RERANKED}, {RELEVANT} {MATRIX}")
def evaluation_matrix(spark, sf):
    """The same questions by each of the four modes: each ranking is made once, and later ones from the earlier."""
    by_words = tables.stored(_bm25(spark, sf), "bm25")
    by_vector = tables.stored(_vector(spark, sf), "vector")
    fused = tables.stored(retrieval.fuse(by_words, by_vector), "fused")
    runs = {"bm25": by_words, "vector": by_vector, "hybrid": fused, "hybrid_rerank": retrieval.rerank(fused, questions(spark, sf), tables.documents(spark, sf))}
    hits = reduce(DataFrame.unionByName, [r.select(F.lit(mode).alias("mode"), "query_id", "id", "rank") for mode, r in runs.items()])
    got = hits.groupBy("mode", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h.id).alias("retrieved"))
    want = tables.stored(_relevant(spark, sf).groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant")), "relevant")
    none = F.lit([]).cast("array<bigint>")
    asked = questions(spark, sf).select("query_id", F.explode(F.array(*map(F.lit, runs))).alias("mode"))
    samples = asked.join(got, ["mode", "query_id"], "left").join(want, "query_id", "left").select(F.struct("mode", "query_id").alias("query_id"), F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("relevant", none).alias("relevant"))
    metrics = evaluation.sample_metrics(samples)
    return metrics.groupBy(F.col("query_id.mode").alias("mode")).agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in _names])


@query(
    "grounded_answers",
    f"""WITH {BM25}, pairs AS (SELECT h.query_id, h.id, h.rank, list_distinct({toks("b.text")}) AS q, {toks("d.content")} AS t, substr(trim(regexp_replace(d.content, '\\s+', ' ', 'g')), 1, 220) AS quote FROM bm25 h JOIN benchmark b ON b.item_id = h.query_id JOIN docs d ON d.doc_id = h.id WHERE h.rank <= 5),
 good AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM (SELECT *, len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1) AS share FROM pairs) WHERE share >= 0.2),
 told AS (SELECT query_id, round(max(share), 6) AS support, string_agg(id::VARCHAR, ',' ORDER BY nth) AS citations, string_agg(quote, chr(10) ORDER BY nth) AS answer FROM good WHERE nth <= 3 GROUP BY 1)
 SELECT item_id AS query_id, support IS NULL AS refused, coalesce(support, 0) AS support, coalesce(citations, '') AS citations, coalesce(answer, '') AS answer FROM benchmark LEFT JOIN told ON told.query_id = item_id""",
)
def grounded_answers(spark, sf):
    hits = _bm25(spark, sf).where("rank <= 5")
    return answers.grounded_answers(hits, questions(spark, sf), tables.documents(spark, sf))


@query("chunks")
def chunks(spark, sf):
    return chunking.chunk_documents(tables.documents(spark, sf))


@query("search_chunks_bm25")
def search_chunks_bm25(spark, sf):
    """Keyword search over chunks instead of documents."""
    c = chunking.chunk_documents(tables.documents(spark, sf))
    index = retrieval.keyword_index(c, "chunk_id", F.concat_ws(" ", "section_title", "content"))
    return retrieval.bm25(questions(spark, sf), index)


_things = "(?:政策|文件|文档|通知|文章|资料|材料|记录|来源|站点)"
_count = f"(?i)(?:多少|几)\\s*(?:份|篇|条|个|项)?\\s*{_things}|{_things}\\s*(?:共有|有)?\\s*(?:多少|几)\\s*(?:份|篇|个)?\\s*[?？。!！]*$|{_things}\\s*(?:总数|数量|统计)|(?:count|how many|total)\\s+(?:polic(?:y|ies)|documents?|articles?|records?|sources?)"
_after = "(?i)(?:after|since|晚于)\\s*(20[0-9]{2})|(20[0-9]{2})\\s*(?:之后|以来|以后)"
_before = "(?i)(?:before|截至|早于)\\s*(20[0-9]{2})|(20[0-9]{2})\\s*(?:之前|以前)"


def _year(pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract(text, '{pattern}', 1) || regexp_extract(text, '{pattern}', 2), '') AS INT)"


ROUTED = f"""routed AS (SELECT *, regexp_matches(trim(text), '{_count}') AND NOT regexp_matches(text, '(?i){answers.FACT_VALUE_WORDS}') AS agg, regexp_matches(text, '(?i){answers.SEMANTIC_WORDS}') AS sem,
 make_date({_year(_after)} + 1, 1, 1) AS gte, make_date({_year(_before)} - 1, 12, 31) AS lte,
 CASE {' '.join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in answers.REGIONS.items())} END AS region FROM asked)"""
_routes = "CASE WHEN agg AND NOT sem THEN 'sql' WHEN sem AND (gte IS NOT NULL OR lte IS NOT NULL OR region IS NOT NULL OR agg) THEN 'sql+rag' ELSE 'rag' END AS route, gte AS publish_date_gte, lte AS publish_date_lte, region"


def _routed(asked: DataFrame) -> DataFrame:
    """``asked`` (text) with its route and the filters it names."""
    found = asked.withColumn("f", answers.inferred_filters(F.col("text"))).select(*[c for c in asked.columns if c != "text"], "text", "f.*")
    named = F.coalesce(F.col("publish_date_gte").cast("string"), F.col("publish_date_lte").cast("string"), "region").isNotNull()
    return found.withColumn("route", answers.route(F.col("text"), named))


@query("query_routes", f"WITH asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), {ROUTED} SELECT conv_id, turn, {_routes} FROM routed")
def query_routes(spark, sf):
    said = tables.read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return _routed(said).drop("text")


_asks = "['how many documents in Beijing after 2021', 'explain the notice before 2020', 'summarize sources', '2019 以来 上海 有多少份文件', 'total records fee', '截至2022 四川 措施', 'count articles and explain']"


@query("template_routes", f"WITH asked AS (SELECT item_id, {_asks}[(item_id % 7 + 1)::INT] || ' ' || item_id AS text FROM benchmark), {ROUTED} SELECT item_id, {_routes} FROM routed")
def template_routes(spark, sf):
    """Questions of known intents, one for each benchmark item."""
    texts = F.from_json(F.lit(_asks.replace("'", '"')), "array<string>")
    asked = tables.read(spark, sf, "benchmark").select("item_id", F.concat(texts[(F.col("item_id") % 7).cast("int")], F.lit(" "), F.col("item_id").cast("string")).alias("text"))
    return _routed(asked).drop("text")
