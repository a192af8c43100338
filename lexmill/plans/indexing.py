"""Registered queries: an index kept up by batches of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.indexing import KeywordIndex
from ..registry import query
from ..sources import tables
from .retrieval import BM25, DOCS, questions

#: Documents after three batches: labelled ones of quality 0 are never approved, of quality 1 are revised, toxic ones are removed.
STATES = "states AS (SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"
KEPT = f"{STATES}, docs AS (SELECT doc_id, title, text || CASE WHEN quality = 1 THEN ' revised ' || source ELSE '' END AS content FROM states WHERE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AND regexp_matches(lower(text), '[a-z0-9\\x{{4e00}}-\\x{{9fff}}]'))"
#: The mean weight is summed with compensation: a plain sum over millions of terms depends on their order in the digits that are told.
INCREMENTAL = BM25.replace(DOCS, KEPT).replace("(SELECT avg(raw) FROM raw)", "(SELECT favg(raw) FROM raw)")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the labels that decide what the batches do; a document without a label has nulls."""
    labels = tables.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = tables.documents(spark, sf).join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), "title", "content", "source_name", "quality", "toxic", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("approved"))


def _kept_up(spark: SparkSession, sf: str) -> tuple[KeywordIndex, list[DataFrame]]:
    """An index after every document, then revisions with an untouched copy of the rest, then removals."""
    states = tables.stored(_states(spark, sf), "states")
    index = KeywordIndex(spark, f"{tables.scratch(spark)}/index/{uuid.uuid4().hex}")
    revised = F.when(F.col("quality") == 1, F.concat("content", F.lit(" revised "), "source_name")).otherwise(F.col("content"))
    outcomes = [index.apply(states), index.apply(states.withColumn("content", revised))]
    outcomes.append(index.apply(states.limit(0), removed=states.where("toxic = 1")))
    return index, outcomes


@query("incremental_terms", f"WITH {INCREMENTAL} SELECT term, df, round(idf, 9) AS idf FROM terms JOIN raw USING (term)")
def incremental_terms(spark, sf):
    """Document frequencies kept by changes alone equal those of an index built anew."""
    return _kept_up(spark, sf)[0].parts()["terms"].select("term", "df", F.round("idf", 9).alias("idf"))


@query("incremental_search", f"WITH {INCREMENTAL} SELECT query_id, id, score, rank FROM bm25")
def incremental_search(spark, sf):
    """Search over the segments of three batches, compacted to one."""
    index, _ = _kept_up(spark, sf)
    index.compact()
    index.vacuum()
    return retrieval.bm25(questions(spark, sf), index.parts()).select("query_id", "id", "score", "rank")


_blank = "NOT regexp_matches(lower(text || ' ' || coalesce(title, '')), '[a-z0-9\\x{4e00}-\\x{9fff}]')"


@query(
    "index_outcomes",
    f"WITH {STATES} SELECT doc_id AS id, 1 AS batch, CASE WHEN quality = 0 THEN 'rejected' WHEN {_blank} THEN 'empty' ELSE 'added' END AS outcome FROM states UNION ALL SELECT doc_id, 2, CASE WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN CASE WHEN {_blank} THEN 'added' ELSE 'replaced' END WHEN {_blank} THEN 'empty' ELSE 'unchanged' END FROM states UNION ALL SELECT doc_id, 3, CASE WHEN quality = 0 OR ({_blank} AND quality IS NULL) THEN 'absent' ELSE 'removed' END FROM states WHERE toxic = 1",
)
def index_outcomes(spark, sf):
    """What each batch did with each of its documents."""
    batches = [o.withColumn("batch", F.lit(n)) for n, o in enumerate(_kept_up(spark, sf)[1], 1)]
    return batches[0].unionByName(batches[1]).unionByName(batches[2])
