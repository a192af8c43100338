"""Registered queries: attachments, page frames, reports and saved indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import quality, retrieval
from ..registry import query
from ..sources import files, tables
from .retrieval import BM25, DOCS, questions

_ext = "['pdf', 'HTM', 'docx', 'bin', 'jpeg'][(page_id % 5 + 1)::INT]"


@query("attachment_types", f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'pdf' WHEN page_id % 7 = 1 THEN 'xls' WHEN page_id % 7 = 2 THEN 'html' WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'html' WHEN page_id % 5 = 2 THEN 'docx' WHEN page_id % 5 = 4 THEN 'jpg' ELSE 'unknown' END AS file_type, CASE WHEN page_id % 7 = 0 THEN 'content_type' WHEN page_id % 7 = 1 THEN 'content_disposition' WHEN page_id % 7 = 2 THEN 'magic' WHEN page_id % 5 = 3 THEN 'unknown' WHEN page_id % 2 = 0 THEN 'original_filename' ELSE 'url_suffix' END AS source FROM pages")
def attachment_types(spark, sf):
    """The type of each attachment, by the first evidence that tells one."""
    k = F.col("page_id")
    ext = F.get(F.array(*map(F.lit, ("pdf", "HTM", "docx", "bin", "jpeg"))), (k % 5).cast("int"))
    named = F.concat(F.lit("a.b."), ext)
    told = files.attachment_type(
        F.when(k % 7 == 0, "Application/PDF; charset=x").otherwise("application/octet-stream"),
        F.when(k % 7 == 1, "attachment; filename=\"x%20y.xls\""),
        F.when(k % 7 == 2, F.col("html").cast("binary")).otherwise(F.unhex(F.lit("0001"))),
        F.when(k % 2 == 0, named),
        F.when(k % 2 == 1, F.concat(F.lit("http://h/d/"), named, F.lit("?q=1"))),
    )
    return tables.read(spark, sf, "pages").select("page_id", told.alias("t")).select("page_id", "t.*")


@query("attachment_audit", "SELECT source, count(*) AS attempted, count(*) FILTER (s = 0) AS parsed, count(*) FILTER (s = 1) AS unsupported, count(*) FILTER (s = 2) AS failed, count(*) FILTER (s = 2 AND doc_id % 2 = 0) AS ocr_failed FROM (SELECT *, doc_id % 3 AS s FROM documents) GROUP BY 1")
def attachment_audit(spark, sf):
    d = tables.read(spark, sf, "documents").select("source", "doc_id", F.get(F.array(*map(F.lit, ("parsed", "unsupported", "failed"))), (F.col("doc_id") % 3).cast("int")).alias("status"))
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return d.groupBy("source").agg(F.count("*").alias("attempted"), of("parsed"), of("unsupported"), of("failed"), F.count_if((F.col("status") == "failed") & (F.col("doc_id") % 2 == 0)).alias("ocr_failed"))


_last = "regexp_extract(rtrim(url, '/'), '[^/]*$')"


@query("safe_filenames", f"SELECT page_id, regexp_replace(regexp_replace({_last}, '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') || '-' || substr(sha256(page_id || chr(0) || {_last} || '.pdf'), 1, 10) || '.pdf' AS name FROM pages")
def safe_filenames(spark, sf):
    last = F.concat(F.substring_index(F.rtrim("url", F.lit("/")), "/", -1), F.lit(".pdf"))
    return tables.read(spark, sf, "pages").select("page_id", files.safe_filename(last, F.col("page_id").cast("string")).alias("name"))


FRAMED = "p AS (SELECT conv_id AS doc_id, turn AS page, [CASE WHEN conv_id % 2 = 0 THEN 'Header' ELSE 'H' || turn END, role, trim(regexp_replace(text, '\\s+', ' ', 'g')), CASE WHEN turn % 2 = 0 THEN 'Footer' ELSE 'F' || turn END] AS l, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE trim(text) <> '')"


@query("page_frames", f"WITH {FRAMED}, e AS (SELECT doc_id, n, 'first' AS side, l[1] AS line FROM p UNION ALL SELECT doc_id, n, 'last', l[4] FROM p), f AS (SELECT doc_id, side, line FROM e WHERE n >= 2 GROUP BY doc_id, side, line, n HAVING count(*) >= greatest(2, (n + 1) // 2)) SELECT doc_id, page, array_to_string(list_concat(CASE WHEN (doc_id, 'first', l[1]) IN (FROM f) THEN [] ELSE [l[1]] END, l[2:3], CASE WHEN (doc_id, 'last', l[4]) IN (FROM f) THEN [] ELSE [l[4]] END), chr(10)) AS text FROM p")
def page_frames(spark, sf):
    """Pages without the headers and footers that they repeat: turns of a conversation are pages."""
    c = tables.read(spark, sf, "conversations").where(F.trim("text") != "")
    top = F.when(F.col("conv_id") % 2 == 0, "Header").otherwise(F.concat(F.lit("H"), F.col("turn").cast("string")))
    end = F.when(F.col("turn") % 2 == 0, "Footer").otherwise(F.concat(F.lit("F"), F.col("turn").cast("string")))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat_ws("\n", top, "role", F.trim(F.regexp_replace("text", "\\s+", " ")), end).alias("text"))
    return files.without_page_frames(pages)


@query("saved_index", f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25")
def saved_index(spark, sf):
    """Keyword search over an index that was saved as tables and loaded again."""
    at = f"{tables.scratch(spark)}/index/{uuid.uuid4().hex}"
    tables.save_index(retrieval.keyword_index(tables.documents(spark, sf)), at)
    return retrieval.bm25(questions(spark, sf), retrieval.index_of(**tables.load_index(spark, at))).select("query_id", "id", "score", "rank")


@query("written_report", "SELECT o_orderkey, o_orderstatus AS status, '[\"' || o_orderpriority || '\",\"' || o_custkey || '\"]' AS tags FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 10 > 0")
def written_report(spark, sf):
    """A report written as JSON and CSV and read again from CSV, nested columns as JSON text."""
    at = f"{tables.scratch(spark)}/report/{uuid.uuid4().hex}"
    o = tables.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.array("o_orderpriority", F.col("o_custkey").cast("string")).alias("tags"))
    tables.write_report(o, at)
    return spark.read.option("header", True).option("escape", '"').schema("o_orderkey long, status string, tags string").csv(f"{at}/csv")


@query("content_copies", f"WITH {DOCS}, h AS (SELECT doc_id, sha256(regexp_replace(content, '\\s+', '', 'g')) AS h FROM docs) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS copy_of FROM h")
def content_copies(spark, sf):
    """The smallest document with the same content for every one."""
    from ..functions import text as T

    d = tables.documents(spark, sf).select("doc_id", T.content_hash(F.col("content")).alias("h"))
    return quality.members(d, "doc_id", "h")
