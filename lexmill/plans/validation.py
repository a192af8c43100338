"""Registered queries: answers held against the texts that they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, validation
from ..registry import query
from ..sources import tables
from .retrieval import BM25, questions
from .review import EVIDENCE, _hits

#: Each customer is a notice with a scope, a sum and perhaps an end; its answer says what the next customer's notice says.
NOTICES = """n AS (SELECT c_custkey AS k, c_mktsegment AS scope, floor(abs(c_acctbal))::BIGINT AS sum, c_acctbal < 0 AS out, r_name = 'AMERICA' AS ended FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
 p AS (SELECT a.k, a.scope, a.sum, a.out, a.ended, b.scope AS said, b.sum AS said_sum, b.ended AS said_ended, b.k IS NULL AS silent FROM n a LEFT JOIN n b ON b.k = a.k + 1)"""


@query(
    "validated_answers",
    f"""WITH {NOTICES}, v AS (SELECT *, list_filter(regexp_extract_all(said_sum || '万元', '(?:19|20)[0-9]{{2}}|[0-9]+万元'), lambda x: NOT contains(sum || '万元', x)) AS own FROM p),
 told AS (SELECT k, CASE WHEN silent THEN 'answer_missing_required_shape' WHEN said_ended AND NOT ended THEN 'answer_contains_unsupported_relation' WHEN said <> scope THEN 'answer_contains_unsupported_scope_target' WHEN out THEN 'answer_contains_unsupported_scope_polarity' WHEN len(own) > 0 THEN 'answer_contains_unsupported_exact_values' ELSE 'answer_supported_by_citations' END AS reason FROM v)
 SELECT k AS query_id, reason = 'answer_supported_by_citations' AS supported, reason, CASE WHEN reason = 'answer_supported_by_citations' THEN k::VARCHAR ELSE '' END AS supporting FROM told""",
)
def validated_answers(spark, sf):
    """Whether each notice supports an answer that was taken from another: relations, scopes with their direction, and sums."""
    c, n, r = (tables.read(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey)  # 25 nations
    ends = lambda x: F.when(F.col(x) == "AMERICA", "旧办法废止。").otherwise("")
    total = F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")
    notice = rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("通知\n本通知"), F.when(F.col("c_acctbal") < 0, "不").otherwise(""), F.lit("适用于"), "c_mktsegment", F.lit("企业，支持资金为"), total, F.lit("万元。"), ends("r_name")).alias("body"))
    answers = rows.select((F.col("c_custkey") - 1).alias("query_id"), F.concat(F.lit("本通知适用于"), "c_mktsegment", F.lit("企业，支持资金为"), total, F.lit("万元。"), ends("r_name")).alias("answer"))
    asked = notice.select(F.col("id").alias("query_id"), F.lit("本通知的支持资金是多少？").alias("query"))
    told = validation.validate(asked, asked.select("query_id").join(answers, "query_id", "left"), notice.select(F.col("id").alias("query_id"), "id", "body"))
    return told.select("query_id", "supported", "reason", F.array_join(F.transform("supporting", lambda x: x.cast("string")), ",").alias("supporting"))


_current = "t AS (SELECT query_id, id, title, content FROM bm25 JOIN docs ON doc_id = id WHERE rank <= 5), g AS (SELECT query_id, count(*) FILTER (trim(content) <> '') AS n, bool_or(len(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]{2,}'), lambda x: contains(lower(content), x))) > 0) AS met FROM t JOIN benchmark b ON b.item_id = query_id GROUP BY 1)"


@query(
    "chat_answers",
    f"""WITH {BM25}, {EVIDENCE}, {_current},
 told AS (SELECT b.item_id AS query_id, CASE WHEN coalesce(n, 0) = 0 THEN 'insufficient_retrieved_evidence' WHEN NOT met AND len(regexp_extract_all(lower(b.text), '[a-z0-9]{{2,}}')) > 0 THEN 'question_not_covered' WHEN d.sure IS NULL THEN 'query_has_no_substantive_aspects' ELSE coalesce(d.reason, 'answered') END AS reason, ids FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id LEFT JOIN decided d ON d.query_id = b.item_id),
 first AS (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS citations FROM bm25 h JOIN told USING (query_id) WHERE h.rank <= 5 AND list_contains(ids, h.id) GROUP BY 1)
 SELECT t.query_id, reason <> 'answered' AS refused, reason, CASE WHEN reason = 'answered' THEN citations ELSE '' END AS citations FROM told t LEFT JOIN first f ON f.query_id = t.query_id""",
)
def chat_answers(spark, sf):
    """Answers to each question from its five best documents, through grounding, the gate and validation, or why there is none."""
    null = lambda kind: F.lit(None).cast(kind)
    hits = tables.stored(_hits(spark, sf, 5), "hits").select("query_id", "id", "rank", "score", "title", "content", F.lit(True).alias("official"), null("string").alias("policy_key"), null("string").alias("policy_status"), null("date").alias("publish_date"))
    told = answers.chat(questions(spark, sf), hits, official_only=False)
    return told.select("query_id", "refused", "reason", F.coalesce(F.array_join(F.transform("citations", lambda x: x.cast("string")), ","), F.lit("")).alias("citations"))


@query("answer_points", "WITH p AS (SELECT c_custkey AS query_id, unnest([c_name, c_mktsegment, n_name]) AS point, c_mktsegment || ' in ' || CASE WHEN c_acctbal > 0 THEN lower(n_name) ELSE 'x' END AS said FROM customer JOIN nation ON n_nationkey = c_nationkey), q AS (SELECT query_id, regexp_replace(lower(point), '[^a-z0-9]', '', 'g') AS point, regexp_replace(lower(said), '[^a-z0-9]', '', 'g') AS said FROM p) SELECT query_id, count(*) AS points, count(*) FILTER (contains(said, point)) AS covered, round(count(*) FILTER (contains(said, point)) / count(*)::DOUBLE, 6) AS coverage FROM q GROUP BY 1")
def answer_points(spark, sf):
    """Which of the expected points an answer has."""
    c = tables.read(spark, sf, "customer").join(F.broadcast(tables.read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    said = c.select(F.col("c_custkey").alias("query_id"), F.concat("c_mktsegment", F.lit(" in "), F.when(F.col("c_acctbal") > 0, F.lower("n_name")).otherwise("x")).alias("answer"))
    points = c.select(F.col("c_custkey").alias("query_id"), F.explode(F.array("c_name", "c_mktsegment", "n_name")).alias("point"))
    return answers.answer_points(said, points)
