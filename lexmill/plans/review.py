"""Registered queries: source discovery, evidence and grounding, reviews, drafts and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import web
from ..operators import discovery, evidence, quality, review
from ..registry import ORACLES, query
from ..sources import tables
from .curation import CANONICAL
from .retrieval import BM25, _bm25, questions

_topic = "the ment tion"
_level = f"CASE WHEN contains(lower(text), '{_topic}') THEN 'DIRECT' WHEN 2 * (contains(lower(text), 'the')::INT + contains(lower(text), 'ment')::INT + contains(lower(text), 'tion')::INT) >= 3 THEN 'RELATED' ELSE 'UNRELATED' END"


@query("topic_levels", f"SELECT source, {_level} AS level, count(*) AS n FROM documents GROUP BY 1, 2")
def topic_levels(spark, sf):
    """How documents of each source bear on a topic."""
    d = tables.documents(spark, sf)
    return d.groupBy(F.col("source_name").alias("source"), discovery.relevance(F.lit(""), F.col("content"), F.lit(_topic)).alias("level")).agg(F.count("*").alias("n"))


_usable = f"n_chars >= 300 AND ({_level}) IN ('DIRECT', 'RELATED')"
TRIALS = f"trials AS (SELECT source, lang, count(*) AS fetched, count(*) FILTER ({_usable}) AS success, coalesce(round_even(avg(n_chars) FILTER ({_usable}), 0), 0)::BIGINT AS average_chars FROM documents GROUP BY 1, 2)"


@query("trial_quality", f"WITH {TRIALS} SELECT source, lang, fetched, success, average_chars, round_even(0.5 * success / fetched::DOUBLE + 0.5 * least(1.0, average_chars / 600.0::DOUBLE), 4) AS quality, CASE WHEN success > 0 THEN 'trial_crawled' ELSE 'failed' END AS status FROM trials")
def trial_quality(spark, sf):
    """Trial columns: a source's documents of one language."""
    return _trials(spark, sf)


def _trials(spark, sf):
    d = tables.read(spark, sf, "documents").select("source", "lang", F.col("n_chars").alias("chars"), discovery.relevance(F.lit(""), F.col("text"), F.lit(_topic)).alias("level"))
    return discovery.trial_columns(d, 300, "source", "lang")


@query("candidate_quality", f"WITH {TRIALS}, c AS (SELECT source, count(*) AS columns, sum(fetched)::BIGINT AS documents, sum(success)::BIGINT AS success, coalesce(round_even(avg(average_chars) FILTER (average_chars > 0), 0), 0)::BIGINT AS average_chars FROM trials GROUP BY 1), o AS (SELECT source, avg(quality) AS official FROM documents JOIN labels USING (doc_id) GROUP BY 1), q AS (SELECT source, columns, documents, success, average_chars, round_even(0.35 * coalesce(official, 0) + 0.15 * least(columns / 2.0::DOUBLE, 1) + 0.25 * success / greatest(documents, 1)::DOUBLE + 0.25 * least(average_chars / 600.0::DOUBLE, 1), 4) AS quality FROM c LEFT JOIN o USING (source)) SELECT *, CASE WHEN quality >= 0.75 THEN 'pending_approval' ELSE 'rejected' END AS status FROM q")
def candidate_quality(spark, sf):
    official = tables.read(spark, sf, "documents").select("doc_id", "source").join(tables.read(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("official"))
    return discovery.candidate_scores(_trials(spark, sf), official, 300, 0.75, "source")


_trusted = "CASE WHEN regexp_matches(host, '(^|[.])example[.]org$') THEN '.example.org' WHEN regexp_matches(host, '(^|[.])example[.]com$') THEN '.example.com' END"


@query("official_scores", f"WITH {CANONICAL} SELECT page_id, {_trusted} AS suffix, round(CASE WHEN {_trusted} IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN scheme = 'https' THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(lower(substr(html, 1, 100000)), '政府|政务|government|official|gov') THEN 0.15 ELSE 0 END, 4)::DOUBLE AS score FROM canonical")
def official_scores(spark, sf):
    p, trusted = tables.read(spark, sf, "pages"), ("example.org", ".example.com")
    return p.select("page_id", web.trusted_suffix(web.host(F.col("url")), trusted).alias("suffix"), discovery.official_score(F.col("url"), F.col("html"), trusted).alias("score"))


@query("page_kinds", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<article\\b') THEN 'html_detail_or_mixed' WHEN regexp_matches(html, '(?i)<a\\b[^>]*\\bhref') THEN 'html_list_or_navigation' WHEN regexp_matches(html, '(?i)<script\\b') THEN 'spa_shell' ELSE 'unknown' END AS kind FROM pages")
def page_kinds(spark, sf):
    return tables.read(spark, sf, "pages").select("page_id", web.page_kind(F.col("html"), F.lit("text/html")).alias("kind"))


@query("content_gaps", "WITH m AS (SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND contains(lower(text), 'license') AND length(source) % 2 = 0) SELECT count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS documents, count(DISTINCT source) < 3 OR count(*) FILTER (lang = 'en') < 5 AS gap FROM m")
def content_gaps(spark, sf):
    """Whether enabled sources have enough on a topic."""
    d = tables.documents(spark, sf).join(tables.read(spark, sf, "labels"), "doc_id").select(F.col("source_name").alias("source_id"), "title", "content", "region", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").otherwise("pending").alias("final_status"))
    sources = tables.documents(spark, sf).select(F.col("source_name").alias("source_id")).distinct().select("source_id", (F.length("source_id") % 2 == 0).alias("enabled"), F.lit("en").alias("region"))
    return discovery.content_gap(d, sources, " License ", "en", 3, 5)


_runs = "SELECT 'Topic ' || user_id % 40 AS topic, CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'running' ELSE 'completed' END AS status, ts AS created_at FROM events WHERE event_id % 3 = 0"
DUE = f"due AS (SELECT t.topic, CASE WHEN bool_or(status = 'running') THEN 'active_run' WHEN max(created_at) > TIMESTAMP '2024-01-31' - INTERVAL '100 hours' THEN 'cooldown' ELSE 'due' END AS reason FROM (SELECT DISTINCT 'topic ' || user_id % 50 AS topic FROM events) t LEFT JOIN ({_runs}) r ON lower(r.topic) = t.topic GROUP BY 1)"


def _due(spark, sf):
    e = tables.read(spark, sf, "events")
    name = lambda word, n: F.concat(F.lit(word), (F.col("user_id") % n).cast("string"))
    runs = e.where("event_id % 3 = 0").select(name(" Topic ", 40).alias("topic"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), "running").otherwise("completed").alias("status"), F.col("ts").alias("created_at"))
    return discovery.due_topics(e.select(name("topic ", 50).alias("topic")).distinct(), runs, F.lit("2024-01-31").cast("timestamp_ntz"), 360_000)


@query("due_topics", f"WITH {DUE} SELECT topic, reason = 'due' AS due, reason FROM due")
def due_topics(spark, sf):
    return _due(spark, sf)


@query("gap_scan", f"WITH {DUE} SELECT reason, count(*) AS topics FROM due GROUP BY 1")
def gap_scan(spark, sf):
    """The scheduled scan over topics, counted by outcome."""
    return _due(spark, sf).groupBy("reason").agg(F.count("*").alias("topics"))


@query("trial_links", "WITH l AS (SELECT l_suppkey AS candidate, l_linenumber AS column_id, l_partkey AS url, l_orderkey * 10 AS place, l_partkey % 3 AS priority FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY candidate, url ORDER BY column_id, place) AS first FROM l) SELECT candidate, column_id, url FROM (SELECT *, row_number() OVER (PARTITION BY candidate, column_id ORDER BY priority DESC, place, url) AS nth FROM o WHERE first = 1) WHERE nth <= 3")
def trial_links(spark, sf):
    """Addresses that each column of a candidate tries, none twice in a candidate."""
    line = tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_linenumber").alias("column_id"), F.col("l_partkey").alias("url"), (F.col("l_orderkey") * 10).alias("place"), (F.col("l_partkey") % 3).alias("priority"))
    return discovery.distinct_trials(line, "candidate", 3).select("candidate", "column_id", "url")


@query("longest_texts", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def longest_texts(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


def _hits(spark, sf, rank):
    return _bm25(spark, sf).where(F.col("rank") <= rank).join(tables.documents(spark, sf).select(F.col("doc_id").alias("id"), "title", "content"), "id")


_words = "regexp_extract_all({0}, '[a-zA-Z][a-zA-Z0-9._+-]+')"
EVIDENCE = f"""parts AS (SELECT item_id AS query_id, unnest(generate_series(1, len(a))) AS nth, unnest(a) AS aspect FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[?？。!！;；\\n]'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,，:：]+|[ ,，:：]+$', '', 'g')), lambda x: x <> '') AS a FROM benchmark)),
 aterms AS (SELECT query_id, nth, term, least(4.0, length(term) / 2.0)::DOUBLE AS w FROM (SELECT DISTINCT query_id, nth, unnest({_words.format("lower(aspect)")}) AS term FROM parts)),
 texts AS (SELECT query_id, id, lower(title || chr(10) || content) AS text FROM bm25 JOIN docs ON doc_id = id WHERE rank <= 5),
 whole AS (SELECT query_id, string_agg(text, chr(10)) AS everything FROM texts GROUP BY 1),
 sure AS (SELECT query_id, nth, coalesce(sum(w) FILTER (contains(everything, term)) / sum(w), 0) AS sure, count(*) FILTER (contains(everything, term)) AS strong FROM aterms JOIN whole USING (query_id) GROUP BY 1, 2),
 gives AS (SELECT query_id, nth, id, sum(w) FILTER (contains(text, term)) / sum(w) AS share, count(*) FILTER (contains(text, term)) AS strong FROM aterms JOIN texts USING (query_id) GROUP BY 1, 2, 3),
 support AS (SELECT query_id, nth, list(id) AS ids FROM gives WHERE share >= 0.08 AND strong > 0 GROUP BY 1, 2),
 vals AS (SELECT query_id, nth, everything, regexp_extract_all(regexp_replace(aspect, '(?i)(after|since|before)(19|20)[0-9]{{2}}', ' ', 'g'), '(?:19|20)[0-9]{{2}}|[0-9]+(?:\\.[0-9]+)?[%％]') AS v, aspect FROM parts LEFT JOIN whole USING (query_id)),
 judged AS (SELECT p.query_id, p.nth, coalesce(sure, 0) AS sure, ids, CASE WHEN everything IS NULL THEN 'no_retrieved_evidence' WHEN len({_words.format("lower(p.aspect)")}) = 0 THEN 'query_aspect_has_no_anchor' WHEN len(list_filter(v, lambda x: NOT contains(lower(regexp_replace(everything, '[\\s,，]', '', 'g')), x))) > 0 THEN 'evidence_constraint_mismatch'
  WHEN regexp_matches(p.aspect, '[%％]') AND NOT regexp_matches(everything, '[0-9][%％]') THEN 'evidence_missing_required_answer_shape' WHEN coalesce(sure, 0) < 0.45 OR ids IS NULL THEN 'insufficient_evidence_relevance' END AS reason FROM parts p LEFT JOIN vals USING (query_id, nth) LEFT JOIN sure USING (query_id, nth) LEFT JOIN support USING (query_id, nth)),
 decided AS (SELECT query_id, min(sure) AS sure, arg_min(reason, nth) FILTER (reason IS NOT NULL) AS reason, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM judged GROUP BY 1)"""


@query("evidence_decisions", f"WITH {BM25}, {EVIDENCE} SELECT b.item_id AS query_id, d.sure IS NOT NULL AND d.reason IS NULL AS sufficient, round(coalesce(least(1, d.sure), 0), 6) AS confidence, CASE WHEN d.sure IS NULL THEN 'query_has_no_substantive_aspects' ELSE coalesce(d.reason, 'evidence_covers_all_query_aspects') END AS reason, CASE WHEN d.sure IS NOT NULL AND d.reason IS NULL THEN array_to_string(ids, ',') ELSE '' END AS supporting FROM benchmark b LEFT JOIN decided d ON d.query_id = b.item_id")
def evidence_decisions(spark, sf):
    """Whether the five best documents cover every aspect of each question."""
    hits = _hits(spark, sf, 5).select("query_id", "id", F.concat_ws("\n", "title", "content").alias("body"))
    d = evidence.assess(questions(spark, sf), hits)
    return d.withColumn("supporting", F.array_join(F.transform("supporting", lambda x: x.cast("string")), ","))


GROUND = """hit AS (SELECT h.query_id, h.id, h.score, d.content, coalesce(l.quality = 1, false) AS official, 'p' || h.id % 3 AS policy, CASE h.id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'void' ELSE '' END AS status, CASE WHEN h.id % 5 > 0 THEN DATE '2024-01-01' + (h.id % 7)::INT END AS day FROM bm25 h JOIN docs d ON d.doc_id = h.id LEFT JOIN labels l ON l.doc_id = h.id WHERE h.rank <= 8 AND h.score >= 0.05),
 own AS (SELECT *, coalesce(day < max(day) OVER (PARTITION BY query_id, policy), false) AS old FROM hit WHERE official),
 clash AS (SELECT query_id, string_agg(policy, ',' ORDER BY policy) AS conflicts FROM (SELECT query_id, policy FROM own WHERE status <> '' GROUP BY 1, 2 HAVING count(DISTINCT status) > 1) GROUP BY 1),
 cites AS (SELECT o.query_id, bool_or(len(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]{2,}'), lambda t: contains(lower(o.content), t))) > 0) AS covered, string_agg(o.id::VARCHAR, ',' ORDER BY o.id) FILTER (old) AS outdated, string_agg(o.id::VARCHAR, ',' ORDER BY o.id) FILTER (NOT old) AS citations FROM own o JOIN benchmark b ON b.item_id = o.query_id GROUP BY 1),
 few AS (SELECT item_id AS query_id, (SELECT count(*) FROM hit WHERE query_id = item_id) AS n, (SELECT count(*) FROM own WHERE query_id = item_id) AS m FROM benchmark)"""


@query("grounding_decisions", f"WITH {BM25}, {GROUND} SELECT query_id, n > 0 AND m > 0 AND coalesce(covered, true) AND conflicts IS NULL AS grounded, array_to_string(list_filter([CASE WHEN n < 1 THEN 'insufficient_retrieved_evidence' END, CASE WHEN m < 1 THEN 'official_source_required' END, CASE WHEN NOT covered THEN 'question_not_covered' END, CASE WHEN conflicts IS NOT NULL THEN 'conflicting_evidence' END], lambda x: x IS NOT NULL), ',') AS reasons, coalesce(conflicts, '') AS conflicts, coalesce(outdated, '') AS outdated, coalesce(citations, '') AS citations FROM few LEFT JOIN cites USING (query_id) LEFT JOIN clash USING (query_id)")
def grounding_decisions(spark, sf):
    """Grounding of each question on its hits: official sources, conflicts and outdated policies."""
    labels = tables.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    k = F.col("id")
    hits = _hits(spark, sf, 8).join(labels, "id", "left").select("query_id", "id", "score", "content", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("official"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("policy_key"), F.when(k % 4 == 0, "valid").when(k % 4 == 1, "void").otherwise("").alias("policy_status"), F.when(k % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 7).cast("int"))).alias("publish_date"))
    g = evidence.ground(questions(spark, sf), hits, least_score=0.05)
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    ids = lambda c, f: text(F.transform(c, f))
    return g.select("query_id", "grounded", text("reasons").alias("reasons"), text("conflicts").alias("conflicts"), ids("outdated", lambda x: x.cast("string")).alias("outdated"), ids("citations", lambda x: x["id"].cast("string")).alias("citations"))


_verdict = "CASE o_orderkey % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FIX' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'fix' END"


def _reviews(spark, sf):
    k = F.col("o_orderkey")
    line = tables.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    o = tables.read(spark, sf, "orders").join(line, "o_orderkey", "left")
    cell = F.when(k % 3 == 0, F.format_string("[%d, %d, \"\"]", k % 7, k % 7)).when(k % 3 == 1, F.format_string(" %d ;%d; ", k % 7, k % 5))
    verdict = F.when(k % 5 == 0, "PASS").when(k % 5 == 1, "FIX").when(k % 5 == 2, "REJECT").when(k % 5 == 3, "fix")
    rows = o.select(k.alias("question_id"), (k % 100).alias("document_id"), verdict.alias("verdict"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("corrected_answer"), F.col("o_orderstatus").alias("expected_answer"), review.bool_cell(F.get(F.array(F.lit("Yes"), F.lit("n"), F.lit("")), (k % 3).cast("int"))).alias("corrected_should_refuse"), (k % 4 == 0).alias("should_refuse"), F.coalesce(F.slice("parts", 1, 2), F.array().cast("array<bigint>")).alias("expected_chunk_ids"), F.transform(review.list_cell(cell), lambda x: x.cast("bigint")).alias("additional_chunk_ids"))
    return review.apply_reviews(rows)


REVIEWS = f"""reviews AS (SELECT o_orderkey AS question_id, {_verdict} AS verdict, o_orderkey % 5 IN (0, 1, 2) AS reviewed, o_orderkey % 5 = 0 OR (o_orderkey % 5 = 1 AND o_orderkey % 2 = 0) AS verified, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS effective_answer,
 CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 = 1 THEN false ELSE o_orderkey % 4 = 0 END AS effective_should_refuse,
 list_concat(coalesce((SELECT list(DISTINCT l_partkey ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey)[1:2], []), CASE o_orderkey % 3 WHEN 0 THEN [o_orderkey % 7] WHEN 1 THEN [o_orderkey % 7, o_orderkey % 5] ELSE [] END) AS ids FROM orders)"""


@query("applied_reviews", f"WITH {REVIEWS} SELECT question_id, reviewed, verified, effective_answer, effective_should_refuse, len(list_distinct(ids)) AS chunks FROM reviews")
def applied_reviews(spark, sf):
    """Review rows with their corrections in place."""
    return _reviews(spark, sf).select("question_id", "reviewed", "verified", "effective_answer", "effective_should_refuse", F.size("effective_chunk_ids").cast("long").alias("chunks"))


_faults = "SELECT question_id, unnest(list_distinct(ids)) AS c FROM reviews"


@query("review_status", f"WITH {REVIEWS}, e AS (SELECT count(*) AS errors FROM ({_faults}) WHERE c % 100 <> question_id % 100) SELECT count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FIX') AS fix, count(*) FILTER (verdict = 'REJECT') AS reject, count(*) FILTER (verified) AS verified, (SELECT errors FROM e) AS traceability_errors, count(*) FILTER (NOT reviewed) AS unreviewed, CASE WHEN (SELECT errors FROM e) = 0 AND count(*) FILTER (NOT reviewed) = 0 THEN 'complete' ELSE 'partial' END AS status FROM reviews")
def review_status(spark, sf):
    """Verdict counts, with the faults found on following each row's chunks to their documents."""
    rows = _reviews(spark, sf)
    chunks = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 100).alias("document_id"))
    faults = review.traceability(rows, chunks).select("question_id", F.size("errors").alias("faults"))
    return review.review_counts(rows.join(faults, "question_id", "left"), F.col("faults"))


@query("feedback_questions", "SELECT 'feedback-' || item_id AS question_id, text AS question, CASE WHEN item_id % 7 = 4 THEN '' WHEN item_id % 2 = 0 THEN (item_id * 3)::VARCHAR WHEN item_id % 7 = 2 THEN '' ELSE item_id::VARCHAR END AS documents, CASE WHEN item_id % 7 IN (0, 1) THEN (item_id + 1)::VARCHAR ELSE '' END AS chunks, CASE WHEN item_id % 7 IN (0, 1) AND item_id % 3 > 0 THEN 'why' ELSE '' END AS points, item_id % 7 = 4 AS should_refuse, 'feedback/' || ['not_helpful', 'incomplete_answer', 'incorrect_citation', 'missing_document', 'should_refuse', 'should_not_refuse'][(item_id % 7 + 1)::INT] AS category FROM benchmark WHERE item_id % 7 < 6")
def feedback_questions(spark, sf):
    b, k = tables.read(spark, sf, "benchmark"), F.col("item_id")
    kinds = F.array(*map(F.lit, (*review.CONVERTIBLE, "helpful")))
    rows = b.select(k.alias("id"), F.get(kinds, (k % 7).cast("int")).alias("kind"), F.when(k % 3 > 0, " why ").otherwise("  ").alias("comment"), F.col("text").alias("query"), F.array(k, F.lit(None), k).alias("cited_documents"), F.array(k + 1, k + 1).alias("cited_chunks"), F.when(k % 2 == 0, k * 3).alias("expected_document"))
    q = review.feedback_questions(rows)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return q.select("question_id", "question", joined("expected_document_ids").alias("documents"), joined("expected_chunk_ids").alias("chunks"), joined("expected_answer_points").alias("points"), "should_refuse", "category")


@query("data_debt", "SELECT doc_id AS document_id, CASE WHEN short AND doc_id % 3 > 0 THEN 'rejected' WHEN NOT short AND doc_id % 5 > 0 THEN 'human_review_required' END AS action FROM (SELECT doc_id, length(trim(text)) < 200 AND doc_id % 2 = 0 AS short FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE CASE WHEN short THEN doc_id % 3 > 0 ELSE doc_id % 5 > 0 END")
def data_debt(spark, sf):
    """Upkeep of documents that wait: done once however often it runs."""
    d = tables.documents(spark, sf).join(tables.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("document_id"), "content", (F.col("doc_id") % 2 == 1).alias("has_attachment"))
    done = d.select("document_id", F.explode(F.array(F.when(F.col("document_id") % 3 == 0, "data_debt_hard_reject"), F.when(F.col("document_id") % 5 == 0, "data_debt_audit"))).alias("review_type")).where("review_type is not null")
    return review.data_debt(d, done, 200)


@query("invalid_regions", "SELECT doc_id AS document_id, sha256(doc_id || ':region:??:historical_invalid_region') AS correction_key FROM documents WHERE doc_id % 11 = 0 AND doc_id % 2 = 1")
def invalid_regions(spark, sf):
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 11 == 0, "??").otherwise(F.col("lang")).alias("region"))
    have = review.invalid_regions(d.where("document_id % 2 = 0"), d.limit(0).select(F.lit("").alias("correction_key")))
    return review.invalid_regions(d, have)


_required, _positive, _refusals = ("fact", "multi_document", "temporal_mismatch", "list"), ("fact", "number", "multi_hop"), ("temporal_mismatch",)


@query("draft_questions", """WITH r AS (SELECT d.doc_id, split_part(text, chr(10), 1) AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 ORDER BY doc_id LIMIT 100), n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS nth, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS other FROM r),
 c AS (SELECT *, CASE WHEN nth <= 4 THEN ['fact', 'multi_document', 'temporal_mismatch', 'list'][nth::INT] ELSE ['fact', 'number', 'multi_hop'][((nth - 5) % 3 + 1)::INT] END AS category FROM n)
 SELECT printf('draft-%03d', nth) AS id, category, category = 'temporal_mismatch' AS should_refuse, 'What does ' || title || ' say? [' || category || ']' AS question, CASE WHEN category = 'temporal_mismatch' THEN '' WHEN category IN ('multi_document', 'multi_hop') THEN doc_id || ',' || other ELSE doc_id::VARCHAR END AS documents, CASE WHEN category = 'temporal_mismatch' THEN '' WHEN length(flat) <= 360 THEN flat ELSE regexp_replace(substr(flat, 1, 360), '(.) [^ ]*$', '\\1') END AS expected_answer FROM c""")
def draft_questions(spark, sf):
    """Draft questions from approved official documents: the report of a bounded draft."""
    d = tables.documents(spark, sf).join(tables.read(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi")
    rows = d.select(F.col("doc_id").alias("document_id"), "title", "content", F.col("doc_id").alias("chunk_id"))
    q = review.draft_questions(rows, _required, _positive, _refusals)
    return q.select("id", "category", "should_refuse", "question", F.array_join(F.transform("expected_documents", lambda x: x.cast("string")), ",").alias("documents"), "expected_answer")


_verdicts = "CASE WHEN toxic = 1 THEN 'manual_review' WHEN quality = 0 THEN 'reject' ELSE 'accept' END"


@query(
    "review_outcomes",
    f"""WITH ruled AS (SELECT doc_id, decision AS rule_decision FROM ({ORACLES["rule_filter"]})), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
 x AS (SELECT r.*, d.lang, l.doc_id IS NOT NULL AS shown_to, {_verdicts} AS verdict, contains(d.text, d.source) AS quoted, d.n_chars > 3000 AS by_hand FROM ruled r JOIN documents d USING (doc_id) LEFT JOIN l USING (doc_id)),
 y AS (SELECT *, shown_to AND quoted IS NOT NULL AND (quoted OR lang <> 'de') AS usable FROM x)
 SELECT doc_id, rule_decision, CASE WHEN rule_decision <> 'reject' THEN CASE WHEN usable THEN verdict ELSE 'unavailable' END END AS llm_status, CASE WHEN by_hand AND lang = 'fr' THEN 'approved' WHEN rule_decision = 'reject' THEN 'rejected' WHEN NOT usable THEN 'pending_llm' WHEN verdict = 'reject' THEN 'rejected' WHEN verdict = 'manual_review' OR rule_decision = 'review' THEN 'pending_manual_review' ELSE 'approved' END AS final_status FROM y""",
)
def review_outcomes(spark, sf):
    """What rules, a model's verdicts (from the labels) and people make of every document; a model's quotes of German documents are their sources, which the text may not have."""
    d, labels = tables.documents(spark, sf), tables.read(spark, sf, "labels")
    official = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    ruled = d.join(labels, "doc_id", "left").select("doc_id", "content", "region", "source_name", quality.rule_filter(F.col("title"), F.col("content"), official)["decision"].alias("rule_decision"))
    verdict = F.when(F.col("toxic") == 1, "manual_review").when(F.col("quality") == 0, "reject").otherwise("accept")
    told = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).join(d, "doc_id")
    field = F.struct(F.col("region").alias("value"), F.col("source_name").alias("quote"), F.lit(0.5).alias("confidence"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<value:string,quote:string,confidence:double>>"))
    fields = F.when(F.col("region") == "de", F.create_map(F.lit("region"), field)).otherwise(none)
    people = d.where("word_count > 3000 and region = 'fr'").select("doc_id", F.explode(F.array(F.struct(F.lit("reject").alias("decision"), F.lit(1).alias("at")), F.struct(F.lit("approve").alias("decision"), F.lit(2).alias("at")))).alias("x")).select("doc_id", "x.*")
    return review.review_pipeline(ruled, told.select("doc_id", verdict.alias("decision"), fields.alias("fields")), people).select("doc_id", "rule_decision", "llm_status", "final_status")


@query("document_payloads", "SELECT doc_id, '{' || array_to_string(list_filter(['\"document_id\":' || doc_id, '\"region\":\"' || lang || '\"', CASE WHEN quality IS NOT NULL THEN '\"official\":' || (quality = 1) END, CASE WHEN toxic = 0 THEN '\"size\":' || n_chars END], lambda x: x IS NOT NULL), ',') || '}' AS payload FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)")
def document_payloads(spark, sf):
    """The metadata of each document as an object without nulls."""
    labels = tables.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = tables.read(spark, sf, "documents").join(labels, "doc_id", "left")
    return d.select("doc_id", J.payload(document_id=F.col("doc_id"), region=F.col("lang"), official=F.col("quality") == 1, size=F.when(F.col("toxic") == 0, F.col("n_chars"))).alias("payload"))


#: A review row for each order: its customer is the document, its first lines' parts are the chunks.
@query(
    "review_faults",
    """WITH line AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey)[1:2] AS parts FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, coalesce(parts, []) AS parts FROM orders LEFT JOIN line ON l_orderkey = o_orderkey),
 d AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0), x AS (SELECT r.*, d.c_custkey IS NOT NULL AS known, c_nationkey, c_mktsegment FROM r LEFT JOIN d ON c_custkey = o_custkey)
 SELECT o_orderkey::VARCHAR AS id, 'UNKNOWN_DOCUMENT:' || o_orderkey || ':' || o_custkey AS error FROM x WHERE NOT known
 UNION ALL SELECT o_orderkey::VARCHAR, 'SOURCE_URL_MISMATCH:' || o_orderkey || ':' || o_custkey FROM x WHERE known AND c_nationkey >= 10
 UNION ALL SELECT o_orderkey::VARCHAR, 'SOURCE_TITLE_MISMATCH:' || o_orderkey FROM x WHERE known AND c_mktsegment <> 'BUILDING'
 UNION ALL SELECT o_orderkey::VARCHAR, 'FIX_REQUIRES_CORRECTED_ANSWER:' || o_orderkey FROM x WHERE o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey::VARCHAR, 'INVALID_VERDICT:' || o_orderkey FROM x WHERE o_orderstatus = 'O'
 UNION ALL SELECT o_orderkey::VARCHAR, 'POSITIVE_CASE_MISSING_CHUNK:' || o_orderkey FROM x WHERE len(parts) = 0 AND o_orderpriority[1] <> '5'
 UNION ALL SELECT o_orderkey::VARCHAR, 'POSITIVE_CASE_MISSING_EVIDENCE:' || o_orderkey FROM x WHERE len(parts) = 0 AND o_orderpriority[1] <> '5'
 UNION ALL SELECT o_orderkey::VARCHAR, CASE WHEN p <> o_custkey THEN 'CHUNK_DOCUMENT_MISMATCH:' || o_orderkey || ':' || p END FROM (SELECT o_orderkey, o_custkey, unnest(parts) AS p FROM x) WHERE p <> o_custkey""",
)
def review_faults(spark, sf):
    """Every fault of a review sheet against the documents and chunks that it names."""
    line = tables.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 2).alias("parts"))
    o = tables.read(spark, sf, "orders").join(line, "o_orderkey", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<bigint>")))
    status = F.col("o_orderstatus")
    name = lambda c: F.concat(F.lit("part "), c.cast("string"))
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(status == "P", "FIX").when(status == "O", "LATER").otherwise("PASS").alias("verdict"), F.lit(" ").alias("corrected_answer"), F.array("o_custkey").alias("document_ids"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("https://h/"), i.cast("string"))).alias("source_urls"),
        F.col("parts").alias("expected_chunk_ids"), F.col("parts").alias("effective_chunk_ids"), F.col("o_orderpriority").startswith("5").alias("effective_should_refuse"), F.array_join(F.transform("parts", name), "\n\n").alias("evidence_excerpt"), F.concat(F.lit("doc "), F.col("o_custkey").cast("string")).alias("document_title"), F.lit("BUILDING").alias("source_title"),
    )
    documents = tables.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("https://h/"), F.col("c_nationkey").cast("string")).alias("url"), F.concat(F.lit("doc "), F.col("c_custkey").cast("string")).alias("title"), F.col("c_mktsegment").alias("source_title"))
    chunks = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("document_id"), name(F.col("p_partkey")).alias("content"))
    return review.row_faults(rows, documents, chunks)
