"""Registered queries: evaluation samples, their metrics, failure analysis, guards and reports.

A sample is an order: its lines, in order of line number, are what was retrieved; flags, prices and quantities
of lines tell which of them were relevant, expected and cited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, failures
from ..registry import query
from ..sources import tables

SAMPLES = """lined AS (SELECT l_orderkey AS question_id, count(*) AS lines, sum(l_quantity)::BIGINT AS token_count, count(*) FILTER (l_discount > 0.08) AS bad,
 list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) AS retrieved_ids, list(DISTINCT l_partkey % 50) FILTER (l_returnflag = 'R') AS relevant_ids,
 list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS retrieved_document_ids, list(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS relevant_document_ids,
 list(DISTINCT l_linenumber) FILTER (l_discount > 0.03) AS expected_answer_points, list(DISTINCT l_linenumber) FILTER (l_tax < 0.05) AS covered_answer_points,
 list(DISTINCT l_partkey % 50) FILTER (l_quantity > 30) AS expected_citation_ids, list(DISTINCT l_partkey % 50) FILTER (l_extendedprice > 30000) AS cited_ids,
 list(DISTINCT l_suppkey) FILTER (l_extendedprice > 30000) AS cited_document_ids,
 list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 4) AS reranked_ids, list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 3) AS context_ids,
 list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 2) AS selected_ids FROM lineitem GROUP BY 1),
samples AS (SELECT question_id, retrieved_ids, coalesce(relevant_ids, []) AS relevant_ids, retrieved_document_ids, coalesce(relevant_document_ids, []) AS relevant_document_ids,
 coalesce(expected_answer_points, []) AS expected_answer_points, coalesce(covered_answer_points, []) AS covered_answer_points, coalesce(expected_citation_ids, []) AS expected_citation_ids,
 coalesce(cited_ids, []) AS cited_ids, coalesce(cited_document_ids, []) AS cited_document_ids, coalesce(reranked_ids, []) AS reranked_ids, coalesce(context_ids, []) AS context_ids, coalesce(selected_ids, []) AS selected_ids,
 o_orderstatus = 'O' AND question_id % 3 = 0 AS should_refuse, o_totalprice < 100000 AS refused, question_id % 17 = 0 AS evaluation_failed,
 CASE question_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS grounding_validated, bad AS hallucinated_claims, CASE WHEN question_id % 5 = 0 THEN 0 ELSE lines END AS claim_count,
 token_count, o_totalprice AS latency_ms, o_totalprice / 1000000 AS cost, o_orderpriority AS category, question_id % 4 < 3 AS rerank_applied, CASE question_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS sufficient,
 CASE WHEN o_totalprice < 100000 THEN [['answer_contains_unsupported_relation'], ['low_confidence'], ['citations_do_not_cover_query']][(question_id % 3 + 1)::INT] ELSE [] END AS refusal_reasons
 FROM lined JOIN orders ON o_orderkey = question_id)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One evaluation sample per order; lines are reduced to arrays before they meet their order."""
    line = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 50).alias("chunk"), F.col("l_suppkey").alias("doc"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "chunk", "doc", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))
    of_order = line.groupBy(F.col("l_orderkey").alias("question_id")).agg(lines.alias("lines"))
    took = lambda name, keep=None: F.transform(F.filter("lines", keep) if keep else F.col("lines"), lambda x: x[name])
    which = lambda name, keep: F.array_distinct(took(name, keep))
    orders = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("category"))
    key = F.col("question_id")
    reasons = F.array(*[F.array(F.lit(r)) for r in ("answer_contains_unsupported_relation", "low_confidence", "citations_do_not_cover_query")])
    refused = F.col("o_totalprice") < 100000
    return of_order.join(orders, "question_id").select(
        "question_id",
        took("chunk").alias("retrieved_ids"),
        which("chunk", lambda x: x["l_returnflag"] == "R").alias("relevant_ids"),
        F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(x["l_linenumber"], x["doc"]))), lambda x: x["doc"]).alias("retrieved_document_ids"),
        which("doc", lambda x: x["l_linestatus"] == "F").alias("relevant_document_ids"),
        which("l_linenumber", lambda x: x["l_discount"] > 0.03).alias("expected_answer_points"),
        which("l_linenumber", lambda x: x["l_tax"] < 0.05).alias("covered_answer_points"),
        which("chunk", lambda x: x["l_quantity"] > 30).alias("expected_citation_ids"),
        which("chunk", lambda x: x["l_extendedprice"] > 30000).alias("cited_ids"),
        which("doc", lambda x: x["l_extendedprice"] > 30000).alias("cited_document_ids"),
        took("chunk", lambda x: x["l_linenumber"] <= 4).alias("reranked_ids"),
        took("chunk", lambda x: x["l_linenumber"] <= 3).alias("context_ids"),
        took("chunk", lambda x: x["l_linenumber"] <= 2).alias("selected_ids"),
        ((F.col("o_orderstatus") == "O") & (key % 3 == 0)).alias("should_refuse"),
        refused.alias("refused"),
        (key % 17 == 0).alias("evaluation_failed"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("grounding_validated"),
        F.size(F.filter("lines", lambda x: x["l_discount"] > 0.08)).cast("long").alias("hallucinated_claims"),
        F.when(key % 5 == 0, 0).otherwise(F.size("lines")).cast("long").alias("claim_count"),
        F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["l_quantity"]).cast("long").alias("token_count"),
        F.col("o_totalprice").alias("latency_ms"),
        (F.col("o_totalprice") / 1000000).alias("cost"),
        "category",
        (key % 4 < 3).alias("rerank_applied"),
        F.when(key % 7 == 0, None).otherwise(key % 7 != 1).alias("sufficient"),
        F.when(refused, reasons[(key % 3).cast("int")]).otherwise(F.array().cast("array<string>")).alias("refusal_reasons"),
    )


def _in(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE"


def _rank(x: str) -> str:
    return f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_contains(want, {x}[i]) THEN i END), lambda i: i IS NOT NULL)"


MEASURED = f"""staged AS (SELECT *, CASE WHEN len(relevant_ids) > 0 THEN retrieved_ids ELSE retrieved_document_ids END AS got, CASE WHEN len(relevant_ids) > 0 THEN relevant_ids ELSE relevant_document_ids END AS want,
 len(expected_citation_ids) = 0 AND NOT should_refuse AND len(relevant_document_ids) > 0 AS by_doc FROM samples),
sets AS (SELECT *, CASE WHEN by_doc THEN cited_document_ids ELSE cited_ids END AS cited, CASE WHEN by_doc THEN relevant_document_ids ELSE expected_citation_ids END AS expected,
 list_filter(got, lambda x, i: list_position(got, x) = i) AS once FROM staged),
places AS (SELECT *, {_rank('once')} AS p FROM sets),
measured AS (SELECT *,
 CASE WHEN len(relevant_document_ids) = 0 OR list_has_any(retrieved_document_ids, relevant_document_ids) THEN 1.0 ELSE 0.0 END AS document_hit,
 CASE WHEN len(relevant_ids) = 0 OR list_has_any(retrieved_ids, relevant_ids) THEN 1.0 ELSE 0.0 END AS chunk_hit,
 {', '.join(f"CASE WHEN len(want) = 0 THEN 1.0 ELSE {_in(f'list_distinct(got[1:{k}])', 'want')} / len(want) END AS recall_at_{k}" for k in (1, 5, 10))},
 CASE WHEN len(want) = 0 THEN 1.0 ELSE coalesce(1.0::DOUBLE / p[1], 0) END AS reciprocal_rank,
 CASE WHEN len(want) = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(list_filter(p, lambda i: i <= 10), lambda i: 1 / log2(i + 1.0))), 0) / list_sum(list_transform(range(1, least(10, len(want)) + 1), lambda i: 1 / log2(i + 1.0))) END AS ndcg_at_10,
 CASE WHEN len(expected_answer_points) = 0 THEN 1.0 ELSE {_in('covered_answer_points', 'expected_answer_points')} / len(expected_answer_points) END AS answer_point_coverage,
 CASE WHEN len(cited) = 0 THEN 0.0 ELSE {_in('cited', 'expected')} / len(cited) END AS citation_accuracy,
 CASE WHEN len(expected) = 0 THEN 0.0 ELSE {_in('cited', 'expected')} / len(expected) END AS citation_completeness,
 CASE WHEN len(cited_document_ids) = 0 THEN 0.0 ELSE {_in('cited_document_ids', 'relevant_document_ids')} / len(cited_document_ids) END AS document_citation_accuracy,
 CASE WHEN len(relevant_document_ids) = 0 THEN 0.0 ELSE {_in('cited_document_ids', 'relevant_document_ids')} / len(relevant_document_ids) END AS document_citation_completeness,
 (NOT evaluation_failed AND refused = should_refuse)::INT::DOUBLE AS refusal_correct,
 CASE WHEN claim_count > 0 THEN hallucinated_claims / claim_count::DOUBLE ELSE 0 END AS hallucination_rate,
 CASE WHEN refused THEN 0.0 WHEN grounding_validated IS NOT NULL THEN grounding_validated::INT WHEN len(cited) = 0 THEN 0 WHEN claim_count > 0 THEN (hallucinated_claims = 0)::INT ELSE 1 END::DOUBLE AS answer_grounded,
 (NOT evaluation_failed AND should_refuse AND NOT refused)::INT::DOUBLE AS unsupported_answer, (NOT evaluation_failed)::INT::DOUBLE AS evaluation_success FROM places)"""

_scored, _cites, _answered, _refusals = "NOT evaluation_failed", "NOT evaluation_failed AND NOT (should_refuse AND refused)", "NOT evaluation_failed AND NOT refused", "NOT evaluation_failed AND should_refuse"


def _mean(name: str, over: str) -> str:
    return f"round(coalesce(avg({name}) FILTER ({over}), 0), 6)"


def _of(n: str, d: str) -> str:
    return f"round(coalesce({n} / nullif({d}, 0)::DOUBLE, 0), 6)"


AGGREGATES = {
    "question_count": "count(*)",
    **{f"recall_at_{k}": _mean(f"recall_at_{k}", _scored) for k in (1, 5, 10)},
    "mrr": _mean("reciprocal_rank", _scored),
    "ndcg_at_10": _mean("ndcg_at_10", _scored),
    "answer_point_coverage": _mean("answer_point_coverage", _scored),
    "citation_accuracy": _mean("citation_accuracy", _cites),
    "citation_completeness": _mean("citation_completeness", _cites),
    "refusal_accuracy": _mean("refusal_correct", _scored),
    "hallucination_rate": _of("sum(CASE WHEN claim_count > 0 THEN hallucinated_claims ELSE 0 END)", "sum(CASE WHEN claim_count > 0 THEN claim_count ELSE 0 END)"),
    "citation_precision": _mean("citation_accuracy", _cites),
    "citation_recall": _mean("citation_completeness", _cites),
    "emitted_citation_precision": _mean("citation_accuracy", _answered),
    "emitted_citation_recall": _mean("citation_completeness", _answered),
    "document_citation_precision": _mean("document_citation_accuracy", _cites),
    "document_citation_recall": _mean("document_citation_completeness", _cites),
    "emitted_document_citation_precision": _mean("document_citation_accuracy", _answered),
    "emitted_document_citation_recall": _mean("document_citation_completeness", _answered),
    "answer_grounding_rate": _mean("answer_grounded", _answered),
    "unsupported_answer_rate": _mean("unsupported_answer", _refusals),
    "refusal_precision": _of(f"count(*) FILTER ({_refusals} AND refused)", f"count(*) FILTER ({_scored} AND refused)"),
    "refusal_recall": _of(f"count(*) FILTER ({_refusals} AND refused)", f"count(*) FILTER ({_refusals})"),
    "supported_answer_recall": _of(f"count(*) FILTER ({_answered} AND NOT should_refuse)", f"count(*) FILTER ({_scored} AND NOT should_refuse)"),
    "p50_latency_ms": "round(quantile_disc(latency_ms, 0.5), 6)",
    "p95_latency_ms": "round(quantile_disc(latency_ms, 0.95), 6)",
    "average_tokens": "round(avg(token_count), 6)",
    "average_cost": "round(avg(cost), 6)",
    "document_hit_rate": _mean("document_hit", _scored),
    "chunk_hit_rate": _mean("chunk_hit", _scored),
    "hallucination_assessed_claims": "coalesce(sum(claim_count), 0)::BIGINT",
    "hallucination_assessed_questions": "count(*) FILTER (claim_count > 0)",
    "citation_assessed_questions": f"count(*) FILTER ({_cites})",
    "answer_grounding_assessed_questions": f"count(*) FILTER ({_answered})",
    "unsupported_answer_assessed_questions": f"count(*) FILTER ({_refusals})",
    "emitted_citation_assessed_questions": f"count(*) FILTER ({_answered})",
    "evaluation_error_count": "count(*) FILTER (evaluation_failed)",
    "quality_assessed_questions": f"count(*) FILTER ({_scored})",
}
_aggregates = ", ".join(f"{v} AS {k}" for k, v in AGGREGATES.items())


@query("sample_metrics", f"WITH {SAMPLES}, {MEASURED} SELECT question_id, {', '.join(f'round({m}, 6)::DOUBLE AS {m}' for m in evaluation.SAMPLE_METRICS)} FROM measured")
def sample_metrics(spark, sf):
    """The 17 metrics of every sample."""
    m = evaluation.evaluate_samples(samples(spark, sf))
    return m.select("question_id", *[F.round(k, 6).alias(k) for k in evaluation.SAMPLE_METRICS])


@query("evaluation_aggregate", f"WITH {SAMPLES}, {MEASURED} SELECT {_aggregates} FROM measured")
def evaluation_aggregate(spark, sf):
    """The 38 aggregate metrics over all samples."""
    return evaluation.aggregate_samples(evaluation.evaluate_samples(samples(spark, sf)))


@query("evaluation_by_category", f"WITH {SAMPLES}, {MEASURED} SELECT category, {_aggregates} FROM measured GROUP BY 1")
def evaluation_by_category(spark, sf):
    return evaluation.aggregate_samples(evaluation.evaluate_samples(samples(spark, sf)), "category")


#: The ladder of root causes over a sample's stages; the first that holds wins.
_overlap = "(len(expected_citation_ids) = 0 OR list_has_any(expected_citation_ids, {0}))"
_all = "(len(expected_citation_ids) = 0 OR len(list_filter(expected_citation_ids, lambda x: NOT list_contains({0}, x))) = 0)"
CASES = f"""cases AS (SELECT *, CASE WHEN rerank_applied THEN reranked_ids ELSE context_ids END AS after_rerank, NOT refused AND question_id % 11 > 0 AS answer_present FROM measured),
staged_cases AS (SELECT *, {_overlap.format('retrieved_ids')} AS retrieval_any, {_all.format('retrieved_ids')} AS retrieval_all, {_overlap.format('after_rerank')} AS rerank_any, {_all.format('after_rerank')} AS rerank_all,
 {_overlap.format('context_ids')} AS final_any, {_all.format('context_ids')} AS final_all, {_overlap.format('selected_ids')} AS context_any, {_all.format('selected_ids')} AS context_all,
 {_overlap.format('cited_ids')} AS cited_any, {_all.format('cited_ids')} AS cited_all, len(relevant_document_ids) = 0 OR list_has_any(relevant_document_ids, cited_document_ids) AS documents_any FROM cases),
judged AS (SELECT *, CASE WHEN evaluation_failed THEN 'EVALUATION_ERROR' WHEN should_refuse AND refused THEN 'CORRECT_REFUSAL' WHEN should_refuse THEN 'OTHER' WHEN NOT retrieval_any THEN 'RETRIEVAL_MISS'
  WHEN rerank_applied AND NOT rerank_any THEN 'RERANK_DROPPED_REQUIRED_EVIDENCE' WHEN NOT final_any THEN 'CONTEXT_PACKING_DROPPED_EVIDENCE' WHEN sufficient = false THEN 'EVIDENCE_GATE_FALSE_NEGATIVE'
  WHEN refused AND len(list_filter(refusal_reasons, lambda r: starts_with(r, 'answer_') OR r = 'citations_do_not_cover_query')) > 0 THEN 'POST_ANSWER_VALIDATION_UNRESOLVED' WHEN refused OR NOT answer_present THEN 'INCORRECT_REFUSAL'
  WHEN len(cited_ids) > 0 AND NOT cited_any THEN CASE WHEN documents_any THEN 'CITATION_EXPECTATION_MISMATCH' ELSE 'CITATION_MAPPING_ERROR' END WHEN NOT cited_all THEN 'MULTI_CHUNK_CITATION_INCOMPLETE'
  WHEN len(selected_ids) > 0 AND len(cited_ids) = 0 THEN 'CITATION_MAPPING_ERROR' ELSE 'NO_FAILURE' END AS root_cause,
 list_filter([CASE WHEN chunk_hit = 0 AND len(expected_citation_ids) > 0 THEN 'retrieval' END, CASE WHEN refusal_correct = 0 THEN 'refusal' END, CASE WHEN sufficient = should_refuse THEN 'evidence_sufficiency' END,
  CASE WHEN NOT (should_refuse AND refused) AND citation_accuracy < 1 THEN 'exact_citation_precision' END, CASE WHEN NOT (should_refuse AND refused) AND citation_completeness < 1 THEN 'exact_citation_recall' END,
  CASE WHEN NOT refused AND len(cited_ids) = 0 THEN 'citation_missing' END], lambda x: x IS NOT NULL) AS metric_failures FROM staged_cases)"""
_with_cases = f"WITH {SAMPLES}, {MEASURED}, {CASES}"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    measured = evaluation.evaluate_samples(samples(spark, sf))
    return failures.judge(measured.withColumn("answer_present", ~F.col("refused") & (F.col("question_id") % 11 > 0)))


@query("failure_cases", f"{_with_cases} SELECT question_id, root_cause, array_to_string(metric_failures, ',') AS metric_failures, retrieval_any, retrieval_all, rerank_any, rerank_all, final_any, final_all, context_any, context_all FROM judged")
def failure_cases(spark, sf):
    c = cases(spark, sf)
    return c.select("question_id", "root_cause", F.array_join("metric_failures", ",").alias("metric_failures"), *[f"{s}_{k}" for s in ("retrieval", "rerank", "final", "context") for k in ("any", "all")])


@query("root_cause_distribution", f"{_with_cases} SELECT root_cause, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS of_all, CASE WHEN root_cause IN ('NO_FAILURE', 'CORRECT_REFUSAL') THEN 0 ELSE round(count(*)::DOUBLE / nullif(sum(CASE WHEN root_cause IN ('NO_FAILURE', 'CORRECT_REFUSAL') THEN 0 ELSE count(*) END) OVER (), 0), 6) END::DOUBLE AS of_failures FROM judged GROUP BY 1 ORDER BY n DESC, root_cause")
def root_cause_distribution(spark, sf):
    return failures.distribution(cases(spark, sf))


_stages = (("gold_evidence_present_in_top10", "retrieval"), ("present_after_rerank", "rerank"), ("present_in_final_retrieval", "final"), ("present_after_context_packing", "context"), ("cited", "cited"))


@query("evidence_funnel", _with_cases + " " + " UNION ALL ".join(f"SELECT '{name}' AS stage, count(*) AS supported, count(*) FILTER ({k}_any) AS any_count, {_of(f'count(*) FILTER ({k}_any)', 'count(*)')} AS any_rate, count(*) FILTER ({k}_all) AS complete_count, {_of(f'count(*) FILTER ({k}_all)', 'count(*)')} AS complete_rate FROM judged WHERE NOT should_refuse" for name, k in _stages))
def evidence_funnel(spark, sf):
    return failures.funnel(cases(spark, sf))


@query("refusal_matrix", f"{_with_cases} SELECT count(*) FILTER (NOT should_refuse AND NOT refused) AS answer_answer, count(*) FILTER (NOT should_refuse AND refused) AS answer_refuse, count(*) FILTER (should_refuse AND NOT refused) AS refuse_answer, count(*) FILTER (should_refuse AND refused) AS refuse_refuse, {_of('count(*) FILTER (should_refuse AND refused)', 'count(*) FILTER (refused)')} AS refusal_precision, {_of('count(*) FILTER (should_refuse AND refused)', 'count(*) FILTER (should_refuse)')} AS refusal_recall, {_of('count(*) FILTER (should_refuse = refused)', 'count(*)')} AS refusal_accuracy, {_of('count(*) FILTER (NOT should_refuse AND NOT refused)', 'count(*) FILTER (NOT should_refuse)')} AS supported_answer_recall, count(*) AS assessed FROM judged WHERE NOT evaluation_failed")
def refusal_matrix(spark, sf):
    return failures.refusal_matrix(cases(spark, sf))


AUDIT = """picked AS (SELECT *, CASE WHEN list_has_any(metric_failures, ['exact_citation_precision', 'exact_citation_recall']) THEN 0 ELSE 1 END AS tier FROM judged WHERE answer_present),
ranked AS (SELECT *, CASE WHEN tier = 0 THEN row_number() OVER (PARTITION BY tier ORDER BY question_id) END AS nth_failure FROM picked),
chosen AS (SELECT *, CASE WHEN nth_failure <= 10 THEN 'failure' WHEN tier = 1 OR cited_any THEN 'success' END AS outcome FROM ranked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY tier DESC, question_id) AS nth FROM chosen WHERE outcome IS NOT NULL),
audited AS (SELECT * FROM numbered WHERE nth <= CASE outcome WHEN 'failure' THEN 10 ELSE 5 END)"""


@query("citation_audit", f"{_with_cases}, {AUDIT} SELECT question_id, outcome, chunk_id, list_contains(expected_citation_ids, chunk_id) AS exact_gold_chunk, len(list_filter(expected_citation_ids, lambda x: abs(x - chunk_id) = 1 AND x // 10 = chunk_id // 10)) > 0 AS adjacent_to_gold_seed FROM (SELECT *, unnest(cited_ids) AS chunk_id FROM audited)")
def citation_audit(spark, sf):
    """The cited chunks of the audited cases; here ten neighbouring chunk numbers are one document."""
    a = failures.audited(cases(spark, sf)).select("question_id", "outcome", "expected_citation_ids", F.explode("cited_ids").alias("chunk_id"))
    beside = F.exists("expected_citation_ids", lambda x: (F.abs(x - F.col("chunk_id")) == 1) & (F.floor(x / 10) == F.floor(F.col("chunk_id") / 10)))
    return a.select("question_id", "outcome", "chunk_id", F.array_contains("expected_citation_ids", F.col("chunk_id")).alias("exact_gold_chunk"), beside.alias("adjacent_to_gold_seed"))


@query(
    "case_statuses",
    f"""{_with_cases} SELECT question_id, CASE WHEN evaluation_failed THEN 'EVALUATION_ERROR' WHEN should_refuse THEN CASE WHEN refused THEN 'CORRECT_REFUSAL' ELSE 'UNSAFE_ANSWER' END WHEN refused THEN 'INCORRECT_REFUSAL' WHEN answer_point_coverage = 1 THEN 'EXACT_GOLD_ANSWER_POINT_MATCH' ELSE 'ANSWER_ACCEPTED_CORRECTNESS_NOT_ESTABLISHED_BY_CURRENT_GOLD_CONTRACT' END AS answer_status,
 CASE WHEN list_contains(refusal_reasons, 'citations_do_not_cover_query') THEN 'rejected' WHEN refused AND sufficient IS NULL THEN 'not_run' WHEN refused THEN 'rejected' WHEN len(cited_ids) > 0 THEN 'passed' ELSE 'failed' END AS citation_status,
 CASE WHEN sufficient = false AND question_id % 2 = 0 THEN 'rejected' WHEN list_contains(refusal_reasons, 'answer_contains_unsupported_relation') THEN 'rejected' ELSE 'passed_or_not_applicable' END AS relation_status,
 CASE WHEN sufficient = false AND question_id % 2 = 0 THEN 'pre_answer_evidence_gate' WHEN list_contains(refusal_reasons, 'answer_contains_unsupported_relation') THEN 'post_answer_validation' ELSE 'not_triggered' END AS relation_stage FROM judged""",
)
def case_statuses(spark, sf):
    missing = F.when((F.col("sufficient") == False) & (F.col("question_id") % 2 == 0), "evidence_missing_required_relation")  # noqa: E712
    return failures.statuses(cases(spark, sf).withColumn("evidence_reason", missing).withColumn("support_validated", F.col("sufficient")))


@query("metric_failure_counts", f"{_with_cases} SELECT failure, count(*) AS n FROM (SELECT unnest(metric_failures) AS failure FROM judged) GROUP BY 1")
def metric_failure_counts(spark, sf):
    return cases(spark, sf).select(F.explode("metric_failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


@query("quality_guard", f"WITH {SAMPLES}, {MEASURED}, a AS (SELECT category, {_aggregates} FROM measured GROUP BY 1) SELECT category, recall_at_5 >= 0.2 AS recall_kept, mrr >= 0.2 AS rank_kept, citation_precision >= 0.3 AS precision_kept, answer_grounding_rate >= 0.3 AS grounding_kept, unsupported_answer_rate <= 0.9 AS refusals_kept, evaluation_error_count * 10 <= question_count AS errors_kept, recall_at_5 >= 0.2 AND mrr >= 0.2 AND citation_precision >= 0.3 AND answer_grounding_rate >= 0.3 AND unsupported_answer_rate <= 0.9 AND evaluation_error_count * 10 <= question_count AS passed FROM a")
def quality_guard(spark, sf):
    """Six checks on the aggregates of each category; all must hold."""
    a = evaluation.aggregate_samples(evaluation.evaluate_samples(samples(spark, sf)), "category")
    checks = {"recall_kept": "recall_at_5 >= 0.2", "rank_kept": "mrr >= 0.2", "precision_kept": "citation_precision >= 0.3", "grounding_kept": "answer_grounding_rate >= 0.3", "refusals_kept": "unsupported_answer_rate <= 0.9", "errors_kept": "evaluation_error_count * 10 <= question_count"}
    return evaluation.guard(a, "category", checks)


@query("question_report", f"WITH {SAMPLES}, {MEASURED} SELECT question_id, category, array_to_string(list_sort(cited_ids), '|') AS cited, array_to_string(list_sort(expected_citation_ids), '|') AS expected, array_to_string(retrieved_ids[1:5], '|') AS top5, round(recall_at_5, 6)::DOUBLE AS recall_at_5, round(citation_accuracy, 6)::DOUBLE AS citation_accuracy, refused, should_refuse FROM measured")
def question_report(spark, sf):
    """One flat row per question, as reports are written."""
    return evaluation.report_rows(evaluation.evaluate_samples(samples(spark, sf)))


@query("variant_projection", f"WITH {SAMPLES}, {MEASURED} SELECT question_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {m} < 1 THEN {chr(39)}{m}{chr(39)} END' for m in ('recall_at_5', 'reciprocal_rank', 'citation_accuracy', 'answer_grounded', 'refusal_correct'))}], lambda x: x IS NOT NULL), ',') AS failed_metrics, recall_at_5 = 1 AND reciprocal_rank = 1 AND citation_accuracy = 1 AND answer_grounded = 1 AND refusal_correct = 1 AS passed FROM measured")
def variant_projection(spark, sf):
    """Per case the metrics of an experiment's variant that are below one; a case passes with none."""
    m = evaluation.evaluate_samples(samples(spark, sf))
    failed = F.array_compact(F.array(*[F.when(F.col(k) < 1, k) for k in ("recall_at_5", "reciprocal_rank", "citation_accuracy", "answer_grounded", "refusal_correct")]))
    return m.select("question_id", F.array_join(failed, ",").alias("failed_metrics"), (F.size(failed) == 0).alias("passed"))


@query("refused_supported", f"WITH {SAMPLES} SELECT CASE WHEN refused THEN 'refused' ELSE 'answered' END AS status, count(*) AS n, round(coalesce(avg(claim_count), 0), 6) AS claims FROM samples WHERE list_contains([1, 3, 5], question_id % 7) GROUP BY 1")
def refused_supported(spark, sf):
    """Traces looked up by a list of ids, small enough to be part of the filter."""
    s = samples(spark, sf).where((F.col("question_id") % 7).isin(1, 3, 5))
    return s.groupBy(F.when(F.col("refused"), "refused").otherwise("answered").alias("status")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("claim_count"), F.lit(0.0)), 6).alias("claims"))
