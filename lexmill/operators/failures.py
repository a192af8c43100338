"""Failure analysis of evaluated samples: where evidence was lost, refusals, audits and status ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import ratio

#: Causes that are no failure.
PASSED = ("NO_FAILURE", "CORRECT_REFUSAL")
#: Names of the funnel's stages, and the prefix of their flags.
STAGES = {"gold_evidence_present_in_top10": "retrieval", "present_after_rerank": "rerank", "present_in_final_retrieval": "final", "present_after_context_packing": "context", "cited": "cited"}


def overlaps(expected: Column, actual: Column) -> Column:
    """Whether they share an element; nothing expected is always met."""
    return (F.size(expected) == 0) | F.arrays_overlap(expected, actual)


def contains_all(actual: Column, expected: Column) -> Column:
    return F.size(F.array_except(expected, actual)) == 0


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` samples with flags of each stage, ``root_cause`` and ``metric_failures``.

    Stages are arrays of chunk ids: retrieved_ids, reranked_ids, context_ids, selected_ids, cited_ids. Where
    reranking was not applied, what reached the context counts as reranked.
    """
    c = F.col
    staged = measured.withColumn("after_rerank", F.when(c("rerank_applied"), c("reranked_ids")).otherwise(c("context_ids")))
    expected = c("expected_citation_ids")
    arrays = {"retrieval": "retrieved_ids", "rerank": "after_rerank", "final": "context_ids", "context": "selected_ids", "cited": "cited_ids"}
    flags = [f(c(a)).alias(f"{s}_{k}") for s, a in arrays.items() for k, f in (("any", lambda x: overlaps(expected, x)), ("all", lambda x: contains_all(x, expected)))]
    flagged = staged.select("*", *flags, overlaps(c("relevant_document_ids"), c("cited_document_ids")).alias("documents_any"))
    late = F.exists("refusal_reasons", lambda r: r.startswith("answer_") | (r == "citations_do_not_cover_query"))
    cause = (
        F.when(c("evaluation_failed"), "EVALUATION_ERROR")
        .when(c("should_refuse") & c("refused"), "CORRECT_REFUSAL")
        .when(c("should_refuse"), "OTHER")
        .when(~c("retrieval_any"), "RETRIEVAL_MISS")
        .when(c("rerank_applied") & ~c("rerank_any"), "RERANK_DROPPED_REQUIRED_EVIDENCE")
        .when(~c("final_any"), "CONTEXT_PACKING_DROPPED_EVIDENCE")
        .when(~F.coalesce("sufficient", F.lit(True)), "EVIDENCE_GATE_FALSE_NEGATIVE")
        .when(c("refused") & late, "POST_ANSWER_VALIDATION_UNRESOLVED")
        .when(c("refused") | ~c("answer_present"), "INCORRECT_REFUSAL")
        .when((F.size("cited_ids") > 0) & ~c("cited_any"), F.when(c("documents_any"), "CITATION_EXPECTATION_MISMATCH").otherwise("CITATION_MAPPING_ERROR"))
        .when(~c("cited_all"), "MULTI_CHUNK_CITATION_INCOMPLETE")
        .when((F.size("selected_ids") > 0) & (F.size("cited_ids") == 0), "CITATION_MAPPING_ERROR")
        .otherwise("NO_FAILURE")
    )
    cites = ~(c("should_refuse") & c("refused"))
    failed = F.array_compact(
        F.array(
            F.when((c("chunk_hit") == 0) & (F.size(expected) > 0), "retrieval"),
            F.when(c("refusal_correct") == 0, "refusal"),
            F.when(c("sufficient") == c("should_refuse"), "evidence_sufficiency"),
            F.when(cites & (c("citation_accuracy") < 1), "exact_citation_precision"),
            F.when(cites & (c("citation_completeness") < 1), "exact_citation_recall"),
            F.when(~c("refused") & (F.size("cited_ids") == 0), "citation_missing"),
        )
    )
    return flagged.select("*", cause.alias("root_cause"), failed.alias("metric_failures"))


def distribution(cases: DataFrame) -> DataFrame:
    """(root_cause, n, of_all, of_failures), most frequent first; causes that are no failure have no share of failures."""
    n = cases.groupBy("root_cause").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row for each cause
    fails = ~F.col("root_cause").isin(*PASSED)
    share = F.when(fails, F.round(ratio(F.col("n"), F.sum(F.when(fails, F.col("n")).otherwise(0)).over(every)), 6)).otherwise(0.0)
    return n.select("root_cause", "n", F.round(ratio(F.col("n"), F.sum("n").over(every)), 6).alias("of_all"), share.alias("of_failures")).orderBy(F.desc("n"), "root_cause")


def funnel(cases: DataFrame) -> DataFrame:
    """(stage, supported, any_count, any_rate, complete_count, complete_rate) of the cases that should be answered, from one aggregation."""
    kept = cases.where(~F.col("should_refuse"))
    one = kept.agg(F.count("*").alias("supported"), *[F.count_if(F.col(f"{s}_{k}")).alias(f"{s}_{k}") for s in STAGES.values() for k in ("any", "all")])
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(f"{s}_any").alias("any_count"), F.col(f"{s}_all").alias("complete_count")) for name, s in STAGES.items()])
    said = one.select("supported", F.explode(rows).alias("r")).select("supported", "r.*")
    rate = lambda n: F.round(ratio(F.col(n), F.col("supported")), 6)
    return said.select("stage", "supported", "any_count", rate("any_count").alias("any_rate"), "complete_count", rate("complete_count").alias("complete_rate"))


def refusal_matrix(cases: DataFrame) -> DataFrame:
    """What should and what did happen, over cases that could be assessed."""
    s, r = F.col("should_refuse"), F.col("refused")
    n = cases.where("root_cause <> 'EVALUATION_ERROR'").agg(F.count_if(~s & ~r).alias("answer_answer"), F.count_if(~s & r).alias("answer_refuse"), F.count_if(s & ~r).alias("refuse_answer"), F.count_if(s & r).alias("refuse_refuse"), F.count("*").alias("assessed"))
    aa, ar, ra, rr = map(F.col, ("answer_answer", "answer_refuse", "refuse_answer", "refuse_refuse"))
    rates = {"refusal_precision": (rr, ar + rr), "refusal_recall": (rr, ra + rr), "refusal_accuracy": (aa + rr, F.col("assessed")), "supported_answer_recall": (aa, aa + ar)}
    return n.select("*", *[F.round(ratio(a, b), 6).alias(k) for k, (a, b) in rates.items()])


def audited(cases: DataFrame, failures: int = 10, successes: int = 5) -> DataFrame:
    """Answered cases to audit by hand, with ``outcome``: the first failures of exact citation; successes, exact ones before those that overlap."""
    exact = ~F.arrays_overlap("metric_failures", F.array(F.lit("exact_citation_precision"), F.lit("exact_citation_recall")))
    answered = cases.where("answer_present").withColumn("exact", exact)
    fails = answered.where("not exact").orderBy("question_id").limit(failures).withColumn("outcome", F.lit("failure"))
    rest = answered.join(fails.select("question_id"), "question_id", "left_anti")
    good = rest.where("exact or cited_any").orderBy(F.desc("exact"), "question_id").limit(successes).withColumn("outcome", F.lit("success"))
    return fails.unionByName(good)


def statuses(cases: DataFrame) -> DataFrame:
    """(question_id, answer_status, citation_status, relation_status, relation_stage) from flags, reasons and the evidence decision."""
    c = F.col
    uncovered = F.array_contains("refusal_reasons", "citations_do_not_cover_query")
    unsupported = F.array_contains("refusal_reasons", "answer_contains_unsupported_relation")
    missing = F.coalesce(c("evidence_reason") == "evidence_missing_required_relation", F.lit(False))
    answer = (
        F.when(c("evaluation_failed"), "EVALUATION_ERROR")
        .when(c("should_refuse"), F.when(c("refused"), "CORRECT_REFUSAL").otherwise("UNSAFE_ANSWER"))
        .when(c("refused"), "INCORRECT_REFUSAL")
        .when(c("answer_point_coverage") == 1, "EXACT_GOLD_ANSWER_POINT_MATCH")
        .otherwise("ANSWER_ACCEPTED_CORRECTNESS_NOT_ESTABLISHED_BY_CURRENT_GOLD_CONTRACT")
    )
    citation = F.when(uncovered, "rejected").when(c("refused") & c("support_validated").isNull(), "not_run").when(c("refused"), "rejected").when(F.size("cited_ids") > 0, "passed").otherwise("failed")
    stage = F.when(missing, "pre_answer_evidence_gate").when(unsupported, "post_answer_validation").otherwise("not_triggered")
    return cases.select("question_id", answer.alias("answer_status"), citation.alias("citation_status"), F.when(missing | unsupported, "rejected").otherwise("passed_or_not_applicable").alias("relation_status"), stage.alias("relation_stage"))
