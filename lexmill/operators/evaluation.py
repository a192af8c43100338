"""Retrieval and refusal metrics as row expressions over arrays and one conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Nothing relevant counts as found."""
    return F.when(F.size(relevant) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.greatest(F.size(F.array_distinct(relevant)), F.lit(1)))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    seen = F.array_distinct(retrieved)
    places = F.filter(F.transform(seen, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(relevant) == 0, 1.0).otherwise(F.coalesce(1.0 / F.try_element_at(places, F.lit(1)), F.lit(0.0)))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    found = gain(F.transform(F.slice(F.array_distinct(retrieved), 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1 / F.log2(i + 2.0)).otherwise(0.0)))
    best = gain(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(F.array_distinct(relevant))))), lambda i: 1 / F.log2(i + 1.0)))
    return F.when(F.size(relevant) == 0, 1.0).otherwise(found / best)


def sample_metrics(samples: DataFrame) -> DataFrame:
    """``samples`` (query_id, retrieved, relevant) with recall, hit, reciprocal rank and nDCG."""
    r, v = F.col("retrieved"), F.col("relevant")
    return samples.select(
        "query_id",
        *[F.round(recall_at(r, v, k), 6).alias(f"recall_{k}") for k in (1, 5, 10)],
        F.when((F.size(v) == 0) | F.arrays_overlap(F.slice(r, 1, 5), v), 1.0).otherwise(0.0).alias("hit_5"),
        F.round(reciprocal_rank(r, v), 6).alias("mrr"),
        *[F.round(ndcg_at(r, v, k), 6).alias(f"ndcg_{k}") for k in (5, 10)],
    )


def _hit(retrieved: Column, relevant: Column) -> Column:
    return F.when((F.size(relevant) == 0) | F.arrays_overlap(retrieved, relevant), 1.0).otherwise(0.0)


def _share(actual: Column, expected: Column, of: Column, none: float) -> Column:
    """Size of the intersection by the size of ``of``; ``none`` where that is empty."""
    return F.when(F.size(of) == 0, none).otherwise(F.size(F.array_intersect(actual, expected)) / F.nullif(F.size(F.array_distinct(of)), F.lit(0)))


#: Per-sample metrics, in the order in which reports list them.
SAMPLE_METRICS = "document_hit chunk_hit recall_at_1 recall_at_5 recall_at_10 reciprocal_rank ndcg_at_10 answer_point_coverage citation_accuracy citation_completeness document_citation_accuracy document_citation_completeness refusal_correct hallucination_rate answer_grounded unsupported_answer evaluation_success".split()


def evaluate_samples(samples: DataFrame) -> DataFrame:
    """``samples`` with the SAMPLE_METRICS: row expressions over its arrays, no shuffle.

    Ranking is judged on chunks, on documents where a sample has no relevant chunk. Citations are judged on
    chunks, on documents where no citation is expected of a sample that should be answered and has relevant documents.
    """
    c = F.col
    by_chunk = F.size("relevant_ids") > 0
    retrieved = F.when(by_chunk, c("retrieved_ids")).otherwise(c("retrieved_document_ids"))
    relevant = F.when(by_chunk, c("relevant_ids")).otherwise(c("relevant_document_ids"))
    by_document = (F.size("expected_citation_ids") == 0) & ~c("should_refuse") & (F.size("relevant_document_ids") > 0)
    staged = samples.select("*", retrieved.alias("_got"), relevant.alias("_want"), F.when(by_document, c("cited_document_ids")).otherwise(c("cited_ids")).alias("_cited"), F.when(by_document, c("relevant_document_ids")).otherwise(c("expected_citation_ids")).alias("_expected"))
    got, want, cited, expected = map(c, ("_got", "_want", "_cited", "_expected"))
    docs, right = c("cited_document_ids"), c("relevant_document_ids")
    grounded = (
        F.when(c("refused"), 0.0)
        .when(c("grounding_validated").isNotNull(), c("grounding_validated").cast("double"))
        .when(F.size(cited) == 0, 0.0)
        .when(c("claim_count") > 0, (c("hallucinated_claims") == 0).cast("double"))
        .otherwise(1.0)
    )
    metrics = {
        "document_hit": _hit(c("retrieved_document_ids"), right),
        "chunk_hit": _hit(c("retrieved_ids"), c("relevant_ids")),
        **{f"recall_at_{k}": recall_at(got, want, k) for k in (1, 5, 10)},
        "reciprocal_rank": reciprocal_rank(got, want),
        "ndcg_at_10": ndcg_at(got, want, 10),
        "answer_point_coverage": _share(c("covered_answer_points"), c("expected_answer_points"), c("expected_answer_points"), 1.0),
        "citation_accuracy": _share(cited, expected, cited, 0.0),
        "citation_completeness": _share(cited, expected, expected, 0.0),
        "document_citation_accuracy": _share(docs, right, docs, 0.0),
        "document_citation_completeness": _share(docs, right, right, 0.0),
        "refusal_correct": (~c("evaluation_failed") & (c("refused") == c("should_refuse"))).cast("double"),
        "hallucination_rate": F.when(c("claim_count") > 0, c("hallucinated_claims") / F.nullif(c("claim_count"), F.lit(0))).otherwise(0.0),
        "answer_grounded": grounded,
        "unsupported_answer": (~c("evaluation_failed") & c("should_refuse") & ~c("refused")).cast("double"),
        "evaluation_success": (~c("evaluation_failed")).cast("double"),
    }
    return staged.select(*samples.columns, *[metrics[k].alias(k) for k in SAMPLE_METRICS])


def aggregate_samples(measured: DataFrame, *by: str) -> DataFrame:
    """All aggregate metrics of ``evaluate_samples`` rows in one conditional aggregation and one of percentiles.

    Four denominators: scored samples (not failed) for ranking and refusals; those but correct refusals for citations;
    answered ones for emitted citations and grounding; all samples, failed too, for latency, tokens, cost and claims.
    """
    c = F.col
    scored = ~c("evaluation_failed")
    cites = scored & ~(c("should_refuse") & c("refused"))
    answered = scored & ~c("refused")
    refusals = scored & c("should_refuse")
    mean = lambda name, over: F.coalesce(F.avg(F.when(over, c(name))), F.lit(0.0))
    claims = F.sum(F.when(c("claim_count") > 0, c("claim_count")).otherwise(0))
    out = {
        "question_count": F.count("*"),
        "recall_at_1": mean("recall_at_1", scored),
        "recall_at_5": mean("recall_at_5", scored),
        "recall_at_10": mean("recall_at_10", scored),
        "mrr": mean("reciprocal_rank", scored),
        "ndcg_at_10": mean("ndcg_at_10", scored),
        "answer_point_coverage": mean("answer_point_coverage", scored),
        "citation_accuracy": mean("citation_accuracy", cites),
        "citation_completeness": mean("citation_completeness", cites),
        "refusal_accuracy": mean("refusal_correct", scored),
        "hallucination_rate": ratio(F.sum(F.when(c("claim_count") > 0, c("hallucinated_claims")).otherwise(0)), claims),
        "citation_precision": mean("citation_accuracy", cites),
        "citation_recall": mean("citation_completeness", cites),
        "emitted_citation_precision": mean("citation_accuracy", answered),
        "emitted_citation_recall": mean("citation_completeness", answered),
        "document_citation_precision": mean("document_citation_accuracy", cites),
        "document_citation_recall": mean("document_citation_completeness", cites),
        "emitted_document_citation_precision": mean("document_citation_accuracy", answered),
        "emitted_document_citation_recall": mean("document_citation_completeness", answered),
        "answer_grounding_rate": mean("answer_grounded", answered),
        "unsupported_answer_rate": mean("unsupported_answer", refusals),
        "refusal_precision": ratio(F.count_if(refusals & c("refused")), F.count_if(scored & c("refused"))),
        "refusal_recall": ratio(F.count_if(refusals & c("refused")), F.count_if(refusals)),
        "supported_answer_recall": ratio(F.count_if(answered & ~c("should_refuse")), F.count_if(scored & ~c("should_refuse"))),
        "average_tokens": F.coalesce(F.avg("token_count"), F.lit(0.0)),
        "average_cost": F.coalesce(F.avg("cost"), F.lit(0.0)),
        "document_hit_rate": mean("document_hit", scored),
        "chunk_hit_rate": mean("chunk_hit", scored),
        "hallucination_assessed_claims": F.coalesce(claims, F.lit(0)),
        "hallucination_assessed_questions": F.count_if(c("claim_count") > 0),
        "citation_assessed_questions": F.count_if(cites),
        "answer_grounding_assessed_questions": F.count_if(answered),
        "unsupported_answer_assessed_questions": F.count_if(refusals),
        "emitted_citation_assessed_questions": F.count_if(answered),
        "evaluation_error_count": F.count_if(c("evaluation_failed")),
        "quality_assessed_questions": F.count_if(scored),
    }
    counted = {k for k in out if k.endswith(("_count", "_questions", "_claims"))}
    summed = measured.groupBy(*by).agg(*[(v.cast("long") if k in counted else F.round(v, 6)).alias(k) for k, v in out.items()])
    ranks = nearest_rank(measured, list(by), "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    ranks = ranks.select(*by, *[F.round(p, 6).alias(p) for p in ("p50_latency_ms", "p95_latency_ms")])
    if by:
        return summed.join(ranks, list(by))
    # Without groups there is one row of each; no sample gives zeros.
    none = [F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50_latency_ms", "p95_latency_ms")]
    return summed.join(ranks, F.lit(True), "left").select(*summed.columns, *none)


def confusion(cases: DataFrame, *by: str) -> DataFrame:
    """Refusal confusion matrix with precision, recall and accuracy from boolean columns should_refuse and refused."""
    s, r = F.col("should_refuse"), F.col("refused")
    counts = cases.groupBy(*by).agg(F.count_if(s & r).alias("tp"), F.count_if(~s & r).alias("fp"), F.count_if(s & ~r).alias("fn"), F.count_if(~s & ~r).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select(*by, "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 6).alias("refusal_precision"), F.round(ratio(tp, tp + fn), 6).alias("refusal_recall"), F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("refusal_accuracy"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], buckets: int = 4096) -> DataFrame:
    """One row per group with the nearest-rank percentile of ``value`` for every name in ``quantiles``.

    No group is sorted in one task: values are counted in ``buckets`` steps between the group's least and greatest,
    which tells the bucket and the rank within it; only that bucket's values, counted by value, are ordered.
    """
    kept = rows.select(*by, F.col(value).cast("double").alias("x")).where("x is not null")
    bounds = kept.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    place = F.least(F.lit(buckets - 1), F.coalesce(F.floor((F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets), F.lit(0))).cast("int")
    # One row for each group, so its size is the number of groups; Spark broadcasts it only where that is small.
    placed = _with(kept, bounds, by).select(*by, "n", "x", place.alias("bucket"))
    below = Window.partitionBy(*by).orderBy("bucket")
    steps = placed.groupBy(*by, "n", "bucket").agg(F.count("*").alias("size")).withColumn("upto", F.sum("size").over(below))
    wanted = steps.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).alias("rank")) for k, q in quantiles.items()])).alias("q"))
    wanted = wanted.where("q.rank <= upto and q.rank > upto - size").select(*by, "bucket", "q.name", (F.col("q.rank") - F.col("upto") + F.col("size")).alias("rank"))
    inside = _with(placed.groupBy(*by, "bucket", "x").agg(F.count("*").alias("times")), wanted, [*by, "bucket"])
    upto = F.sum("times").over(Window.partitionBy(*by, "name").orderBy("x"))
    found = inside.withColumn("upto", upto).where("rank <= upto and rank > upto - times")
    return found.groupBy(*by).pivot("name", list(quantiles)).agg(F.first("x"))


def _with(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(table, on) if on else rows.crossJoin(table)  # without groups the table has one row


def latency_report(samples: DataFrame, *by: str, value: str = "value", error: Column | None = None, seconds: Column | None = None, goal: float | None = None) -> DataFrame:
    """Count, error rate, mean, nearest-rank percentiles and maximum; with ``seconds`` requests a second, with ``goal`` whether P95 keeps it."""
    bad = F.lit(False) if error is None else error
    extra = [] if seconds is None else [F.round(ratio(F.count("*"), seconds), 6).alias("rps")]
    report = samples.groupBy(*by).agg(F.count("*").alias("requests"), F.round(F.avg(bad.cast("double")), 6).alias("error_rate"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("max"), *extra)
    ranks = nearest_rank(samples, list(by), value, {f"p{q}": q / 100 for q in (50, 75, 95, 99)})
    out = _with(report, ranks.select(*by, *[F.round(f"p{q}", 6).alias(f"p{q}") for q in (50, 75, 95, 99)]), list(by))
    return out if goal is None else out.withColumn("goal_met", F.col("p95") < goal)


#: Metrics of which less is better.
LOWER_IS_BETTER = ("latency", "error_rate")


def compare(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.0, lower_is_better: tuple[str, ...] = LOWER_IS_BETTER) -> DataFrame:
    """(metric, baseline, candidate, delta, regressed) from two (metric, value) tables."""
    b, c = baseline.select("metric", F.col("value").alias("baseline")), candidate.select("metric", F.col("value").alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    worse = F.when(F.col("metric").isin(*lower_is_better), delta > tolerance).otherwise(delta < -tolerance)
    return b.join(c, "metric").select("metric", "baseline", "candidate", F.round(delta, 6).alias("delta"), worse.alias("regressed"))


def guard(metrics: DataFrame, by: str, checks: dict[str, str]) -> DataFrame:
    """(by, each check, passed): conditions over a row of aggregates; all must hold."""
    told = metrics.select(by, *[F.expr(v).alias(k) for k, v in checks.items()])
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return told.withColumn("passed", passed)


def report_rows(measured: DataFrame) -> DataFrame:
    """Flat rows of a report: sets in order, joined by bars."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "|")
    return measured.select(
        "question_id",
        "category",
        joined(F.array_sort("cited_ids")).alias("cited"),
        joined(F.array_sort("expected_citation_ids")).alias("expected"),
        joined(F.slice("retrieved_ids", 1, 5)).alias("top5"),
        *[F.round(m, 6).alias(m) for m in ("recall_at_5", "citation_accuracy")],
        "refused",
        "should_refuse",
    )
