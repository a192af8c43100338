"""Operational metrics of traces, requests and provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from .evaluation import nearest_rank, ratio

#: Upper ends of latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def in_window(metrics: DataFrame, alerts: DataFrame, hours: int) -> DataFrame:
    """Metrics of a window with its ``window_hours`` and ``evaluation_regression_count``, the alerts (message) of regressions in it."""
    found = alerts.agg(F.count_if(F.col("message").startswith("Regression detected.")).alias("evaluation_regression_count"))
    return metrics.withColumn("window_hours", F.lit(hours)).crossJoin(F.broadcast(found))  # one row


def rag_metrics(traces: DataFrame, *by: str) -> DataFrame:
    """The operational metrics of traces in one aggregation and one of percentiles.

    Traces have query_type, refusal, answer, latency_ms, cost and, as variant, tokens, prompt, evidence, rerank and citations (null for none).
    JSON fields count only with the type they should have.
    """
    c = F.col
    typed = traces.select(
        "*",
        J.trace_tokens(c("tokens")).alias("_tokens"),
        J.strict_bool(c("evidence"), "$.sufficient").alias("_sufficient"),
        F.when(J.strict_bool(c("evidence"), "$.sufficient").isNotNull(), J.strict_number(c("evidence"), "$.latency_ms")).alias("_gate_ms"),
        J.strict_string(c("rerank"), "$.provider").isNotNull().alias("_reranked"),
        F.coalesce(J.strict_bool(c("rerank"), "$.applied"), F.lit(False)).alias("_applied"),
        (F.coalesce(J.strict_string(c("rerank"), "$.error_code"), F.lit("")) != "").alias("_rerank_error"),
        J.strict_number(c("rerank"), "$.latency_ms").alias("_rerank_ms"),
        (c("answer").isNotNull() & F.coalesce(J.is_object(c("prompt")) & (c("prompt").cast("string") != "{}"), F.lit(False)) & J.is_object(c("tokens"))).alias("_complete"),
        F.coalesce((J.kind(c("citations")).startswith("ARRAY")) & (c("citations").cast("string") != "[]"), F.lit(False)).alias("_cited"),
    )
    n, assessed, reranked = F.count("*"), F.count("_sufficient"), F.count_if(c("_reranked"))
    answered = (c("query_type") != "sql") & ~c("refusal")
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    counts = {
        "query_count": n,
        "refusal_count": F.count_if(c("refusal")),
        "total_tokens": F.coalesce(F.sum("_tokens"), F.lit(0)),
        "measured_token_trace_count": F.count("_tokens"),
        "evidence_assessed_count": assessed,
        "evidence_sufficient_count": F.count_if(c("_sufficient")),
        "evidence_insufficient_count": F.count_if(~c("_sufficient")),
        "grounding_failure_count": F.count_if(c("refusal") & c("_sufficient")),
        "citation_answer_count": F.count_if(answered & c("_cited")),
        "refusal_citation_violation_count": F.count_if(c("refusal") & c("_cited")),
        "rerank_assessed_count": reranked,
        "rerank_applied_count": F.count_if(c("_reranked") & c("_applied")),
        "rerank_failure_count": F.count_if(c("_reranked") & c("_rerank_error")),
    }
    numbers = {
        "refusal_rate": ratio(F.count_if(c("refusal")), n),
        "average_latency_ms": mean("latency_ms"),
        "total_cost": F.coalesce(F.sum("cost"), F.lit(0.0)),
        "average_cost": mean("cost"),
        "trace_completeness_rate": ratio(F.count_if(c("_complete")), n),
        "evidence_sufficiency_rate": ratio(F.count_if(c("_sufficient")), assessed),
        "average_evidence_gate_latency_ms": mean("_gate_ms"),
        "citation_rate": ratio(F.count_if(answered & c("_cited")), F.count_if(answered)),
        "rerank_failure_rate": ratio(F.count_if(c("_reranked") & c("_rerank_error")), reranked),
        "average_rerank_latency_ms": mean(F.when(c("_reranked"), c("_rerank_ms"))),
    }
    summed = typed.groupBy(*by).agg(*[v.cast("long").alias(k) for k, v in counts.items()], *[F.round(v, 6).alias(k) for k, v in numbers.items()])
    ranks = nearest_rank(traces, list(by), "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return summed.join(ranks, list(by)) if by else summed.crossJoin(ranks)  # one row each


def error_category(name: Column, reason: Column) -> Column:
    """A provider failure as one of few categories, from the error's name and reason."""
    said = F.lower(F.concat_ws(" ", name, F.coalesce(reason, F.lit(""))))
    code = F.regexp_extract(said, "http(?:_status| status)[_: -]?([45])[0-9]{2}", 1)
    return (
        F.when(name.isNull(), "none")
        .when(name.isin("CancelledError", "KeyboardInterrupt"), "cancelled")
        .when(said.rlike("api key|credential"), "missing_credentials")
        .when(F.contains(said, F.lit("timeout")), "timeout")
        .when(said.rlike("transport|connection"), "transport")
        .when(code != "", F.concat(F.lit("http_"), code, F.lit("xx")))
        .when(said.rlike("invalid|response|json") | name.isin("ValueError", "TypeError", "KeyError", "IndexError"), "invalid_response")
        .when(F.coalesce(reason, F.lit("")) != "", "provider_error")
        .otherwise("unexpected")
    )


def http_error(status: Column) -> Column:
    """struct(code, retryable) of a provider's HTTP status; null for success."""
    code = F.when(status.isin(401, 403), "AUTH_FAILED").when(status == 408, "TIMEOUT").when(status == 429, "RATE_LIMITED").when(status >= 500, "UPSTREAM_ERROR").otherwise("REQUEST_REJECTED")
    return F.when(~status.between(200, 299), F.struct(code.alias("code"), (status.isin(408, 429) | (status >= 500)).alias("retryable")))


def provider_label(endpoint: Column) -> Column:
    """A short name for a provider's address."""
    low = F.lower(endpoint)
    known = {"dashscope.aliyuncs.com": "bailian", "cohere.com": "cohere", "deepseek.com": "deepseek", "qdrant": "qdrant"}
    label = F.substring(F.regexp_replace(low, "[^a-z0-9_]+", "_"), 1, 64)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in known.items()], F.nullif(label, F.lit("")), F.lit("unknown"))


def capped_labels(rows: DataFrame, label: str, at: str, limit: int = 256) -> DataFrame:
    """``rows`` with ``label`` kept for the first ``limit`` labels seen, in order of ``at``; others become ``<other>``."""
    first = rows.groupBy(label).agg(F.min(at).alias("_first"))
    kept = first.orderBy("_first", label).limit(limit).select(F.col(label).alias("_kept"))
    return rows.join(F.broadcast(kept), F.col(label) == F.col("_kept"), "left").withColumn(label, F.coalesce("_kept", F.lit("<other>"))).drop("_kept")  # at most ``limit`` rows


def histogram(rows: DataFrame, by: list[str], value: str, edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, le, n): cumulative counts for each edge and infinity."""
    wide = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= e).alias(f"le_{k}") for k, e in enumerate(edges)], F.count("*").alias("every"))
    steps = [F.struct(F.lit(float(e)).alias("le"), F.col(f"le_{k}").alias("n")) for k, e in enumerate(edges)]
    return wide.select(*by, F.explode(F.array(*steps, F.struct(F.lit(float("inf")).alias("le"), F.col("every").alias("n")))).alias("b")).select(*by, "b.*")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, value): the quantile told by cumulative buckets, linear within a bucket; in the last one its lower end, null for no observation."""
    order = Window.partitionBy(*by).orderBy("le")
    steps = buckets.withColumn("total", F.max("n").over(Window.partitionBy(*by))).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    hit = steps.where((F.col("total") > 0) & (F.col("n") >= q * F.col("total")) & ((F.col("below") < q * F.col("total")) | (F.col("below") == 0)))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "low", "n", "below", "total"), "le").alias("b")).select(*by, "b.*")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / F.nullif(F.col("n") - F.col("below"), F.lit(0))
    return first.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value"))


def last_samples(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """The last ``limit`` rows of each group: a bounded reservoir of recent samples."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= limit)


def exposition(metrics: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """(line): one sample line of the text exposition format for every number of every row."""
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{b}="'), F.replace(F.replace(F.col(b).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for b in by])
    names = [c for c in metrics.columns if c not in by]
    rows = metrics.select(labels.alias("labels"), F.explode(F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias("m"))
    return rows.where("m.value is not null").select(F.format_string("%s{%s} %.6f", "m.name", "labels", "m.value").alias("line"))


def roll_up(health: DataFrame, service: str) -> DataFrame:
    """(service, status, unavailable): healthy if all dependencies are healthy or disabled, else degraded."""
    fine = F.col("status").isin("healthy", "disabled")
    return health.groupBy(service).agg(F.when(F.bool_and(fine), "healthy").otherwise("degraded").alias("status"), F.count_if(~fine).alias("unavailable"))
