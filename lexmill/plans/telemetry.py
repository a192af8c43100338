"""Registered queries: metrics of traces, requests and providers, strict JSON, windows of time.

Events are traces and requests. Their JSON fields are made from their columns, some with wrong types on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..operators import evaluation, feeds, telemetry
from ..registry import query
from ..sources import tables

TRACES = """traces AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'rag' ELSE 'sql+rag' END AS query_type, event_type = 'error' AS refusal, CASE WHEN event_type <> 'view' THEN 'said' END AS answer, round(value / 1000, 8) AS cost,
 CASE event_id % 6 WHEN 0 THEN '{"total_tokens": ' || event_id % 900 || '}' WHEN 1 THEN '{"tokens": true, "prompt_tokens": 5}' WHEN 2 THEN '{"prompt_tokens": ' || event_id % 50 || ', "completion_tokens": 7}' WHEN 3 THEN '{}' WHEN 4 THEN '{"token_count": -4}' END AS tokens,
 CASE event_id % 4 WHEN 0 THEN '{"text": "x"}' WHEN 1 THEN '{}' WHEN 2 THEN '[1]' END AS prompt,
 CASE event_id % 5 WHEN 0 THEN '{"sufficient": true, "latency_ms": ' || event_id % 40 || '}' WHEN 1 THEN '{"sufficient": false, "latency_ms": 2.5}' WHEN 2 THEN '{"sufficient": "true", "latency_ms": 9}' WHEN 3 THEN '{"sufficient": true, "latency_ms": true}' END AS evidence,
 CASE event_id % 7 WHEN 0 THEN '{"provider": "a", "applied": true, "latency_ms": ' || event_id % 90 || '}' WHEN 1 THEN '{"provider": "a", "applied": false, "error_code": "x"}' WHEN 2 THEN '{"provider": 5, "applied": true}' WHEN 3 THEN '{"provider": "b", "applied": 1, "error_code": "", "latency_ms": -3}' END AS rerank,
 CASE event_id % 8 WHEN 0 THEN '[]' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN NULL ELSE '[{"chunk_id": "c' || event_id % 9 || '"}, {"chunk_id": ""}, {"chunk_id": "d"}, {"other": 1}, {"chunk_id": "d"}]' END AS citations FROM events)"""


def traces(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    said = lambda m, cases: F.coalesce(*[F.when(k % m == i, v if not isinstance(v, str) else F.lit(v)) for i, v in cases.items()])
    put = lambda form, n: F.format_string(form, k % n)
    citations = F.when(k % 8 == 0, "[]").when(k % 8 == 1, '{"a": 1}').when(k % 8 != 2, put('[{"chunk_id": "c%d"}, {"chunk_id": ""}, {"chunk_id": "d"}, {"other": 1}, {"chunk_id": "d"}]', 9))
    return e.select(
        "*",
        F.when(k % 3 == 0, "sql").when(k % 3 == 1, "rag").otherwise("sql+rag").alias("query_type"),
        (F.col("event_type") == "error").alias("refusal"),
        F.when(F.col("event_type") != "view", "said").alias("answer"),
        F.round(F.col("value") / 1000, 8).alias("cost"),
        F.col("value").alias("latency_ms"),
        said(6, {0: put('{"total_tokens": %d}', 900), 1: '{"tokens": true, "prompt_tokens": 5}', 2: put('{"prompt_tokens": %d, "completion_tokens": 7}', 50), 3: "{}", 4: '{"token_count": -4}'}).alias("tokens_text"),
        said(4, {0: '{"text": "x"}', 1: "{}", 2: "[1]"}).alias("prompt_text"),
        said(5, {0: put('{"sufficient": true, "latency_ms": %d}', 40), 1: '{"sufficient": false, "latency_ms": 2.5}', 2: '{"sufficient": "true", "latency_ms": 9}', 3: '{"sufficient": true, "latency_ms": true}'}).alias("evidence_text"),
        said(7, {0: put('{"provider": "a", "applied": true, "latency_ms": %d}', 90), 1: '{"provider": "a", "applied": false, "error_code": "x"}', 2: '{"provider": 5, "applied": true}', 3: '{"provider": "b", "applied": 1, "error_code": "", "latency_ms": -3}'}).alias("rerank_text"),
        citations.alias("citations_text"),
    )


def _parsed(t: DataFrame) -> DataFrame:
    return t.select("*", *[J.parsed(F.col(f"{c}_text")).alias(c) for c in ("tokens", "prompt", "evidence", "rerank", "citations")])


def _int(doc: str, key: str) -> str:
    return f"CASE WHEN json_type({doc}, '$.{key}') IN ('UBIGINT', 'BIGINT') THEN json_extract_string({doc}, '$.{key}')::BIGINT END"


_tokens = f"""CASE WHEN coalesce({_int('tokens', 'total_tokens')}, {_int('tokens', 'tokens')}, {_int('tokens', 'token_count')}) IS NOT NULL THEN greatest(0, coalesce({_int('tokens', 'total_tokens')}, {_int('tokens', 'tokens')}, {_int('tokens', 'token_count')}))
 WHEN coalesce({_int('tokens', 'prompt_tokens')}, {_int('tokens', 'completion_tokens')}) IS NOT NULL THEN coalesce({_int('tokens', 'prompt_tokens')}, 0) + coalesce({_int('tokens', 'completion_tokens')}, 0) END"""
TYPED = f"""typed AS (SELECT *, {_tokens} AS n_tokens, CASE WHEN json_type(evidence, '$.sufficient') = 'BOOLEAN' THEN json_extract_string(evidence, '$.sufficient') = 'true' END AS sufficient,
 CASE WHEN json_type(evidence, '$.sufficient') = 'BOOLEAN' AND json_type(evidence, '$.latency_ms') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(evidence, '$.latency_ms')::DOUBLE END AS gate_ms,
 coalesce(json_type(rerank, '$.provider') = 'VARCHAR', false) AS reranked, coalesce(json_type(rerank, '$.applied') = 'BOOLEAN' AND json_extract_string(rerank, '$.applied') = 'true', false) AS applied, coalesce(json_extract_string(rerank, '$.error_code'), '') <> '' AS rerank_error,
 CASE WHEN json_type(rerank, '$.latency_ms') IN ('UBIGINT', 'BIGINT') AND json_extract_string(rerank, '$.latency_ms')::DOUBLE >= 0 THEN json_extract_string(rerank, '$.latency_ms')::DOUBLE END AS rerank_ms,
 answer IS NOT NULL AND coalesce(prompt = '{{"text": "x"}}', false) AND coalesce(json_type(tokens) = 'OBJECT', false) AS complete, coalesce(json_type(citations) = 'ARRAY' AND citations <> '[]', false) AS cited FROM traces)"""


def _r(n: str, d: str) -> str:
    return f"round(coalesce({n} / nullif({d}, 0)::DOUBLE, 0), 6)"


_ok = "query_type <> 'sql' AND NOT refusal"
RAG = {
    "query_count": "count(*)",
    "refusal_count": "count(*) FILTER (refusal)",
    "refusal_rate": _r("count(*) FILTER (refusal)", "count(*)"),
    "average_latency_ms": "round(avg(value), 6)",
    "p50_latency_ms": "quantile_disc(value, 0.5)",
    "p95_latency_ms": "quantile_disc(value, 0.95)",
    "total_tokens": "coalesce(sum(n_tokens), 0)::BIGINT",
    "measured_token_trace_count": "count(n_tokens)",
    "total_cost": "round(sum(cost), 6)",
    "average_cost": "round(avg(cost), 6)",
    "trace_completeness_rate": _r("count(*) FILTER (complete)", "count(*)"),
    "evidence_assessed_count": "count(sufficient)",
    "evidence_sufficient_count": "count(*) FILTER (sufficient)",
    "evidence_insufficient_count": "count(*) FILTER (NOT sufficient)",
    "evidence_sufficiency_rate": _r("count(*) FILTER (sufficient)", "count(sufficient)"),
    "average_evidence_gate_latency_ms": "round(coalesce(avg(gate_ms), 0), 6)",
    "grounding_failure_count": "count(*) FILTER (refusal AND sufficient)",
    "citation_answer_count": f"count(*) FILTER ({_ok} AND cited)",
    "citation_rate": _r(f"count(*) FILTER ({_ok} AND cited)", f"count(*) FILTER ({_ok})"),
    "refusal_citation_violation_count": "count(*) FILTER (refusal AND cited)",
    "rerank_assessed_count": "count(*) FILTER (reranked)",
    "rerank_applied_count": "count(*) FILTER (reranked AND applied)",
    "rerank_failure_count": "count(*) FILTER (reranked AND rerank_error)",
    "rerank_failure_rate": _r("count(*) FILTER (reranked AND rerank_error)", "count(*) FILTER (reranked)"),
    "average_rerank_latency_ms": "round(coalesce(avg(rerank_ms) FILTER (reranked), 0), 6)",
}


@query("rag_metrics", f"WITH {TRACES}, {TYPED} SELECT {', '.join(f'{v} AS {k}' for k, v in RAG.items())}, 624 AS window_hours, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND event_type = 'error' AND value > 30) AS evaluation_regression_count FROM typed WHERE ts >= TIMESTAMP '2024-01-05'")
def rag_metrics(spark, sf):
    """The operational metrics of all traces since a time."""
    since = F.col("ts") >= F.lit("2024-01-05").cast("timestamp")
    alerts = tables.read(spark, sf, "events").where(since & (F.col("event_type") == "error")).select(F.when(F.col("value") > 30, "Regression detected. latency").otherwise("error").alias("message"))
    return telemetry.in_window(telemetry.rag_metrics(_parsed(traces(spark, sf).where(since))), alerts, 624)


@query("rag_metrics_by_type", f"WITH {TRACES}, {TYPED} SELECT event_type, {', '.join(f'{v} AS {k}' for k, v in RAG.items())} FROM typed GROUP BY 1")
def rag_metrics_by_type(spark, sf):
    return telemetry.rag_metrics(_parsed(traces(spark, sf)), "event_type")


@query("trace_usage", f"WITH {TRACES}, {TYPED} SELECT event_id, n_tokens, sufficient, gate_ms FROM typed")
def trace_usage(spark, sf):
    t = _parsed(traces(spark, sf))
    ok = J.strict_bool(F.col("evidence"), "$.sufficient")
    return t.select("event_id", J.trace_tokens(F.col("tokens")).alias("n_tokens"), ok.alias("sufficient"), F.when(ok.isNotNull(), J.strict_number(F.col("evidence"), "$.latency_ms")).alias("gate_ms"))


@query("cited_ids", f"WITH {TRACES} SELECT event_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS ids FROM (SELECT event_id, CASE WHEN json_type(citations) = 'ARRAY' THEN list_filter(list_transform(from_json(citations, '[\"JSON\"]'), lambda x: json_extract_string(x, '$.chunk_id')), lambda x: x IS NOT NULL AND x <> '') END AS ids FROM traces) WHERE ids IS NOT NULL")
def cited_ids(spark, sf):
    """Distinct ids of an array of objects, in order."""
    t = traces(spark, sf).where(F.col("citations_text").startswith("["))
    return t.select("event_id", F.array_join(J.ids(F.col("citations_text"), "chunk_id"), ",").alias("ids"))


@query(
    "provider_usage",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 WHEN 2 THEN o_orderkey % 100 END AS prompt_tokens, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 END AS completion_tokens, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 + o_orderkey % 7 WHEN 1 THEN o_orderkey % 11 END AS total_tokens,
 CASE o_orderkey % 4 WHEN 0 THEN round_even(o_totalprice::DECIMAL(15,2), 2)::DECIMAL(18,8) WHEN 2 THEN 0.25::DECIMAL(18,8) END AS cost FROM orders""",
)
def provider_usage(spark, sf):
    """Usage and cost out of providers' answers, which name and nest them differently."""
    k, o = F.col("o_orderkey"), tables.read(spark, sf, "orders")
    text = (
        F.when(k % 4 == 0, F.format_string('{"usage": {"input_tokens": %d, "output": %d, "cost": -1}, "data": {"total_cost": "%s"}}', k % 100, k % 7, F.col("o_totalprice").cast("decimal(15,2)").cast("string")))
        .when(k % 4 == 1, F.format_string('{"usage": 3, "data": {"token_usage": {"tokens": %d, "prompt_tokens": true}}, "cost": true}', k % 11))
        .when(k % 4 == 2, F.format_string('{"token_usage": {"prompt_tokens": %d, "completion_tokens": -2, "total_cost": 0.25}}', k % 100))
        .otherwise("no json")
    )
    v = o.select("o_orderkey", J.parsed(text).alias("v"))
    return v.select("o_orderkey", J.normal_usage(F.col("v")).alias("u"), J.cost(F.col("v")).alias("cost")).select("o_orderkey", "u.*", "cost")


@query("numeric_counters", "SELECT event_id, 'k' AS name, (props->>'$.k')::DOUBLE AS value FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') UNION ALL SELECT event_id, 'units', event_id % 5 FROM events")
def numeric_counters(spark, sf):
    """Entries of an object that are numbers; all else is dropped."""
    e = tables.read(spark, sf, "events")
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.format_string(', "units": %d, "flag": true, "name": "5"}', F.col("event_id") % 5))
    return e.select("event_id", F.explode(J.counters(text)).alias("name", "value"))


@query("request_report", "SELECT event_type AS path, count(*) AS requests, round(avg((value > 50)::INT::DOUBLE), 6) AS error_rate, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(count(*) / 2592000.0::DOUBLE, 6) AS rps, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.75), 6) AS p75, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, quantile_disc(value, 0.95) < 75 AS goal_met FROM events GROUP BY 1")
def request_report(spark, sf):
    """Latencies by path with rate and goal."""
    t = tables.traces(spark, sf).withColumn("path", F.col("event_type"))
    return evaluation.latency_report(t, "path", error=F.col("value") > 50, seconds=F.lit(2592000.0), goal=75.0)


@query("stage_latencies", "SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_disc(ms, 0.5), 6) AS p50, round(quantile_disc(ms, 0.95), 6) AS p95 FROM (SELECT unnest(['embed', 'retrieve', 'rerank']) AS stage, unnest([value, value * 2, CASE WHEN event_id % 2 = 0 THEN value / 2 END]) AS ms FROM events) WHERE ms IS NOT NULL GROUP BY 1")
def stage_latencies(spark, sf):
    """Timings kept as a map of stages, exploded and reported by stage."""
    t = tables.traces(spark, sf)
    timed = t.select(F.explode(F.create_map(F.lit("embed"), F.col("value"), F.lit("retrieve"), F.col("value") * 2, F.lit("rerank"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 2))).alias("stage", "ms")).where("ms is not null")
    ranks = evaluation.nearest_rank(timed, ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    summed = timed.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean"))
    return summed.join(ranks, "stage").select("stage", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_status = "CASE event_id % 9 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 403 WHEN 4 THEN 408 ELSE 200 END"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 9 == 0, 500).when(k % 9 == 1, 429).when(k % 9 == 2, 404).when(k % 9 == 3, 403).when(k % 9 == 4, 408).otherwise(200)
    return tables.traces(spark, sf).select("event_id", "event_type", "user_id", "ts", "value", status.alias("status"))


@query("route_snapshot", f"SELECT event_type AS path, status, count(*) AS n, (status // 100)::VARCHAR || 'xx' AS class FROM (SELECT *, {_status} AS status FROM events) GROUP BY 1, 2, 4")
def route_snapshot(spark, sf):
    return _requests(spark, sf).groupBy(F.col("event_type").alias("path"), "status").agg(F.count("*").alias("n")).withColumn("class", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))


@query("http_errors", f"SELECT status, CASE WHEN status IN (401, 403) THEN 'AUTH_FAILED' WHEN status = 408 THEN 'TIMEOUT' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status >= 500 THEN 'UPSTREAM_ERROR' ELSE 'REQUEST_REJECTED' END AS code, status IN (408, 429) OR status >= 500 AS retryable, count(*) AS n FROM (SELECT {_status} AS status FROM events) WHERE status <> 200 GROUP BY 1, 2, 3")
def http_errors(spark, sf):
    r = _requests(spark, sf).select("status", telemetry.http_error(F.col("status")).alias("e")).where("e is not null")
    return r.groupBy("status", "e.code", "e.retryable").agg(F.count("*").alias("n"))


_errors = "['ReadTimeout', 'ValueError', 'TransportError', 'ProviderError', 'CancelledError', 'Odd', 'ProviderError']"
_reasons = "['', '', 'x', 'http_status_503', '', '', 'missing api key']"


@query("error_categories", f"SELECT category, count(*) AS n FROM (SELECT CASE event_id % 8 WHEN 7 THEN 'none' ELSE ['timeout', 'invalid_response', 'transport', 'http_5xx', 'cancelled', 'unexpected', 'missing_credentials'][(event_id % 8 + 1)::INT] END AS category FROM events) GROUP BY 1")
def error_categories(spark, sf):
    k = (F.col("event_id") % 8).cast("int")
    pick = lambda text: F.get(F.from_json(F.lit(text.replace("'", '"')), "array<string>"), k)
    return tables.read(spark, sf, "events").groupBy(telemetry.error_category(pick(_errors), pick(_reasons)).alias("category")).agg(F.count("*").alias("n"))


@query("provider_labels", "SELECT label, count(*) AS n FROM (SELECT ['bailian', 'cohere', 'deepseek', 'qdrant', 'http_other_host_5', 'unknown'][(event_id % 6 + 1)::INT] AS label FROM events) GROUP BY 1")
def provider_labels(spark, sf):
    hosts = F.from_json(F.lit('["https://DashScope.aliyuncs.com/v1", "https://api.cohere.com", "https://api.deepseek.com", "http://qdrant:6333", "http://other.host:5", ""]'), "array<string>")
    return tables.read(spark, sf, "events").groupBy(telemetry.provider_label(F.get(hosts, (F.col("event_id") % 6).cast("int"))).alias("label")).agg(F.count("*").alias("n"))


@query("capped_routes", "WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1), k AS (SELECT user_id FROM f ORDER BY first, user_id LIMIT 20) SELECT CASE WHEN k.user_id IS NULL THEN '<other>' ELSE '/u/' || e.user_id END AS route, count(*) AS n FROM events e LEFT JOIN k USING (user_id) GROUP BY 1")
def capped_routes(spark, sf):
    """The first labels seen keep their names, so that their number is bounded."""
    t = tables.traces(spark, sf).select("ts", F.col("user_id").alias("uid"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("route"))
    first = t.withColumn("seen", F.struct("ts", "uid"))
    return telemetry.capped_labels(first, "route", "seen", 20).groupBy("route").agg(F.count("*").alias("n"))


@query("latency_quantile", "WITH e AS (SELECT unnest([0.005::DOUBLE, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]) AS le), b AS (SELECT event_type, le, count(*) FILTER (value / 10 <= le) AS n FROM events, e GROUP BY 1, 2), s AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)), h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS nth FROM s WHERE n >= 0.95 * total) SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95 * total - below) / nullif(n - below, 0) END, 6) AS value FROM h WHERE nth = 1")
def latency_quantile(spark, sf):
    """The 95 % quantile that cumulative buckets tell."""
    t = tables.traces(spark, sf).withColumn("seconds", F.col("value") / 10)
    buckets = telemetry.histogram(t, ["event_type"], "seconds")
    return telemetry.histogram_quantile(buckets, ["event_type"], 0.95).select("event_type", F.round("value", 6).alias("value"))


@query("recent_samples", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def recent_samples(spark, sf):
    return telemetry.last_samples(tables.traces(spark, sf), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id")


@query("recent_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '48 hours' GROUP BY 1")
def recent_window(spark, sf):
    """Events of the last 48 hours before the newest one."""
    e = tables.traces(spark, sf)
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("INTERVAL 48 HOURS")).groupBy("event_type").agg(F.count("*").alias("n"))  # newest is one row


@query("metric_exposition", "SELECT 'app_requests{path=\"' || event_type || '\"} ' || printf('%.6f', count(*)::DOUBLE) AS line FROM events GROUP BY event_type UNION ALL SELECT 'app_seconds{path=\"' || event_type || '\"} ' || printf('%.6f', round(sum(value), 3)) FROM events GROUP BY event_type")
def metric_exposition(spark, sf):
    m = tables.traces(spark, sf).groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 3).alias("seconds"))
    return telemetry.exposition(m, ["path"], "app")


@query("dependency_health", "SELECT user_id % 20 AS service, CASE WHEN bool_and(event_type <> 'error') THEN 'healthy' ELSE 'degraded' END AS status, count(*) FILTER (event_type = 'error') AS unavailable FROM events WHERE event_id % 50 < 3 GROUP BY 1")
def dependency_health(spark, sf):
    e = tables.read(spark, sf, "events").where("event_id % 50 < 3")
    health = e.select((F.col("user_id") % 20).alias("service"), F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "view", "disabled").otherwise("healthy").alias("status"))
    return telemetry.roll_up(health, "service")


@query("regression_alerts", "SELECT user_id, count(*) AS n FROM (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'Regression detected. recall' WHEN 1 THEN 'regression detected.' ELSE 'No regression' END AS note FROM events) WHERE note LIKE 'Regression detected.%' GROUP BY 1")
def regression_alerts(spark, sf):
    note = F.when(F.col("event_id") % 3 == 0, "Regression detected. recall").when(F.col("event_id") % 3 == 1, "regression detected.").otherwise("No regression")
    return tables.read(spark, sf, "events").where(note.startswith("Regression detected.")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("feed_items", "SELECT l_orderkey AS feed, l_linenumber AS nth, 'http://h/' || l_partkey AS url, 'T' || l_suppkey AS title FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) WHERE place <= 4 AND l_partkey % 5 > 0")
def feed_items(spark, sf):
    """Items of JSON feeds: the first four entries of an array, those with an address."""
    line = tables.read(spark, sf, "lineitem")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("http://h/"), F.col("l_partkey").cast("string"))).alias("URL"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("TITLE"))
    feeds = line.groupBy(F.col("l_orderkey").alias("feed")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("body"))
    rows = feeds.select("feed", F.posexplode(F.from_json("body", "array<struct<l_linenumber:int,URL:string,TITLE:string>>")).alias("at", "x")).where("at < 4 and x.URL is not null")
    return rows.select("feed", F.col("x.l_linenumber").alias("nth"), F.col("x.URL").alias("url"), F.col("x.TITLE").alias("title"))


@query("api_items", "SELECT o_orderkey AS page, o_custkey AS item, 'http://h/c/' || o_custkey AS url, CASE o_orderkey % 2 WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS title FROM orders WHERE o_orderkey % 4 < 3")
def api_items(spark, sf):
    """Items of API answers: the list is at a dotted path or under a usual name, fields go by several names, addresses may come from a template."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.format_string('{"body": {"hits": [{"url": "http://h/c/%d", "id": %d, "title": " %s "}]}}', "o_custkey", "o_custkey", "o_orderpriority"))
        .when(k % 4 == 1, F.format_string('{"data": {"items": [1, {"id": "%d", "name": "%s"}]}}', "o_custkey", "o_orderstatus"))
        .when(k % 4 == 2, F.format_string('[{"link": "http://h/c/%d", "id": "%d", "subject": "%s"}]', "o_custkey", "o_custkey", "o_orderpriority"))
        .otherwise('{"body": {"hits": 3}}')
    )
    rows = feeds.items(tables.read(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", "body.hits").withColumnRenamed("item", "x")
    ident = F.coalesce(F.try_variant_get("x", "$.id", "string"), F.lit(""))
    url = F.coalesce(J.first_string(F.col("x"), ("url", "link", "href")), F.concat(F.lit("http://h/c/"), ident))
    return rows.select(F.col("o_orderkey").alias("page"), ident.cast("long").alias("item"), url.alias("url"), J.first_string(F.col("x"), ("title", "name", "subject")).alias("title"))


@query("nested_items", "SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, l_partkey AS item FROM lineitem")
def nested_items(spark, sf):
    """Items of answers that hold their list at an unknown depth, after lists of other things and before another list of objects."""
    line = tables.read(spark, sf, "lineitem")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    pages = line.groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("list"), F.count("*").cast("int").alias("n"))
    # As deep as the order has lines.
    wrapped = F.aggregate(F.sequence(F.lit(1), "n"), F.concat(F.lit("[7, "), "list", F.lit("]")), lambda t, i: F.when(i % 2 == 1, F.concat(F.lit('{"z": [], "m": "[{}]", "b": [1, [2]], "a": '), t, F.lit("}"))).otherwise(F.concat(F.lit('{"p": [null, []], "q": '), t, F.lit(', "c": [{"l_partkey": -2}]}'))))
    text = F.concat(F.lit('{"total": 3, "result": '), wrapped, F.lit(', "after": [{"l_partkey": -1}]}'))
    found = feeds.items(pages.select("page", text.alias("text")), "page", "text", "data.items")
    return found.select("page", (F.col("nth") + 1).cast("long").alias("nth"), F.try_variant_get("item", "$.l_partkey", "bigint").alias("item"))
