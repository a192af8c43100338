"""Registered queries: filters, joins, lineage, aggregates, windows, monitoring and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation
from ..registry import query
from ..sources import tables
from ..streaming import monitoring


@query("filtered_documents", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 AND (text ILIKE '%license%' OR source ILIKE '%src1%') ORDER BY n_chars DESC, doc_id DESC LIMIT 100")
def filtered_documents(spark, sf):
    d = tables.read(spark, sf, "documents").where("lang = 'en' and n_chars >= 500")
    return d.where(F.col("text").ilike("%license%") | F.col("source").ilike("%src1%")).orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(100).select("doc_id", "source", "n_chars")


@query("literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), 'token = \"')")
def literal_search(spark, sf):
    low = F.lower("text")
    return tables.read(spark, sf, "documents").where(F.contains(low, F.lit("100%")) | F.contains(low, F.lit('token = "'))).select("doc_id")


@query("payload_range", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE::VARCHAR >= '1996-01-01' AND o_orderdate::DATE::VARCHAR <= '1996-06-30' AND o_orderstatus IN ('F', 'O')")
def payload_range(spark, sf):
    o = tables.read(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("day"))


@query("eligible_documents", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'approved' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR (quality = 1 AND toxic = 0) OR (toxic = 1 AND n_chars < 300)")
def eligible_documents(spark, sf):
    d, labels = tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels").withColumn("labelled", F.lit(True))
    j = d.join(labels, "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    kept = j.where(F.col("labelled").isNull() | good | ((F.col("toxic") == 1) & (F.col("n_chars") < 300)))
    return kept.select("doc_id", F.when(F.col("labelled").isNull(), "pending").when(good, "approved").otherwise("rejected").alias("status"))


@query("unreviewed_documents", "SELECT source, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def unreviewed_documents(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", "source")
    return d.join(tables.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("documents"))


@query("reviewed_documents", "SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY 1")
def reviewed_documents(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.join(tables.read(spark, sf, "labels").where("toxic = 0").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))


@query(
    "lineage_chain",
    "SELECT r_name, n_name, count(DISTINCT c_custkey) AS sources, count(DISTINCT o_orderkey) AS documents, count(l_linenumber) AS chunks FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def lineage_chain(spark, sf):
    """source -> document -> chunk; the chunk table is reduced to counts per document before it is joined."""
    t = {n: tables.read(spark, sf, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    chunks = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("chunks"))
    docs = t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(chunks, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    named = t["region"].join(t["nation"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").alias("c_nationkey"))
    joined = t["customer"].select("c_custkey", "c_nationkey").join(docs, "c_custkey", "left").join(named, "c_nationkey")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("sources"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


@query("adjacent_chunks", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS neighbours FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1 GROUP BY 1, 2")
def adjacent_chunks(spark, sf):
    n = tables.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    # The neighbour's number is part of the key, so a document's chunks are not paired with each other first.
    steps = n.select("l_orderkey", "l_linenumber", "n", F.explode(F.array(F.col("l_linenumber") - 1, F.col("l_linenumber") + 1)).alias("beside"))
    beside = n.select("l_orderkey", F.col("l_linenumber").alias("beside"), F.col("n").alias("m"))
    return steps.join(beside, ["l_orderkey", "beside"]).groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("n") * F.col("m")).alias("neighbours"))


@query("latest_traces", "SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_traces(spark, sf):
    e = tables.read(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n, coalesce(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END), 0)::BIGINT AS large, round(avg(o_totalprice), 6) AS mean, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def status_counts(spark, sf):
    o = tables.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return o.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("latency_report", "SELECT event_type, count(*) AS requests, round(avg((value > 50)::INT::DOUBLE), 6) AS error_rate, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.75), 6) AS p75, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_report(spark, sf):
    return evaluation.latency_report(tables.traces(spark, sf), "event_type", error=F.col("value") > 50)


@query("interpolated_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def interpolated_percentiles(spark, sf):
    return tables.traces(spark, sf).groupBy("event_type").agg(*[F.round(F.percentile("value", q / 100), 6).alias(f"p{q}") for q in (50, 95)])


@query("id_digest", "SELECT source, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest, count(*) AS n FROM documents GROUP BY 1")
def id_digest(spark, sf):
    """The digest of a group's ids in order is one hash over all of them, so a group's ids, 8 bytes each, must fit one task: an integrity check of stores of millions of ids, not a plan for hot groups."""
    d = tables.read(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("k"))
    return d.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("digest"), F.count("*").alias("n"))


@query("refusal_confusion", "SELECT lang, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS refusal_precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS refusal_recall, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS refusal_accuracy FROM (SELECT lang, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def refusal_confusion(spark, sf):
    j = tables.read(spark, sf, "documents").select("doc_id", "lang").join(tables.read(spark, sf, "labels"), "doc_id")
    return evaluation.confusion(j.select("lang", (F.col("toxic") == 1).alias("should_refuse"), (F.col("quality") == 0).alias("refused")), "lang")


_CASES = "(SELECT event_id, event_type = 'error' AND value > 80 AS evaluation_failed, event_type = 'signup' AS should_refuse, value < 5 AS refused, value > 10 AS in_retrieved, value > 15 AS in_reranked, value > 20 AS in_context, event_id % 3 > 0 AS cited FROM events)"


@query(
    "failure_causes",
    f"""SELECT root_cause, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN evaluation_failed THEN 'EVALUATION_ERROR' WHEN should_refuse AND refused THEN 'CORRECT_REFUSAL' WHEN should_refuse THEN 'OTHER' WHEN NOT in_retrieved THEN 'RETRIEVAL_MISS' WHEN NOT in_reranked THEN 'RERANK_DROPPED'
 WHEN NOT in_context THEN 'CONTEXT_PACKING' WHEN refused THEN 'EVIDENCE_GATE_FALSE_NEGATIVE' WHEN NOT cited THEN 'CITATION_EXPECTATION_MISMATCH' ELSE 'NO_FAILURE' END AS root_cause FROM {_CASES}) GROUP BY 1""",
)
def failure_causes(spark, sf):
    v = F.col("value")
    cases = tables.traces(spark, sf).select("event_id", ((F.col("event_type") == "error") & (v > 80)).alias("evaluation_failed"), (F.col("event_type") == "signup").alias("should_refuse"), (v < 5).alias("refused"), (v > 10).alias("in_retrieved"), (v > 15).alias("in_reranked"), (v > 20).alias("in_context"), (F.col("event_id") % 3 > 0).alias("cited"))
    c = F.col
    cause = F.when(c("evaluation_failed"), "EVALUATION_ERROR").when(c("should_refuse"), F.when(c("refused"), "CORRECT_REFUSAL").otherwise("OTHER")).when(~c("in_retrieved"), "RETRIEVAL_MISS").when(~c("in_reranked"), "RERANK_DROPPED").when(~c("in_context"), "CONTEXT_PACKING")
    cause = cause.when(c("refused"), "EVIDENCE_GATE_FALSE_NEGATIVE").when(~c("cited"), "CITATION_EXPECTATION_MISMATCH").otherwise("NO_FAILURE")
    n = cases.groupBy(cause.alias("root_cause")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("retention_funnel", "SELECT 'retrieved' AS stage, count(*) FILTER (value > 10) AS kept FROM events UNION ALL SELECT 'reranked', count(*) FILTER (value > 15) FROM events UNION ALL SELECT 'context', count(*) FILTER (value > 20) FROM events")
def retention_funnel(spark, sf):
    n = tables.traces(spark, sf).agg(*[F.count_if(F.col("value") > least).alias(s) for s, least in (("retrieved", 10), ("reranked", 15), ("context", 20))])
    return n.unpivot([], ["retrieved", "reranked", "context"], "stage", "kept")


@query(
    "experiment_comparison",
    """WITH m AS (SELECT user_id % 2 AS side, avg(value) AS latency, avg((event_type = 'error')::INT::DOUBLE) AS error_rate, avg((event_type = 'purchase')::INT::DOUBLE) AS hit FROM events GROUP BY 1),
 u AS (SELECT side, unnest(['latency', 'error_rate', 'hit']) AS metric, round(unnest([latency, error_rate, hit]), 6) AS value FROM m)
 SELECT b.metric, b.value AS baseline, c.value AS candidate, round(c.value - b.value, 6) AS delta, CASE WHEN b.metric IN ('latency', 'error_rate') THEN c.value - b.value > 0 ELSE c.value - b.value < 0 END AS regressed FROM u b JOIN u c ON b.metric = c.metric AND b.side = 0 AND c.side = 1""",
)
def experiment_comparison(spark, sf):
    share = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)), 6)
    m = tables.traces(spark, sf).groupBy((F.col("user_id") % 2).alias("side")).agg(F.round(F.avg("value"), 6).alias("latency"), share("error").alias("error_rate"), share("purchase").alias("hit"))
    u = m.unpivot(["side"], ["latency", "error_rate", "hit"], "metric", "value")
    return evaluation.compare(u.where("side = 0"), u.where("side = 1"))


@query("histogram_buckets", "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1, 5, 10, 25, 50, 100, 250]) AS le) GROUP BY 1, 2")
def histogram_buckets(spark, sf):
    """Cumulative buckets, as sums over one pass."""
    edges = (1, 5, 10, 25, 50, 100, 250)
    n = tables.traces(spark, sf).groupBy("event_type").agg(*[F.count_if(F.col("value") <= e).alias(str(e)) for e in edges])
    return n.unpivot(["event_type"], [str(e) for e in edges], "le", "n").withColumn("le", F.col("le").cast("int"))


@query("tumbling_metrics", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_metrics(spark, sf):
    return monitoring.metric_buckets(tables.traces(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_alert_window", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL '6 hours', ts) - INTERVAL '18 hours', time_bucket(INTERVAL '6 hours', ts), INTERVAL '6 hours')) AS s FROM events WHERE event_type = 'error') GROUP BY 1, 2")
def sliding_alert_window(spark, sf):
    return monitoring.metric_buckets(tables.traces(spark, sf).where("event_type = 'error'"), "24 hours", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_traces", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_traces(spark, sf):
    e = tables.traces(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("rate_limited", "SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_limited(spark, sf):
    return monitoring.rate_limited(tables.traces(spark, sf), "user_id", 2).select("event_id", "allowed")


@query("sustained_errors", "SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS points FROM (SELECT *, sum((NOT over_limit)::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM (SELECT event_type, ts, event_id, value > 20 AS over_limit FROM events)) WHERE over_limit GROUP BY event_type, run HAVING count(*) >= 3")
def sustained_errors(spark, sf):
    e = tables.read(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") > 20).alias("over"))
    return monitoring.sustained(e, "event_type", "ts", "event_id", "over", 3)


@query("event_rates", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW) AS increase, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS delta FROM events")
def event_rates(spark, sf):
    r = monitoring.increases(tables.read(spark, sf, "events"), "event_type", "ts", "event_id", "value", 6)
    return r.select("event_id", "increase", F.round("delta", 6).alias("delta"))


@query("paired_questions", "SELECT item_id, coalesce(lead(item_id) OVER (ORDER BY item_id), min(item_id) OVER ()) AS next_id, ['fact', 'list', 'date', 'compare'][((row_number() OVER (ORDER BY item_id) - 1) % 4 + 1)::INT] AS category FROM benchmark")
def paired_questions(spark, sf):
    """Circular pairing and cyclic categories over the question set, which is small by nature."""
    w = Window.orderBy("item_id")
    b = tables.read(spark, sf, "benchmark")
    return b.select("item_id", F.coalesce(F.lead("item_id").over(w), F.min("item_id").over(Window.partitionBy())).alias("next_id"), F.element_at(F.array(*map(F.lit, ("fact", "list", "date", "compare"))), ((F.row_number().over(w) - 1) % 4 + 1).cast("int")).alias("category"))


@query("version_changes", "SELECT o_custkey, o_orderkey, row_number() OVER w AS version, concat_ws(',', CASE WHEN o_orderstatus <> lag(o_orderstatus) OVER w THEN 'status' END, CASE WHEN o_orderpriority <> lag(o_orderpriority) OVER w THEN 'priority' END) AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_changes(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = tables.read(spark, sf, "orders")
    diff = lambda c, name: F.when(F.col(c) != F.lag(c).over(w), name)
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("version"), F.concat_ws(",", diff("o_orderstatus", "status"), diff("o_orderpriority", "priority")).alias("changed"))


@query("policy_conflicts", "SELECT o_custkey AS policy, count(DISTINCT o_orderstatus) AS statuses, max(o_orderdate) AS newest, count(*) FILTER (o_orderdate < m) AS outdated FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def policy_conflicts(spark, sf):
    o = tables.read(spark, sf, "orders").withColumn("m", F.max("o_orderdate").over(Window.partitionBy("o_custkey")))
    return o.groupBy(F.col("o_custkey").alias("policy")).agg(F.countDistinct("o_orderstatus").alias("statuses"), F.max("o_orderdate").alias("newest"), F.count_if(F.col("o_orderdate") < F.col("m")).alias("outdated")).where("statuses > 1")


@query("usage_counters", "SELECT event_type, count(*) AS n, count(k) AS measured, coalesce(sum(k), 0)::BIGINT AS tokens, round(avg(k), 6) AS mean FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def usage_counters(spark, sf):
    return tables.traces(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count("tokens").alias("measured"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean"))


@query("illegal_transitions", "SELECT user_id, event_id, prev, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND (prev, event_type) NOT IN (('signup', 'view'), ('view', 'view'), ('view', 'click'), ('click', 'view'), ('click', 'purchase'), ('purchase', 'view'), ('error', 'view'), ('view', 'error'))")
def illegal_transitions(spark, sf):
    allowed = spark.createDataFrame([("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("purchase", "view"), ("error", "view"), ("view", "error")], "prev string, event_type string")
    e = tables.traces(spark, sf).withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("prev is not null")
    return e.join(F.broadcast(allowed), ["prev", "event_type"], "left_anti").select("user_id", "event_id", "prev", "event_type")


_alert = "CASE WHEN event_type IN ('error', 'view') THEN 'monitor:' ELSE '' END || event_type || ':' || user_id"


def _alerts(spark, sf):
    prefix = F.when(F.col("event_type").isin("error", "view"), "monitor:").otherwise("")
    return tables.read(spark, sf, "events").withColumn("alert_key", F.concat(prefix, F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")))


@query("merged_alerts", f"WITH a AS (SELECT {_alert} AS alert_key, count(*) AS c, CASE WHEN count(*) > 5 THEN 'acknowledged' WHEN count(*) % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM events WHERE event_id % 2 = 0 GROUP BY 1), s AS (SELECT DISTINCT {_alert} AS alert_key FROM events WHERE event_id % 2 = 1 AND value > 10) SELECT coalesce(a.alert_key, s.alert_key) AS alert_key, CASE WHEN a.alert_key IS NULL OR (s.alert_key IS NOT NULL AND status = 'resolved') THEN 'open' WHEN s.alert_key IS NULL AND starts_with(a.alert_key, 'monitor:') THEN 'resolved' ELSE status END AS status, (coalesce(a.c, 0) + (s.alert_key IS NOT NULL)::INT)::BIGINT AS occurrence_count FROM a FULL JOIN s ON a.alert_key = s.alert_key")
def merged_alerts(spark, sf):
    e, n = _alerts(spark, sf), F.col("occurrence_count")
    a = e.where("event_id % 2 = 0").groupBy("alert_key").agg(F.count("*").alias("occurrence_count")).withColumn("status", F.when(n > 5, "acknowledged").when(n % 2 == 0, "resolved").otherwise("open"))
    return monitoring.merge_alerts(a, e.where("event_id % 2 = 1 and value > 10").select("alert_key").distinct())


@query("acknowledged_alerts", f"SELECT {_alert} AS alert_key, CASE WHEN count(*) % 3 > 0 AND bool_or(value > 30) THEN 'acknowledged' WHEN count(*) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM events GROUP BY 1")
def acknowledged_alerts(spark, sf):
    e = _alerts(spark, sf)
    a = e.groupBy("alert_key").agg(F.when(F.count("*") % 3 == 0, "resolved").otherwise("open").alias("status"))
    return monitoring.acknowledge(a, e.where("value > 30").select("alert_key").distinct())


@query("id_set_changes", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' ELSE 'kept' END AS change FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE n_chars > 300) a FULL JOIN (SELECT DISTINCT vec_id AS id FROM embeddings) b ON a.id = b.id")
def id_set_changes(spark, sf):
    a = tables.read(spark, sf, "documents").where("n_chars > 300").select(F.col("doc_id").alias("id")).distinct().withColumn("old", F.lit(1))
    b = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).distinct().withColumn("new", F.lit(1))
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("kept").alias("change"))


@query("upserted_rows", "SELECT vec_id AS id, label::BIGINT AS v FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 100 + quality FROM labels")
def upserted_rows(spark, sf):
    old = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("v"))
    return tables.upsert(old, tables.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 100).cast("long").alias("v")), "id")


@query("streamed_metrics", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def streamed_metrics(spark, sf):
    """The tumbling metrics from a stream in append mode: what the watermark has closed."""
    import uuid

    at = f"{tables.scratch(spark)}/streams/{uuid.uuid4().hex}"
    out = monitoring.drain(monitoring.metric_buckets(monitoring.event_stream(spark, sf)), f"{at}/state", f"{at}/out")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
