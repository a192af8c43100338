"""Registered queries: crawl tasks, documents, versions, lineage and index upkeep.

Orders are tasks and documents, lines are articles and chunks, customers are columns or topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..registry import query
from ..sources import tables

_states = list(lifecycle.TRANSITIONS)
_state_list = "[" + ", ".join(f"'{s}'" for s in _states) + "]"
_steps = ", ".join(f"('{a}', '{b}')" for a, targets in lifecycle.TRANSITIONS.items() for b in targets)
TASKS = f"tasks AS (SELECT o_orderkey AS task_id, {_state_list}[(o_orderkey % 12 + 1)::INT] AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderkey % 12 > 8 THEN o_orderdate + INTERVAL 1 DAY END AS finished_at, (o_orderkey % 4)::INT AS retry_count, o_custkey FROM orders)"


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    o, k = tables.read(spark, sf, "orders"), F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, _states)), (k % 12).cast("int"))
    return o.select(k.alias("task_id"), state.alias("status"), F.when(k % 5 > 0, F.col("o_orderdate")).alias("started_at"), F.when(k % 12 > 8, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"), (k % 4).cast("int").alias("retry_count"), "o_custkey")


@query("task_steps", f"WITH {TASKS}, s AS (SELECT task_id, status, lead(status) OVER (PARTITION BY o_custkey ORDER BY task_id) AS target FROM tasks) SELECT task_id, status, target FROM s WHERE target IS NOT NULL AND (status, target) NOT IN ({_steps})")
def task_steps(spark, sf):
    """Steps between the states of a column's tasks that are not allowed."""
    from pyspark.sql import Window

    s = tasks(spark, sf).select("task_id", "status", F.lead("status").over(Window.partitionBy("o_custkey").orderBy("task_id")).alias("target")).where("target is not null")
    return lifecycle.illegal(s).select("task_id", "status", "target")


@query(
    "advanced_tasks",
    f"""WITH {TASKS}, s AS (SELECT task_id, {_state_list}[(task_id % 7 + 1)::INT] AS expected, {_state_list}[(task_id % 11 + 2)::INT] AS target FROM tasks WHERE task_id % 3 > 0),
 g AS (SELECT t.*, target, coalesce(t.status = expected AND (t.status, target) IN ({_steps}), false) AS go FROM tasks t LEFT JOIN s USING (task_id)), m AS (SELECT *, CASE WHEN go THEN target END AS dest FROM g)
 SELECT task_id, coalesce(dest, status) AS status, CASE WHEN dest = 'running' THEN TIMESTAMP '2024-02-01' WHEN dest = 'pending' THEN NULL ELSE started_at END AS started_at,
 CASE WHEN dest IN ('completed', 'partial_failed', 'failed', 'cancelled') THEN TIMESTAMP '2024-02-01' WHEN dest IN ('running', 'waiting_review', 'pending') THEN NULL ELSE finished_at END AS finished_at, go AS moved FROM m""",
)
def advanced_tasks(spark, sf):
    """Compare-and-set: a step counts only where the task still is as expected."""
    t, k = tasks(spark, sf), F.col("task_id")
    pick = lambda n: F.get(F.array(*map(F.lit, _states)), n.cast("int"))
    steps = t.where(k % 3 > 0).select(k, pick(k % 7).alias("expected"), pick(k % 11 + 1).alias("target"))
    return lifecycle.advance(t, steps, F.lit("2024-02-01").cast("timestamp_ntz")).select("task_id", "status", "started_at", "finished_at", "moved")


_busy = "status IN ('running', 'calling_coze', 'coze_running', 'normalizing', 'saving_documents')"


@query("recovered_tasks", f"WITH {TASKS}, s AS (SELECT *, coalesce({_busy} AND started_at < TIMESTAMP '1996-01-01', false) AS stale FROM tasks) SELECT task_id, CASE WHEN stale AND retry_count >= 2 THEN 'exhausted' WHEN stale THEN 'recovered' ELSE 'kept' END AS outcome, CASE WHEN stale AND retry_count >= 2 THEN 'failed' WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale AND retry_count < 2 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM s")
def recovered_tasks(spark, sf):
    r = lifecycle.recover_stale(tasks(spark, sf), F.lit("1996-01-01").cast("timestamp_ntz"), 2)
    return r.select("task_id", "outcome", "status", "retry_count")


@query("stale_tasks", f"WITH {TASKS} SELECT task_id FROM tasks WHERE {_busy} AND started_at IS NOT NULL AND started_at < TIMESTAMP '1996-01-01'")
def stale_tasks(spark, sf):
    return tasks(spark, sf).where(F.col("status").isin(*lifecycle.BUSY) & (F.col("started_at") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("task_id")


@query("prioritised_orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderkey LIMIT 50")
def prioritised_orders(spark, sf):
    return tables.read(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(50).select("o_orderkey")


@query("best_first", "SELECT o_orderkey FROM orders ORDER BY nullif(o_totalprice, round(o_totalprice)) DESC NULLS FIRST, o_orderkey LIMIT 50")
def best_first(spark, sf):
    """By a score that may be missing: unscored rows come first."""
    o = tables.read(spark, sf, "orders")
    return o.orderBy(F.nullif(F.col("o_totalprice"), F.round("o_totalprice")).desc_nulls_first(), "o_orderkey").limit(50).select("o_orderkey")


@query("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf):
    return tables.read(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("loaded_relations", "SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def loaded_relations(spark, sf):
    """Each order with its lines as an array: lines are gathered before they meet their order."""
    line = tables.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    joined = tables.read(spark, sf, "orders").select("o_orderkey").join(line, "o_orderkey", "left")
    text = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["l_linenumber"], p["l_partkey"])), ",")
    return joined.select("o_orderkey", F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n"), F.coalesce(text, F.lit("")).alias("parts"))


_fail = "SELECT l_orderkey AS task_id, l_suppkey % 5 AS url, CASE WHEN l_linenumber % 2 = 0 THEN 'list' ELSE 'detail' END AS stage, 'E' || l_partkey % 3 AS code, l_shipdate AS day"


@query(
    "merged_failures",
    f"""WITH f AS ({_fail}, struct_pack(p := l_partkey, s := l_suppkey, n := l_linenumber) AS seq, 'm' || l_partkey AS message, l_partkey % 2 = 0 AS retryable, l_returnflag = 'A' AS old, ['succeeded', 'retrying', 'open'][(l_suppkey % 3 + 1)::INT] AS status FROM lineitem),
 o AS (SELECT task_id, url, stage, code, max_by(message, seq) AS message, max_by(retryable, seq) AS retryable, max_by(status, seq) AS status FROM f WHERE old GROUP BY 1, 2, 3, 4),
 n AS (SELECT task_id, url, stage, code, max_by(message, seq) AS message, max_by(retryable, seq) AS retryable FROM f WHERE NOT old GROUP BY 1, 2, 3, 4)
 SELECT task_id, url, stage, code, coalesce(n.message, o.message) AS message, coalesce(n.retryable, o.retryable) AS retryable, CASE WHEN o.status IN ('succeeded', 'retrying') THEN o.status WHEN n.message IS NOT NULL THEN 'failed' ELSE o.status END AS status FROM o FULL JOIN n USING (task_id, url, stage, code)""",
)
def merged_failures(spark, sf):
    """Failures merged by their four-part key; of a key's lines the last by part, supplier and number counts."""
    line, keys = tables.read(spark, sf, "lineitem"), ["task_id", "url", "stage", "code"]
    f = line.select(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 5).alias("url"), F.when(F.col("l_linenumber") % 2 == 0, "list").otherwise("detail").alias("stage"), F.concat(F.lit("E"), (F.col("l_partkey") % 3).cast("string")).alias("code"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("message"), (F.col("l_partkey") % 2 == 0).alias("retryable"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("seq"), (F.col("l_returnflag") == "A").alias("old"), F.get(F.array(*map(F.lit, ("succeeded", "retrying", "open"))), (F.col("l_suppkey") % 3).cast("int")).alias("status"))
    old = f.where("old").groupBy(*keys).agg(F.max_by(F.struct("message", "retryable", "status"), "seq").alias("x")).select(*keys, "x.*")
    return lifecycle.upsert_failures(old, f.where("not old").withColumn("status", F.lit("failed")), keys)


@query(
    "crawled_documents",
    """WITH d AS (SELECT l_suppkey % 10 AS column_id, l_partkey AS url, min(l_linenumber) % 3 AS hash, count(*)::INT AS version, min(l_returnflag) AS final_status FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
 a AS (SELECT l_suppkey % 10 AS column_id, l_partkey AS url, min_by(l_linenumber % 3, l_orderkey * 100 + l_linenumber) AS hash FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2)
 SELECT column_id, url AS canonical_url, CASE WHEN d.version IS NULL THEN 'new' WHEN a.hash IS NULL THEN 'not_seen' WHEN d.hash <> a.hash THEN 'changed' ELSE 'unchanged' END AS action, coalesce(a.hash, d.hash) AS content_hash, coalesce(d.version, 0) + (d.version IS NULL OR coalesce(d.hash <> a.hash, false))::INT AS version,
 CASE WHEN d.version IS NULL OR d.hash <> a.hash THEN 'pending_manual_review' ELSE d.final_status END AS final_status, CASE WHEN d.version IS NULL THEN 'pending' WHEN d.hash <> a.hash THEN 'stale' ELSE 'indexed' END AS chunk_status FROM d FULL JOIN a USING (column_id, url)""",
)
def crawled_documents(spark, sf):
    """Documents after a crawl: new, changed, unchanged or not seen, by column and canonical URL."""
    line = tables.read(spark, sf, "lineitem").withColumns({"column_id": F.col("l_suppkey") % 10, "canonical_url": F.col("l_partkey")})
    keys = ["column_id", "canonical_url"]
    d = line.where("l_orderkey % 2 = 0").groupBy(*keys).agg((F.min("l_linenumber") % 3).alias("content_hash"), F.count("*").cast("int").alias("version"), F.min("l_returnflag").alias("final_status"), F.lit("indexed").alias("chunk_status"))
    a = line.where("l_orderkey % 3 = 0").select(*keys, (F.col("l_linenumber") % 3).alias("content_hash"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return lifecycle.crawl_upsert(d, a)


@query(
    "batch_outcomes",
    "SELECT o_custkey AS task_id, sum((o_orderstatus = 'O')::INT)::BIGINT AS failed, count(*) FILTER (o_orderstatus <> 'P') AS articles, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 AND sum((o_orderstatus = 'O')::INT) = 0 AND (o_custkey % 3 > 0 OR o_custkey % 2 = 0) THEN 'no_articles' WHEN sum((o_orderstatus = 'O')::INT) > 0 OR o_custkey % 3 = 0 THEN 'partial_failed' WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN 'waiting_review' ELSE 'completed' END AS status FROM orders GROUP BY 1",
)
def batch_outcomes(spark, sf):
    """Counters and final status of every batch."""
    n = tables.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("failed"), F.count_if(F.col("o_orderstatus") != "P").alias("articles"))
    return n.withColumn("status", lifecycle.batch_status(F.col("failed"), F.col("task_id") % 3 > 0, F.col("articles"), F.col("task_id") % 2 == 0))


@query(
    "reconciled_tasks",
    "WITH w AS (SELECT DISTINCT l_suppkey AS task_id, l_orderkey AS document_id FROM lineitem WHERE l_suppkey % 4 = 1) SELECT task_id, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS rejected, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending, CASE WHEN count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 THEN 'completed' ELSE 'waiting_review' END AS status FROM w JOIN orders ON o_orderkey = document_id GROUP BY 1",
)
def reconciled_tasks(spark, sf):
    t = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_id"), F.when(F.col("s_suppkey") % 4 == 1, "waiting_review").otherwise("running").alias("status"))
    lineage = tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("document_id"))
    docs = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending").alias("final_status"))
    return lifecycle.reconcile(t, lineage, docs)


@query("first_known_parts", "SELECT l_orderkey, arg_min(l_partkey, l_shipdate::VARCHAR || lpad(l_linenumber::VARCHAR, 3, '0') || lpad(l_partkey::VARCHAR, 12, '0')) AS l_partkey FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1")
def first_known_parts(spark, sf):
    """The first value that is known, by time."""
    line = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", F.col("l_partkey").alias("p"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("l_partkey"))
    return lifecycle.first_known(line, "l_orderkey", "l_partkey", F.col("l_shipdate"), F.col("l_linenumber"), F.col("p"))


_chunks = "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, min(l_partkey) AS chunk_id FROM lineitem"


@query(
    "replaced_chunks",
    f"WITH e AS ({_chunks} WHERE l_linenumber <= 4 GROUP BY 1, 2), d AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, min(CASE WHEN l_orderkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END) AS chunk_id FROM lineitem WHERE l_linenumber <= 3 OR l_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT doc_id, chunk_index, e.chunk_id AS old, d.chunk_id AS new FROM e FULL JOIN d USING (doc_id, chunk_index)), k AS (SELECT doc_id, bool_and(coalesce(old = new, false)) AS kept FROM b GROUP BY 1) SELECT doc_id, chunk_index, CASE WHEN kept THEN 'keep' WHEN new IS NULL THEN 'delete' WHEN old IS NULL THEN 'insert' ELSE 'replace' END AS action FROM b JOIN k USING (doc_id)",
)
def replaced_chunks(spark, sf):
    """Existing and desired chunks by document and position."""
    line = tables.read(spark, sf, "lineitem")
    of = lambda rows, value: rows.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.min(value).alias("chunk_id"))
    new = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return lifecycle.replace_chunks(of(line.where("l_linenumber <= 4"), "l_partkey"), of(line.where("l_linenumber <= 3 or l_orderkey % 2 = 0"), new))


@query("stale_points", "SELECT doc_id, point_id FROM (SELECT l_orderkey AS doc_id, l_partkey AS point_id FROM lineitem WHERE l_linenumber <= 2 UNION SELECT l_orderkey, nullif(l_partkey, 5) FROM lineitem WHERE l_returnflag = 'R') WHERE point_id IS NOT NULL EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def stale_points(spark, sf):
    """Points of live and historic chunks that no current chunk has."""
    line = tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("point_id"), "l_linenumber", "l_returnflag", "l_linestatus")
    historic = line.where("l_returnflag = 'R'").withColumn("point_id", F.nullif(F.col("point_id"), F.lit(5)))
    return lifecycle.stale_points(line.where("l_linenumber <= 2"), historic, line.where("l_linestatus = 'F'"))


@query("store_comparison", "WITH a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT vec_id AS id FROM embeddings), s AS (SELECT a.id AS x, b.id AS y FROM a FULL JOIN b ON a.id = b.id) SELECT count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS equal FROM s")
def store_comparison(spark, sf):
    """Whether two stores hold the same ids."""
    return lifecycle.set_difference(tables.read(spark, sf, "documents").select(F.col("doc_id").alias("id")), tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query("deleted_vectors", "SELECT label, count(*) AS n, count(*) FILTER (vec_id = 3) > 0 AS has_three FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def deleted_vectors(spark, sf):
    """Vectors that stay when some are deleted by id, counted by a payload field."""
    gone = tables.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return tables.read(spark, sf, "embeddings").join(gone, "vec_id", "left_anti").groupBy("label").agg(F.count("*").alias("n"), (F.count_if(F.col("vec_id") == 3) > 0).alias("has_three"))


@query("embedding_costs", "SELECT lang, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS embedded, coalesce(sum(length(text)) FILTER (NOT hit), 0)::BIGINT AS chars, ceil(count(*) FILTER (NOT hit) / 16.0)::BIGINT AS batches, round(coalesce(sum(length(text)) FILTER (NOT hit), 0) / 1000.0::DOUBLE * 0.02, 8) AS cost FROM (SELECT lang, text, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) AS hit FROM documents) GROUP BY 1")
def embedding_costs(spark, sf):
    """Cache hits by content, and what embedding the rest takes."""
    d = tables.read(spark, sf, "documents").select("doc_id", "lang", "text", F.sha2("text", 256).alias("key"))
    return lifecycle.embedding_accounting(d, d.where("doc_id % 4 = 0"), 16, 0.02, "lang")


@query("ensured_lineage", "WITH l AS (SELECT l_suppkey AS task_id, l_orderkey AS document_id, arg_min(struct_pack(a := l_partkey * 10 + l_linenumber, b := nullif(l_linenumber, 1)), l_partkey * 10 + l_linenumber) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), w AS (SELECT l_suppkey AS task_id, l_orderkey AS document_id, max(CASE WHEN l_linenumber > 4 THEN l_linenumber END) AS given FROM lineitem GROUP BY 1, 2) SELECT task_id, document_id, f.a AS lineage_id, coalesce(given, f.b) AS version_id FROM w LEFT JOIN l USING (task_id, document_id)")
def ensured_lineage(spark, sf):
    """The first lineage of every task and document, or none yet."""
    line = tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("lineage_id"), "l_linenumber", "l_returnflag")
    have = line.where("l_returnflag = 'A'").withColumn("version_id", F.nullif(F.col("l_linenumber"), F.lit(1)))
    wanted = line.groupBy("task_id", "document_id").agg(F.max(F.when(F.col("l_linenumber") > 4, F.col("l_linenumber"))).alias("version_id"))
    return lifecycle.ensure_lineage(have, wanted)


@query("acceptance_summary", "SELECT o_custkey AS task_id, count(DISTINCT o_orderkey) AS documents, count(l_linenumber) AS chunks, count(*) FILTER (l_returnflag = 'N') AS points FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def acceptance_summary(spark, sf):
    """Documents, chunks and points of every task; chunks are counted by document first."""
    c = tables.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("chunks"), F.count_if(F.col("l_returnflag") == "N").alias("points"))
    o = tables.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id")).join(c, "o_orderkey", "left")
    return o.groupBy("task_id").agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("chunks", "points")])


_lineage_steps = "list_filter([CASE WHEN l_partkey % 7 = 0 THEN 'chunk' END, CASE WHEN o_orderkey IS NULL OR l_orderkey % 5 = 0 THEN 'document' END, CASE WHEN l_linenumber > 5 THEN 'version' END], lambda x: x IS NOT NULL)"


@query("answer_lineage", f"SELECT l_orderkey AS answer, l_linenumber AS citation, l_partkey AS chunk, array_to_string({_lineage_steps}, ',') AS missing_steps, len({_lineage_steps}) = 0 AS complete, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def answer_lineage(spark, sf):
    """Citations of answers followed to chunk, document and version, with the steps that are missing."""
    line = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cited = line.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("citation"), F.col("l_partkey").alias("chunk"))
    chunks = tables.read(spark, sf, "part").where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("chunk"), F.lit(True).alias("has_chunk"))
    docs = tables.read(spark, sf, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("answer"), F.lit(True).alias("has_document"))
    met = cited.join(chunks, "chunk", "left").join(docs, "answer", "left")
    missing = F.array_compact(F.array(F.when(F.col("has_chunk").isNull(), "chunk"), F.when(F.col("has_document").isNull(), "document"), F.when(F.col("citation") > 5, "version")))
    return met.groupBy("answer", "citation", "chunk", F.array_join(missing, ",").alias("missing_steps"), (F.size(missing) == 0).alias("complete")).agg(F.count("*").alias("n"))


#: Customers are documents, the suppliers of the same numbers are edits of them; odd nations already have versions.
_edited = "e AS (SELECT c.*, s_suppkey IS NOT NULL AS asked, s_name, s_nationkey, c_nationkey % 2 = 1 AS had FROM customer c LEFT JOIN supplier ON s_suppkey = c_custkey), f AS (SELECT *, list_filter([CASE WHEN asked THEN 'title' END, CASE WHEN asked AND s_nationkey <> c_nationkey THEN 'region' END, CASE WHEN asked AND s_nationkey > 12 THEN 'document_type' END], lambda x: x IS NOT NULL) AS fields FROM e)"


def _edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, s = tables.read(spark, sf, "customer"), tables.read(spark, sf, "supplier")
    null = lambda kind: F.lit(None).cast(kind)
    documents = c.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"), null("date").alias("publish_date"), null("string").alias("issuing_authority"), null("string").alias("document_number"), F.col("c_nationkey").cast("string").alias("region"), F.col("c_mktsegment").alias("document_type"), F.lit(3).alias("version"), F.lit("indexed").alias("index_status"))
    one = lambda field, value, seq: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(seq).alias("seq"))
    changes = F.array(one("title", F.lit("x"), 1), one("title", F.col("s_name"), 2), one("region", F.col("s_nationkey").cast("string"), 1), one("content", F.lit("x"), 1), F.when(F.col("s_nationkey") > 12, one("document_type", null("string"), 1)))
    edits = s.select(F.col("s_suppkey").alias("document_id"), F.explode(F.array_compact(changes)).alias("e")).select("document_id", "e.*")
    return lifecycle.edit_documents(documents, edits, c.where(F.col("c_nationkey") % 2 == 1).select(F.col("c_custkey").alias("document_id")))


@query("edited_documents", f"WITH {_edited} SELECT c_custkey AS document_id, CASE WHEN asked THEN s_name ELSE c_name END AS title, CASE WHEN asked THEN s_nationkey ELSE c_nationkey END::VARCHAR AS region, CASE WHEN list_contains(fields, 'document_type') THEN NULL ELSE c_mktsegment END AS document_type, 3 + (len(fields) > 0)::INT AS version, CASE WHEN len(fields) > 0 THEN 'stale' ELSE 'indexed' END AS index_status FROM f")
def edited_documents(spark, sf):
    """Documents after edits of their fields."""
    return _edits(spark, sf)[0].drop("publish_date", "issuing_authority", "document_number")


@query("edit_versions", f"WITH {_edited} SELECT c_custkey AS document_id, 4 AS version, array_to_string(fields, ',') AS changed FROM f WHERE len(fields) > 0 UNION ALL SELECT c_custkey, 3, '' FROM f WHERE len(fields) > 0 AND NOT had")
def edit_versions(spark, sf):
    """The versions that edits add, and the first ones of documents that had none."""
    return _edits(spark, sf)[1].select("document_id", "version", F.array_join("changed_fields", ",").alias("changed"))


@query(
    "admitted_tasks",
    """WITH t AS (SELECT o_orderkey AS request_id, CASE o_orderpriority[1] WHEN '1' THEN 'local' WHEN '2' THEN 'playwright' WHEN '5' THEN 'coze' END AS asked, CASE WHEN o_orderstatus = 'P' THEN 'legacy_single_article' END AS said, s.*, s_suppkey IS NOT NULL AS known FROM orders LEFT JOIN supplier s ON s_suppkey = o_custkey),
 p AS (SELECT *, coalesce(asked, CASE WHEN s_nationkey < 8 THEN 'local' ELSE 'coze' END) AS provider FROM t), c AS (SELECT *, CASE WHEN provider = 'local' THEN 'batch_crawl' ELSE coalesce(said, CASE WHEN s_nationkey BETWEEN 10 AND 12 THEN 'legacy_single_article' END, 'batch_crawl') END AS contract FROM p),
 x AS (SELECT *, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN s_acctbal < 0 OR s_nationkey > 20 THEN 'SOURCE_DISABLED' WHEN provider = 'playwright' THEN 'CRAWL_PROVIDER_NOT_IMPLEMENTED' WHEN provider = 'local' AND said IS NOT NULL THEN 'LOCAL_CONTRACT_UNSUPPORTED' WHEN provider = 'coze' AND contract = 'legacy_single_article' THEN 'COZE_LEGACY_SINGLE_ARTICLE_ONLY' END AS refusal FROM c)
 SELECT request_id, refusal, CASE WHEN refusal IS NULL THEN provider END AS provider, CASE WHEN refusal IS NULL THEN contract END AS contract FROM x""",
)
def admitted_tasks(spark, sf):
    """Which requests for crawls are taken, and how: orders ask for the supplier of their customer's number."""
    nation = F.col("s_nationkey")
    columns = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("column_id"), (F.col("s_acctbal") >= 0).alias("enabled"), (nation <= 20).alias("source_enabled"), F.when(nation < 8, "local").otherwise("coze").alias("crawl_provider"), F.when(nation.between(10, 12), lifecycle.LEGACY).alias("contract_mode"))
    first = F.substring("o_orderpriority", 1, 1)
    asked = F.when(first == "1", "local").when(first == "2", "playwright").when(first == "5", "coze")
    return lifecycle.admit(tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("column_id"), asked.alias("provider"), F.when(F.col("o_orderstatus") == "P", lifecycle.LEGACY).alias("contract")), columns)
