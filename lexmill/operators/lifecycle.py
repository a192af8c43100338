"""State of crawl tasks, documents, versions and indexes as table rewrites: each function returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..sources.tables import stored

#: The states of a crawl task and those that each may go to.
TRANSITIONS = {
    "pending": ("queued", "running", "failed", "cancelled"),
    "queued": ("running", "calling_coze", "failed", "cancelled"),
    "running": ("calling_coze", "saving_documents", "completed", "failed", "cancelled"),
    "calling_coze": ("coze_running", "normalizing", "failed", "cancelled"),
    "coze_running": ("normalizing", "failed", "cancelled"),
    "normalizing": ("saving_documents", "failed", "cancelled"),
    "saving_documents": ("waiting_review", "completed", "partial_failed", "failed"),
    "waiting_review": ("completed", "partial_failed", "failed", "cancelled"),
    "partial_failed": ("pending", "waiting_review", "completed"),
    "failed": ("pending",),
    "cancelled": ("pending",),
    "completed": (),
}
#: States in which a worker is busy with a task, and those that end it.
BUSY = ("running", "calling_coze", "coze_running", "normalizing", "saving_documents")
ENDED = ("completed", "partial_failed", "failed", "cancelled")


def transitions(spark: SparkSession) -> DataFrame:
    """(status, target): the 36 allowed steps."""
    return spark.createDataFrame([(a, b) for a, targets in TRANSITIONS.items() for b in targets], "status string, target string")


def illegal(steps: DataFrame) -> DataFrame:
    """Those rows of ``steps`` (status, target) that no transition allows."""
    return steps.join(F.broadcast(transitions(steps.sparkSession)), ["status", "target"], "left_anti")  # a fixed table


def advance(tasks: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """``tasks`` after ``steps`` (task_id, expected, target): a step counts only if the task still has the expected status and may go there.

    Of several steps for a task none may be given twice. A step sets and clears the times that go with its target.
    """
    allowed = F.array_contains(F.element_at(F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, b)).cast("array<string>"))]), F.col("status")), F.col("target"))
    met = tasks.join(steps, "task_id", "left")
    go = F.coalesce((F.col("status") == F.col("expected")) & allowed, F.lit(False))
    to = F.when(go, F.col("target"))
    started = F.when(to == "running", now).when(to == "pending", None).otherwise(F.col("started_at"))
    ended = F.when(to.isin(*ENDED), now).when(to.isin("running", "waiting_review", "pending"), None).otherwise(F.col("finished_at"))
    return met.select("task_id", F.coalesce(to, "status").alias("status"), started.alias("started_at"), ended.alias("finished_at"), *[c for c in tasks.columns if c not in ("task_id", "status", "started_at", "finished_at")], go.alias("moved"))


def recover_stale(tasks: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """``tasks`` with an ``outcome``: busy ones begun before ``cutoff`` go back to pending, or fail after ``most`` attempts."""
    stale = F.coalesce(F.col("status").isin(*BUSY) & (F.col("started_at") < cutoff), F.lit(False))
    spent = stale & (F.col("retry_count") >= most)
    again = stale & ~spent
    return tasks.withColumns(
        {
            "outcome": F.when(spent, "exhausted").when(again, "recovered").otherwise("kept"),
            "status": F.when(spent, "failed").when(again, "pending").otherwise(F.col("status")),
            "started_at": F.when(~again, F.col("started_at")),
            "retry_count": F.col("retry_count") + again.cast("int"),
            "error": F.when(spent, "WORKER_LOST_MAX_RECOVERIES").when(again, "WORKER_LOST_RECOVERED"),
        }
    )


def upsert_failures(failures: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``failures`` with ``new`` ones merged by key: message and retryable follow the newest, a status of succeeded or retrying stays.

    ``new`` rows with one key count once, the last by ``seq``.
    """
    last = new.groupBy(*keys).agg(F.max_by(F.struct("message", "retryable", "status"), "seq").alias("n"))
    both = failures.select(*keys, F.struct("message", "retryable", "status").alias("o")).join(last, keys, "full_outer")
    status = F.when(F.col("o.status").isin("succeeded", "retrying"), F.col("o.status")).otherwise(F.coalesce("n.status", "o.status"))
    return both.select(*keys, F.coalesce("n.message", "o.message").alias("message"), F.coalesce("n.retryable", "o.retryable").alias("retryable"), status.alias("status"))


def crawl_upsert(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """``documents`` after a crawl of ``articles`` (column_id, canonical_url, content_hash): one row per key with an ``action``.

    A new address is added as version 1; equal content is left; changed content makes the next version, goes back to review
    and leaves its chunks stale. Articles with one key count once, the first by ``seq``.
    """
    keys = ["column_id", "canonical_url"]
    first = articles.groupBy(*keys).agg(F.min_by("content_hash", "seq").alias("new_hash"))
    both = documents.join(first, keys, "full_outer")
    added, seen = F.col("version").isNull(), F.col("new_hash").isNotNull()
    changed = ~added & seen & (F.col("content_hash") != F.col("new_hash"))
    return both.select(
        *keys,
        F.when(added, "new").when(changed, "changed").when(seen, "unchanged").otherwise("not_seen").alias("action"),
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        (F.coalesce("version", F.lit(0)) + (added | changed).cast("int")).alias("version"),
        F.when(added | changed, "pending_manual_review").otherwise(F.col("final_status")).alias("final_status"),
        F.when(added, "pending").when(changed, "stale").otherwise(F.col("chunk_status")).alias("chunk_status"),
    )


def batch_status(failed: Column, succeeded: Column, articles: Column, warned: Column) -> Column:
    """Where a finished batch leaves its task: no articles, partly failed, waiting for review, or completed."""
    none = (articles == 0) & (failed == 0) & (succeeded | warned)
    return F.when(none, "no_articles").when((failed > 0) | ~succeeded, "partial_failed").when(articles > 0, "waiting_review").otherwise("completed")


def reconcile(tasks: DataFrame, lineage: DataFrame, documents: DataFrame) -> DataFrame:
    """(task_id, accepted, rejected, pending, status): waiting tasks with the counts of their documents, completed when none is pending."""
    waiting = tasks.where("status = 'waiting_review'").select("task_id")
    owned = lineage.join(waiting, "task_id", "left_semi").select("task_id", "document_id").distinct().join(documents.select("document_id", "final_status"), "document_id")
    n = owned.groupBy("task_id").agg(F.count_if(F.col("final_status") == "approved").alias("accepted"), F.count_if(F.col("final_status") == "rejected").alias("rejected"), F.count("*").alias("total"))
    pending = F.col("total") - F.col("accepted") - F.col("rejected")
    return n.select("task_id", "accepted", "rejected", pending.alias("pending"), F.when(pending == 0, "completed").otherwise("waiting_review").alias("status"))


def first_known(rows: DataFrame, by: str, value: str, *order: Column) -> DataFrame:
    """(by, value): the first value that is not null, in order."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.where(F.col(value).isNotNull()).withColumn("nth", nth).where("nth = 1").select(by, value)


def replace_chunks(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, action) of an index run: documents whose chunks all are the same at every place keep theirs, others are replaced whole."""
    both = existing.select("doc_id", "chunk_index", F.col("chunk_id").alias("old")).join(desired.select("doc_id", "chunk_index", F.col("chunk_id").alias("new")), ["doc_id", "chunk_index"], "full_outer")
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    of_doc = both.groupBy("doc_id").agg(F.bool_and(same).alias("kept"))
    action = F.when(F.col("kept"), "keep").when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").otherwise("replace")
    return both.join(of_doc, "doc_id").select("doc_id", "chunk_index", action.alias("action"))


def stale_points(live: DataFrame, historic: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, point_id): points of live or historic chunks that are not current; null ids are none."""
    return live.select("doc_id", "point_id").unionByName(historic.select("doc_id", "point_id")).where("point_id is not null").distinct().join(current.select("doc_id", "point_id"), ["doc_id", "point_id"], "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both, equal): how two id sets compare."""
    sides = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full_outer")
    n = sides.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return n.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def embedding_accounting(texts: DataFrame, cache: DataFrame, batch_size: int, cost_per_1k_chars: float, *by: str) -> DataFrame:
    """(hits, embedded, chars, batches, cost): texts whose key is in the cache, and what embedding the others takes."""
    met = texts.join(cache.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
    missing = F.col("hit").isNull()
    n = met.groupBy(*by).agg(F.count("hit").alias("hits"), F.count_if(missing).alias("embedded"), F.coalesce(F.sum(F.when(missing, F.length("text"))), F.lit(0)).cast("long").alias("chars"))
    return n.withColumn("batches", F.ceil(F.col("embedded") / batch_size)).withColumn("cost", F.round(F.col("chars") / 1000 * cost_per_1k_chars, 8))


def ensure_lineage(lineage: DataFrame, wanted: DataFrame) -> DataFrame:
    """(task_id, document_id, lineage_id, version_id): the first lineage of every wanted pair, with its version if one is given; new pairs have no id yet."""
    keys = ["task_id", "document_id"]
    first = lineage.groupBy(*keys).agg(F.min_by(F.struct("lineage_id", "version_id"), "lineage_id").alias("l"))
    return wanted.select(*keys, F.col("version_id").alias("given")).join(first, keys, "left").select(*keys, "l.lineage_id", F.coalesce("given", "l.version_id").alias("version_id"))


#: Fields of a document that an operator may edit.
EDITABLE = ("title", "publish_date", "issuing_authority", "document_number", "region", "document_type")


def edit_documents(documents: DataFrame, edits: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents after ``edits`` of their fields (document_id, field, value), and the version rows (document_id, version, changed_fields, metadata) that this adds.

    Only EDITABLE fields count, and of those what differs; a null value empties a field, and of several edits of a field the last (seq) stands. An edited document counts its version up and is
    stale, so that it is indexed anew. A document without a row in ``versions`` first gets one of the state before. Others, and documents that are not there, change nothing.
    """
    asked = edits.where(F.col("field").isin(*EDITABLE)).groupBy("document_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    wide = asked.groupBy("document_id").agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f"_{f}") for f in EDITABLE])
    met = documents.join(wide, "document_id", "left")
    differs = {f: F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}.value").eqNullSafe(F.col(f).cast("string")) for f in EDITABLE}
    changed = F.array_compact(F.array(*[F.when(differs[f], F.lit(f)) for f in EDITABLE]))
    told = stored(met.withColumn("changed_fields", changed), "edits")
    new = F.size("changed_fields") > 0
    after = {f: F.when(F.array_contains("changed_fields", f), F.col(f"_{f}.value").cast(documents.schema[f].dataType)).otherwise(F.col(f)) for f in EDITABLE}
    out = told.withColumns({**after, "version": F.col("version") + new.cast("int"), "index_status": F.when(new, "stale").otherwise(F.col("index_status"))})
    snapshot = lambda rows: rows.select("document_id", "version", "changed_fields", J.payload(**{f: F.col(f).cast("string") for f in EDITABLE}).alias("metadata"))
    first = told.where(new).join(versions.select("document_id"), "document_id", "left_anti").withColumn("changed_fields", F.array().cast("array<string>"))
    return out.select(*documents.columns), snapshot(out.where(new)).unionByName(snapshot(first))


def valid_points(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of documents that are indexed as they are; those of stale, absent or rejected documents are not to be searched."""
    return points.join(documents.where("index_status = 'indexed' and final_status = 'approved'").select("document_id"), "document_id", "left_semi")


#: The contracts of a crawl provider.
BATCH, LEGACY = "batch_crawl", "legacy_single_article"


def admit(requests: DataFrame, columns: DataFrame, default_contract: str = BATCH) -> DataFrame:
    """(request_id, refusal, provider, contract): whether crawls may be asked for, and by which provider and contract; both are null for a refused request.

    Requests have column_id, provider and contract (null for none said), columns have column_id, enabled, source_enabled, crawl_provider and contract_mode. A column must be
    there and enabled, its source too. Who asks decides before the source; the local provider knows the batch contract alone, others take the request's, the source's or the default one.
    """
    met = requests.join(columns.withColumn("known", F.lit(True)), "column_id", "left")
    provider = F.coalesce("provider", "crawl_provider")
    contract = F.when(provider == "local", BATCH).otherwise(F.coalesce("contract", "contract_mode", F.lit(default_contract)))
    told = met.select("request_id", "known", (F.col("enabled") & F.col("source_enabled")).alias("open"), F.col("contract").alias("asked"), provider.alias("provider"), contract.alias("contract"))
    refusal = (
        F.when(F.col("known").isNull(), "NOT_FOUND")
        .when(~F.coalesce("open", F.lit(False)), "SOURCE_DISABLED")
        .when(F.col("provider") == "playwright", "CRAWL_PROVIDER_NOT_IMPLEMENTED")
        .when((F.col("provider") == "local") & (F.col("asked") == LEGACY), "LOCAL_CONTRACT_UNSUPPORTED")
        .when((F.col("provider") == "coze") & (F.col("contract") == LEGACY), "COZE_LEGACY_SINGLE_ARTICLE_ONLY")
    )
    good = lambda c: F.when(F.col("refusal").isNull(), F.col(c)).alias(c)
    return told.withColumn("refusal", refusal).select("request_id", "refusal", good("provider"), good("contract"))
