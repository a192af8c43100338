"""Reviews by rule and by hand, draft questions, feedback and upkeep of old data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored

#: Verdicts of a review, and spellings of yes and no in a sheet.
VERDICTS = ("PASS", "FIX", "REJECT")
YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
#: Kinds of feedback that make a question, and those that expect no chunk.
CONVERTIBLE = ("not_helpful", "incomplete_answer", "incorrect_citation", "missing_document", "should_refuse", "should_not_refuse")
NO_CHUNKS = ("incorrect_citation", "missing_document", "should_refuse", "should_not_refuse")


def list_cell(cell: Column) -> Column:
    """Distinct entries of a cell that is a JSON array, or parted by semicolons or else lines; blanks are left out."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, F.when(F.contains(text, F.lit(";")), ";").otherwise("\n")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def bool_cell(cell: Column) -> Column:
    """True or false in the usual spellings; null for an empty cell or any other text."""
    low = F.lower(F.trim(cell))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def apply_reviews(rows: DataFrame) -> DataFrame:
    """``rows`` with reviewed, verified and the effective answer, refusal and chunks: a FIX puts corrections in place."""
    fix = F.col("verdict") == "FIX"
    corrected = F.coalesce(F.nullif(F.trim("corrected_answer"), F.lit("")).isNotNull(), F.lit(False))
    return rows.withColumns(
        {
            "reviewed": F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)),
            "verified": F.coalesce((F.col("verdict") == "PASS") | (fix & corrected), F.lit(False)),
            "effective_answer": F.when(fix & corrected, F.col("corrected_answer")).otherwise(F.col("expected_answer")),
            "effective_should_refuse": F.when(fix, F.coalesce("corrected_should_refuse", "should_refuse")).otherwise(F.col("should_refuse")),
            "effective_chunk_ids": F.array_distinct(F.concat("expected_chunk_ids", "additional_chunk_ids")),
        }
    )


#: Fields that a model may extract from a document.
EXTRACTED_FIELDS = tuple("issuing_authority document_number policy_target support_measures application_conditions funding_amount deadline department region industry contact_information key_indicators".split())


def quoted_fields(fields: Column, content: Column, allowed: tuple[str, ...] = EXTRACTED_FIELDS) -> Column:
    """What is wrong with extracted fields (map<string, struct<value, quote, confidence>>): a field that is not known, or a quote that the document does not have; null for nothing."""
    each = F.map_entries(fields)
    unknown = F.get(F.filter(each, lambda e: ~e["key"].isin(*allowed)), 0)["key"]
    made_up = F.get(F.filter(each, lambda e: ~F.coalesce(F.contains(content, e["value"]["quote"]), F.lit(False))), 0)["key"]
    outside = F.get(F.filter(each, lambda e: ~F.coalesce(e["value"]["confidence"].between(0, 1), F.lit(False))), 0)["key"]
    return F.coalesce(F.concat(F.lit("unsupported field: "), unknown), F.concat(F.lit("no such quote: "), made_up), F.concat(F.lit("invalid field: "), outside))


def review_pipeline(ruled: DataFrame, verdicts: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(doc_id, rule_decision, llm_status, final_status, fault, knowledge) of documents (doc_id, content, rule_decision) after a model's verdicts (doc_id, decision, fields) and people's.

    What the rules reject is never shown to the model. Without a verdict, or with one that is no decision or whose fields are at fault, the model is unavailable and the document waits
    for it; a rejection rejects; a doubt of the model or the rules asks a person; otherwise it is approved. Of a document's ``decisions`` (doc_id, decision, at) the newest
    approve or reject stands above all; others are ignored. ``knowledge`` is how many fields a usable verdict gives. A document has one verdict at most.
    """
    told = ruled.join(verdicts.select("doc_id", F.lower(F.trim("decision")).alias("decision"), "fields"), "doc_id", "left").withColumn("fault", quoted_fields(F.col("fields"), F.col("content")))
    shown = F.col("rule_decision") != "reject"
    usable = shown & F.col("decision").isin("accept", "reject", "manual_review") & F.col("fault").isNull()
    usable = F.coalesce(usable, F.lit(False))
    status = (
        F.when(~shown, "rejected")
        .when(~usable, "pending_llm")
        .when(F.col("decision") == "reject", "rejected")
        .when((F.col("decision") == "manual_review") | (F.col("rule_decision") == "review"), "pending_manual_review")
        .otherwise("approved")
    )
    out = told.select("doc_id", "rule_decision", F.when(shown, F.when(usable, F.col("decision")).otherwise("unavailable")).alias("llm_status"), status.alias("final_status"), F.when(shown, F.col("fault")).alias("fault"), F.when(usable, F.coalesce(F.size("fields"), F.lit(0))).otherwise(0).alias("knowledge"))
    if decisions is None:
        return out
    last = decisions.where(F.col("decision").isin("approve", "reject")).groupBy("doc_id").agg(F.max_by("decision", "at").alias("said"))
    final = F.when(F.col("said") == "approve", "approved").when(F.col("said") == "reject", "rejected").otherwise(F.col("final_status"))
    return out.join(last, "doc_id", "left").withColumn("final_status", final).drop("said")


def ensured_prompts(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, version, content_hash, state) of ``wanted`` prompts (name, version, content) beside the ``stored`` ones (name, version, content_hash): new, kept, or changed, which is an error to whoever asked.

    A name and version stand for one content for ever; a version that is wanted twice with different contents is changed, too.
    """
    asked = wanted.groupBy("name", "version").agg(F.min(F.sha2("content", 256)).alias("content_hash"), F.countDistinct("content").alias("n"))
    met = asked.join(stored.select("name", "version", F.col("content_hash").alias("have")), ["name", "version"], "left")
    state = F.when((F.col("n") > 1) | (F.col("have") != F.col("content_hash")), "changed").when(F.col("have").isNull(), "new").otherwise("kept")
    return met.select("name", "version", "content_hash", state.alias("state"))


def traceability(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, errors): what the ids of a review row do not lead to."""
    asked = rows.select("question_id", "document_id", F.explode_outer("effective_chunk_ids").alias("chunk_id"))
    met = asked.join(chunks.select("chunk_id", F.col("document_id").alias("of")), "chunk_id", "left")
    fault = F.when(F.col("chunk_id").isNull(), None).when(F.col("of").isNull(), F.concat(F.lit("unknown_chunk:"), F.col("chunk_id").cast("string"))).when(F.col("of") != F.col("document_id"), F.concat(F.lit("foreign_chunk:"), F.col("chunk_id").cast("string")))
    return met.groupBy("question_id").agg(F.array_sort(F.collect_set(fault)).alias("errors"))


def row_faults(rows: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, error): what is wrong with reviewed rows, each thing once.

    Rows have id, verdict, corrected_answer, document_ids, source_urls, expected_chunk_ids, effective_chunk_ids, effective_should_refuse, evidence_excerpt, document_title and source_title; they are followed
    to documents (document_id, url, title, source_title) and chunks (chunk_id, document_id, content), of one row a key. Titles and excerpts must be those of what a row expects, as far as that is known; a document's
    address must be among the row's, a chunk's document too; a case that is not to be refused must name all of them. A blank id is told once, and nothing else of such rows.
    """
    kept = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    good = kept.where(F.coalesce(F.trim("id"), F.lit("")) != "")
    fault = lambda kind, *more: F.concat_ws(":", F.lit(kind), "id", *[m.cast("string") for m in more])

    asked = good.select("_row", "id", "source_urls", F.posexplode("document_ids").alias("nth", "document_id")).join(documents.withColumn("known", F.lit(True)), "document_id", "left")
    strange = F.when(F.col("known").isNull(), fault("UNKNOWN_DOCUMENT", F.col("document_id"))).when((F.size("source_urls") > 0) & ~F.array_contains("source_urls", F.coalesce("url", F.lit(""))), fault("SOURCE_URL_MISMATCH", F.col("document_id")))
    in_order = lambda value, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(by).alias("n"), value.alias("v"))))), lambda x: x["v"]), by == "nth" and " | " or "\n\n")
    titles = asked.groupBy("_row").agg(in_order(F.col("title"), "nth").alias("titles"), in_order(F.col("source_title"), "nth").alias("sources"))
    used = good.select("_row", "id", "document_ids", F.explode("effective_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", F.col("document_id").alias("of")), "chunk_id", "left")
    foreign = F.when(F.col("of").isNull(), fault("UNKNOWN_CHUNK", F.col("chunk_id"))).when(~F.array_contains("document_ids", F.col("of")), fault("CHUNK_DOCUMENT_MISMATCH", F.col("chunk_id")))
    quotes = good.select("_row", F.posexplode("expected_chunk_ids").alias("place", "chunk_id")).join(chunks.select("chunk_id", T.compact_excerpt(F.col("content"), 500).alias("quote")), "chunk_id").groupBy("_row").agg(in_order(F.col("quote"), "place").alias("quotes"))

    met = good.join(titles, "_row", "left").join(quotes, "_row", "left")
    differs = lambda own, known: (F.coalesce(F.col(known), F.lit("")) != "") & (F.coalesce(F.col(own), F.lit("")) != F.col(known))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    positive = ~F.coalesce("effective_should_refuse", F.lit(False))
    none = lambda c: positive & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    own = {
        "INVALID_VERDICT": F.col("verdict").isNotNull() & ~F.col("verdict").isin(*VERDICTS),
        "FIX_REQUIRES_CORRECTED_ANSWER": (F.col("verdict") == "FIX") & blank("corrected_answer"),
        "EVIDENCE_EXCERPT_MISMATCH": differs("evidence_excerpt", "quotes"),
        "DOCUMENT_TITLE_MISMATCH": differs("document_title", "titles"),
        "SOURCE_TITLE_MISMATCH": differs("source_title", "sources"),
        "POSITIVE_CASE_MISSING_DOCUMENT": none("document_ids"),
        "POSITIVE_CASE_MISSING_SOURCE": none("source_urls"),
        "POSITIVE_CASE_MISSING_CHUNK": none("effective_chunk_ids"),
        "POSITIVE_CASE_MISSING_EVIDENCE": positive & blank("evidence_excerpt"),
    }
    listed = met.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), fault(kind)) for kind, when in own.items()]))).alias("error"))
    twice = good.groupBy("id").count().where("count > 1").select("id", fault("DUPLICATE_ID").alias("error"))
    unnamed = kept.where(F.coalesce(F.trim("id"), F.lit("")) == "").select(F.lit(None).cast("string").alias("id"), F.lit("MISSING_ID").alias("error"))
    told = [listed, asked.select("id", strange.alias("error")), used.select("id", foreign.alias("error")), twice, unnamed]
    return reduce(DataFrame.unionByName, told).where("error is not null").distinct()


def review_counts(rows: DataFrame, errors: Column) -> DataFrame:
    """One row of verdict counts with a status: complete when all are reviewed and nothing is untraceable."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(F.col("reviewed")).alias("reviewed"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], F.count_if(F.col("verified")).alias("verified"), F.coalesce(F.sum(errors), F.lit(0)).alias("traceability_errors"))
    done = (F.col("traceability_errors") == 0) & (F.col("total") > 0) & (F.col("reviewed") == F.col("total"))
    return n.withColumn("unreviewed", F.col("total") - F.col("reviewed")).withColumn("status", F.when(done, "complete").otherwise("partial"))


def feedback_questions(feedback: DataFrame) -> DataFrame:
    """Evaluation questions of feedback (id, kind, comment, query, cited_documents, cited_chunks, expected_document) that shows a fault."""
    kind, none = F.col("kind"), F.array().cast("array<bigint>")
    documents = F.when(kind == "should_refuse", none).when(F.col("expected_document").isNotNull(), F.array("expected_document")).when(kind == "incorrect_citation", none).otherwise(F.array_distinct(F.array_compact("cited_documents")))
    points = F.when(kind.isin("not_helpful", "incomplete_answer") & (F.trim("comment") != ""), F.array(F.trim("comment"))).otherwise(F.array().cast("array<string>"))
    return feedback.where(kind.isin(*CONVERTIBLE)).select(
        F.concat(F.lit("feedback-"), F.col("id").cast("string")).alias("question_id"),
        F.col("query").alias("question"),
        documents.alias("expected_document_ids"),
        F.when(kind.isin(*NO_CHUNKS), none).otherwise(F.array_distinct(F.array_compact("cited_chunks"))).alias("expected_chunk_ids"),
        points.alias("expected_answer_points"),
        (kind == "should_refuse").alias("should_refuse"),
        F.concat(F.lit("feedback/"), kind).alias("category"),
    )


def data_debt(documents: DataFrame, reviews: DataFrame, least_chars: int = 40) -> DataFrame:
    """(document_id, action): pending documents that are too short and have no attachment are rejected, others are marked for a person; each only once."""
    done = reviews.groupBy("document_id").agg(F.bool_or(F.col("review_type") == "data_debt_hard_reject").alias("rejected"), F.bool_or(F.col("review_type") == "data_debt_audit").alias("audited"))
    short = (F.length(F.trim("content")) < least_chars) & ~F.col("has_attachment")
    action = F.when(short & ~F.coalesce("rejected", F.lit(False)), "rejected").when(~short & ~F.coalesce("audited", F.lit(False)), "human_review_required")
    return documents.join(done, "document_id", "left").select("document_id", action.alias("action")).where("action is not null")


def invalid_regions(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """(document_id, correction_key): documents whose region is ``??`` and that have no correction of it yet."""
    key = F.sha2(F.concat(F.col("document_id").cast("string"), F.lit(":region:??:historical_invalid_region")), 256)
    return documents.where("region = '??'").select("document_id", key.alias("correction_key")).join(corrections.select("correction_key"), "correction_key", "left_anti").select("document_id", "correction_key")


def draft_questions(rows: DataFrame, required: tuple[str, ...], positive: tuple[str, ...], refusals: tuple[str, ...], limit: int = 100) -> DataFrame:
    """Draft questions of the first ``limit`` rows (document_id, title, content, chunk_id, publish_date, region), at most some hundred.

    Required categories come first, one each, then the positive ones in turn. Questions over several documents take the next row, the last one the first.
    """
    order = Window.orderBy("document_id")
    first = rows.orderBy("document_id").limit(limit)
    placed = first.withColumn("nth", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead(F.struct("document_id", "chunk_id")).over(order), F.first(F.struct("document_id", "chunk_id")).over(order)))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    category = F.when(F.col("nth") <= len(required), pick(required, F.col("nth") - 1)).otherwise(pick(positive, F.pmod(F.col("nth") - 1 - len(required), F.lit(len(positive)))))
    named = placed.withColumn("category", category).withColumn("should_refuse", category.isin(*refusals))
    several = F.col("category").isin("multi_document", "multi_hop")
    none = F.array().cast("array<bigint>")
    ids = lambda c: F.when(F.col("should_refuse"), none).when(several, F.array(c, f"second.{c}")).otherwise(F.array(c))
    return named.select(
        F.format_string("draft-%03d", "nth").alias("id"),
        "category",
        "should_refuse",
        F.concat(F.lit("What does "), F.col("title"), F.lit(" say? ["), F.col("category"), F.lit("]")).alias("question"),
        ids("document_id").alias("expected_documents"),
        ids("chunk_id").alias("expected_chunk_ids"),
        F.when(F.col("should_refuse"), "").otherwise(T.compact_excerpt(F.col("content"), 360)).alias("expected_answer"),
    )
