"""Contracts of providers: answers unwrapped to a bounded depth and checked by type, as rows and error rows of one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.text import let

#: Names that a provider wraps its result in, rounds of unwrapping, and what a batch and its articles are made of.
WRAPPERS, ROUNDS = ("data", "output", "result", "batch_result"), 3
DECISIONS = ("accepted", "rejected", "pending_review", "failed")
METHODS = ("html", "pdf", "doc", "docx", "xls", "xlsx", "image", "image_ocr", "mixed")
COUNTS = ("pages_visited", "articles_discovered", "articles_fetched", "articles_accepted", "articles_rejected", "articles_pending_review", "articles_failed")
#: field: (type, whether it must be there, whether it may be null).
BATCH = {
    "success": ("bool", True, False), "task_id": ("text", True, False), "source": ("object", True, False), "statistics": ("object", True, False), "articles": ("list", True, False), "failed_urls": ("list", True, False),
    "warnings": ("list", True, False), "contract_version": ("text", False, True), "workflow_version": ("text", False, True), "started_at": ("time", False, True), "finished_at": ("time", False, True), "completed_at": ("time", False, True),
    "diagnostics": ("object", False, True),
}
ARTICLE = {
    "title": ("text", True, False), "url": ("url", True, False), "published_at": ("time", False, True), "organization": ("text", False, True), "organization_inferred": ("bool", False, False), "region": ("text", False, True), "column_name": ("text", False, True),
    "content": ("text", True, False), "content_length": ("count", True, False), "attachments": ("list", False, False), "extraction_method": ("method", True, False), "needs_ocr": ("bool", False, False), "image_urls": ("list", False, False), "image_count": ("count", False, False),
    "image_alt_texts": ("list", False, False), "decision": ("decision", True, False), "accepted": ("bool", True, False), "quality_score": ("score", False, True), "decision_reason": ("text", True, False), "document_type": ("text", False, True), "summary": ("text", False, True),
    "keywords": ("list", False, False), "warnings": ("list", False, False),
}
FAILED = {"url": ("url", True, False), "stage": ("text", True, False), "error_code": ("text", True, False), "error_message": ("text", True, False), "retryable": ("bool", False, False)}
STATISTICS = {name: ("count", True, False) for name in COUNTS}
ANSWER = {"answer": ("text", True, False), "cited_chunk_ids": ("list", True, False), "refusal": ("bool", False, False), "refusal_reason": ("text", False, True)}
_URL = "^https?://[^/\\s?#]+\\S*$"
FENCE = "(?s)^```(?:json)?[ \\t]*\\r?\\n(.*)\\r?\\n```$"


def _decoded(text: Column) -> Column:
    """A whole JSON text, or a whole fenced one, as variant; null for anything else."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    bare = F.when(ends.rlike("(?U)\\s"), F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")).otherwise(text)
    return F.try_parse_json(let(bare, lambda b: F.when(b.startswith("```"), F.regexp_replace(b, FENCE, "$1")).otherwise(b)))


def unwrapped(text: Column) -> Column:
    """What an answer is under the wrappers of its provider, as variant: texts are decoded, and the first wrapper with a text or object in it is opened, ROUNDS times in all."""

    def opened(v: Column) -> Column:
        inner = [F.when(J.is_object(v, f"$.{k}") | (J.kind(v, f"$.{k}") == "STRING"), F.try_variant_get(v, f"$.{k}", "variant")) for k in WRAPPERS]
        return F.when(J.is_object(v), F.coalesce(*inner, v)).when(J.kind(v) == "STRING", _decoded(F.try_variant_get(v, "$", "string"))).otherwise(v)

    return reduce(lambda v, _: let(v, opened), range(ROUNDS - 1), _decoded(text))


def _fits(v: Column, path: str, kind: str) -> Column:
    """Whether what is at ``path`` has the type; the values of a type are checked with it."""
    told, text, number = J.kind(v, path), J.strict_string(v, path), J.strict_number(v, path, None)
    checks = {
        "bool": told == "BOOLEAN",
        "text": told == "STRING",
        "object": J.is_object(v, path),
        "list": J.is_list(v, path),
        "count": J.strict_int(v, path) >= 0,
        "score": number.between(0, 100),
        "url": text.rlike(_URL),
        "time": F.coalesce(F.try_to_timestamp(text), F.try_to_date(text).cast("timestamp")).isNotNull(),
        "decision": text.isin(*DECISIONS),
        "method": text.isin(*METHODS),
    }
    return F.coalesce(checks[kind], F.lit(False))


def _fault(place: Column, name: str, error: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.concat(place, F.lit(name)).alias("place"), F.lit(error).alias("error")))


def _typed(v: Column, fields: dict, place: Column) -> Column:
    """Faults of an object's fields: missing, of another type or value, or unknown."""

    def fault(x: Column, name: str, kind: str, needed: bool, nullable: bool) -> Column:
        here = lambda error: F.struct(F.concat(place, F.lit(name)).alias("place"), F.lit(error).alias("error"))
        good = F.when(x.isNull(), here("missing") if needed else None).when(_fits(x, "$", kind), None)
        return (good.when(J.kind(x) == "VOID", None) if nullable else good).otherwise(here(kind))

    def faults(own: Column) -> Column:
        unknown = F.transform(F.filter(J.names(v), lambda n: ~n.isin(*fields)), lambda n: F.struct(F.concat(place, n).alias("place"), F.lit("unknown").alias("error")))
        return F.concat(F.array_compact(F.array(*[fault(own[name], name, *how) for name, how in fields.items()])), unknown)

    # The object is taken apart once: to find a field by its path is to compare it with the names of all.
    return let(F.try_variant_get(v, "$", f"struct<{','.join(f'{name}:variant' for name in fields)}>"), faults)


def _list(v: Column, path: str, of: str = "variant") -> Column:
    """A list's elements whole, or only those fields of them that a struct ``of`` variants names."""
    return F.coalesce(F.try_variant_get(v, path, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def _article_faults(v: Column, place: Column) -> Column:
    """An article's own faults, and where its types are right, what of it does not agree."""
    text, flag = lambda k: J.strict_string(v, f"$.{k}"), lambda k: F.coalesce(J.strict_bool(v, f"$.{k}"), F.lit(False))
    agree = [
        _fault(place, "content_length", "is not the length of content", J.strict_int(v, "$.content_length") != F.length(text("content"))),
        _fault(place, "accepted", "is not the decision", flag("accepted") != (text("decision") == "accepted")),
        _fault(place, "needs_ocr", "must be true for an image", (text("extraction_method") == "image") & ~flag("needs_ocr")),
        _fault(place, "needs_ocr", "must be false once it is read", (text("extraction_method") == "image_ocr") & flag("needs_ocr")),
        _fault(place, "image_count", "is not the number of image_urls", F.coalesce(J.strict_int(v, "$.image_count"), F.lit(0)) != F.size(_list(v, "$.image_urls"))),
    ]
    return let(_typed(v, ARTICLE, place), lambda typed: F.when(F.size(typed) > 0, typed).otherwise(F.array_compact(F.array(*agree))))


def _batch_faults(v: Column) -> Column:
    top = F.lit("")
    each = lambda name, check: F.flatten(F.transform(_list(v, f"$.{name}"), lambda x, i: check(x, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].")))))
    typed = F.concat(
        _typed(v, BATCH, top),
        _fault_list(_fault(top, "task_id", "empty", J.strict_string(v, "$.task_id") == "")),
        let(F.try_variant_get(v, "$.statistics", "variant"), lambda s: F.when(J.is_object(s), _typed(s, STATISTICS, F.lit("statistics."))).otherwise(_none())),
        _fault_list(_fault(top, "source.source_url", "url", J.is_object(v, "$.source") & ~(_fits(v, "$.source.source_url", "url") | _fits(v, "$.source.url", "url")))),
        each("articles", _article_faults),
        each("failed_urls", lambda x, place: _typed(x, FAILED, place)),
    )
    count = lambda name: J.strict_int(v, f"$.statistics.{name}")

    def counted(decisions: Column) -> Column:
        of = lambda name: F.size(F.filter(decisions, lambda d: d == name))
        wrong = [_fault(top, f"statistics.articles_{name}", "is not the number of such articles", of(name) != count(f"articles_{name}")) for name in DECISIONS[:3]]
        lost = _fault(top, "statistics.articles_failed", "is not the number of failures", of("failed") + F.size(_list(v, "$.failed_urls")) != count("articles_failed"))
        return F.array_compact(F.array(*wrong, lost, _fault(top, "statistics.articles_fetched", "is not the number of articles", F.size(decisions) != count("articles_fetched"))))

    decisions = F.transform(_list(v, "$.articles", "struct<decision:variant>"), lambda x: J.strict_string(x["decision"], "$"))
    return let(typed, lambda t: F.when(F.size(t) > 0, t).otherwise(let(decisions, counted)))


def _none() -> Column:
    return F.array().cast("array<struct<place:string,error:string>>")


def _fault_list(*faults: Column) -> Column:
    return F.array_compact(F.array(*faults))


def _checked(v: Column, faults: Column) -> Column:
    whole = lambda error: F.array(F.struct(F.lit("").alias("place"), F.lit(error).alias("error")))
    return F.when(v.isNull(), whole("not_json")).when(~J.is_object(v), whole("not_an_object")).otherwise(faults)


def parse_batches(answers: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, task_id, nth, url, title, decision, content_length, place, error): the articles of good answers, and the faults of the others, from one pass.

    An answer with any fault gives its faults alone (``error`` not null): of fields that are missing, of another type or unknown at their places; where all types are right,
    of articles that do not agree with themselves, and then of statistics that do not agree with the articles. A null text is no JSON. A good answer without articles has no row.
    """
    opened = answers.select(ident, unwrapped(F.col(text)).alias("v")).select(ident, "v", _checked(F.col("v"), _batch_faults(F.col("v"))).alias("faults"))
    article = lambda x, i: F.struct(i.alias("nth"), J.strict_string(x["url"], "$").alias("url"), J.strict_string(x["title"], "$").alias("title"), J.strict_string(x["decision"], "$").alias("decision"), J.strict_int(x["content_length"], "$").alias("content_length"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("error"))
    null = lambda kind: F.lit(None).cast(kind)
    fault = lambda f: F.struct(null("int").alias("nth"), null("string").alias("url"), null("string").alias("title"), null("string").alias("decision"), null("bigint").alias("content_length"), f["place"].alias("place"), f["error"].alias("error"))
    rows = F.when(F.size("faults") > 0, F.transform("faults", fault)).otherwise(F.transform(_list(F.col("v"), "$.articles", "struct<url:variant,title:variant,decision:variant,content_length:variant>"), article))
    return opened.select(ident, J.strict_string(F.col("v"), "$.task_id").alias("task_id"), F.explode(rows).alias("r")).select(ident, "task_id", "r.*")


def check_answers(answers: DataFrame, ident: str, text: str, context: str) -> DataFrame:
    """(ident, answer, refusal, cited, error): what a model answers under its contract, and the first thing that is wrong with it.

    ``context`` is the array of ids that it was given. Fields that are missing, unknown or of another type come first; then an empty answer, a refusal with citations or without a
    reason, an answer without citations or with a reason, and citations from elsewhere. What is wrong has no answer.
    """

    def faults(v: Column) -> Column:
        said, refused, reason = J.strict_string(v, "$.answer"), F.coalesce(J.strict_bool(v, "$.refusal"), F.lit(False)), J.strict_string(v, "$.refusal_reason")
        blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
        cited = F.transform(_list(v, "$.cited_chunk_ids"), lambda x: J.strict_string(x, "$"))
        typed = _typed(v, ANSWER, F.lit(""))
        agree = lambda ids: (
            F.when(F.exists(ids, lambda x: x.isNull()), "cited_chunk_ids: text")
            .when(blank(said), "answer is empty")
            .when(refused & (F.size(ids) > 0), "a refusal cites")
            .when(refused & blank(reason), "a refusal has no reason")
            .when(~refused & (F.size(ids) == 0), "an answer cites nothing")
            .when(~refused & reason.isNotNull(), "an answer has a refusal's reason")
            .when(F.exists(ids, lambda x: ~F.array_contains(F.coalesce(F.col(context), F.array().cast("array<string>")), x)), "a citation is from elsewhere")
        )
        return let(typed, lambda t: F.when(F.size(t) > 0, F.concat_ws(": ", t[0]["place"], t[0]["error"])).otherwise(let(cited, agree)))

    v = F.col("v")
    told = answers.select(ident, context, _decoded(F.col(text)).alias("v")).withColumn("error", F.when(v.isNull(), "not_json").when(~J.is_object(v), "not_an_object").otherwise(faults(v)))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return told.select(ident, good(J.strict_string(v, "$.answer")).alias("answer"), good(F.coalesce(J.strict_bool(v, "$.refusal"), F.lit(False))).alias("refusal"), good(F.transform(_list(v, "$.cited_chunk_ids"), lambda x: J.strict_string(x, "$"))).alias("cited"), "error")
