"""Query analysis, routing, evidence checks and grounded extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..sources.tables import stored

#: Intents by words of the question.
COUNT_INTENT = (
    r"(?:有|共有|共|发布了?|收录|检索到)?\s*(?:多少|几)\s*(?:份|篇|条|个|项)?\s*(?:政策|文件|文档|通知|文章|资料|材料|记录|来源|站点)"
    r"|(?:政策|文件|文档|通知|文章|资料|材料|记录|来源|站点)\s*(?:共有|有)?\s*(?:多少|几)\s*(?:份|篇|个)?\s*[?？。!！]*$"
    r"|(?:政策|文件|文档|通知|文章|资料|材料|记录|来源|站点)\s*(?:总数|数量|统计)"
    r"|(?:count|how many|total)\s+(?:polic(?:y|ies)|documents?|articles?|records?|sources?)"
)
FACT_VALUE_WORDS = "金额|罚款|比例|百分比|占比|日期|时间|期限|额度|标准|价格|费用|利率|补助|资助|奖励|amount|percent(?:age)?|date|time|deadline|price|fee|rate"
SEMANTIC_WORDS = "总结|概括|共同|措施|要求|原因|影响|summari[sz]e|common|explain"
#: Years that bound a question, and regions by the names they go by, the first of which counts.
AFTER_YEAR = r"(?i)(?:(?:after|since|晚于)\s*(20[0-9]{2})|(20[0-9]{2})\s*(?:之后|以来|以后))"
BEFORE_YEAR = r"(?i)(?:(?:before|截至|早于)\s*(20[0-9]{2})|(20[0-9]{2})\s*(?:之前|以前))"
REGIONS = {"四川": "四川省", "北京": "北京", "上海": "上海", "广东": "广东", "浙江": "浙江", "江苏": "江苏", "sichuan": "四川省", "beijing": "北京", "shanghai": "上海"}
#: The filters that a search may be given.
FILTERS = ("document_id", "source_id", "region", "city", "document_type", "issuing_authority", "publish_date_gte", "publish_date_lte", "document_version")
MIN_OVERLAP = 0.2


def _year(query: Column, pattern: str) -> Column:
    found = [F.nullif(F.regexp_extract(query, pattern, k), F.lit("")) for k in (1, 2)]
    return F.coalesce(*found).try_cast("int")


def inferred_filters(query: Column) -> Column:
    """struct(publish_date_gte, publish_date_lte, region) that a question names; null for what it does not."""
    flat, low = F.trim(F.regexp_replace(query, "(?U)\\s+", " ")), F.lower(query)
    after, before = _year(flat, AFTER_YEAR), _year(flat, BEFORE_YEAR)
    region = F.coalesce(*[F.when(F.contains(low, F.lit(name)), there) for name, there in REGIONS.items()])
    return F.struct(F.make_date(after + 1, F.lit(1), F.lit(1)).alias("publish_date_gte"), F.make_date(before - 1, F.lit(12), F.lit(31)).alias("publish_date_lte"), region.alias("region"))


def checked_filters(given: dict) -> dict:
    """The filters as they are; any other name than FILTERS is an error."""
    if unknown := sorted(set(given) - set(FILTERS)):
        raise ValueError(f"unsupported metadata filters: {unknown}")
    return given


def applied_filters(query: Column, given: dict | None = None) -> Column:
    """``inferred_filters`` with what was ``given`` in their place."""
    own, found = checked_filters(given or {}), inferred_filters(query)
    put = {**{k: found[k] for k in ("publish_date_gte", "publish_date_lte", "region")}, **{k: F.lit(v) for k, v in own.items()}}
    return F.struct(*[v.alias(k) for k, v in put.items()])


def structured_filter(given: dict) -> Column:
    """A condition on document columns; date bounds are on publish_date, a null never meets a condition."""
    bounds = {"publish_date_gte": lambda v: F.col("publish_date") >= F.lit(v).cast("date"), "publish_date_lte": lambda v: F.col("publish_date") <= F.lit(v).cast("date")}
    met = F.lit(True)
    for name, value in checked_filters(given).items():
        met = met & (bounds[name](value) if name in bounds else F.col(name) == F.lit(value))
    return met


def payload_filter(payload: Column, given: dict) -> Column:
    """A condition on a map of payload strings: bounds compare as strings, a missing entry meets nothing."""
    met = F.lit(True)
    for name, value in given.items():
        field = F.try_element_at(payload, F.lit(name.removesuffix("_gte").removesuffix("_lte")))
        said = field >= str(value) if name.endswith("_gte") else field <= str(value) if name.endswith("_lte") else field == str(value)
        met = met & F.coalesce(said, F.lit(False))
    return met


def route(query: Column, has_filters: Column) -> Column:
    """sql for counting questions, sql+rag for explaining ones over a filtered or counted set, rag for all others."""
    said = F.trim(query)
    aggregate = said.rlike(f"(?i){COUNT_INTENT}") & ~said.rlike(f"(?i){FACT_VALUE_WORDS}")
    semantic = said.rlike(f"(?i){SEMANTIC_WORDS}")
    return F.when(aggregate & ~semantic, "sql").when(semantic & (has_filters | aggregate), "sql+rag").otherwise("rag")


def grounded_answers(hits: DataFrame, queries: DataFrame, docs: DataFrame, quotes: int = 3, chars: int = 220) -> DataFrame:
    """(query_id, refused, support, citations, answer): the first quotes of hits that share enough words with the question, else a refusal."""
    body = docs.select(F.col("doc_id").alias("id"), "content")
    asked = queries.select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("asked"))
    met = hits.join(body, "id").join(asked, "query_id")
    share = F.size(F.array_intersect("asked", F.array_distinct(T.tokens(F.col("content"))))) / F.greatest(F.size("asked"), F.lit(1))
    good = met.select("query_id", "id", "rank", T.excerpt(F.col("content"), chars).alias("quote"), share.alias("share")).where(F.col("share") >= MIN_OVERLAP)
    nth = Window.partitionBy("query_id").orderBy("rank")
    best = good.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= quotes)
    told = best.groupBy("query_id").agg(F.round(F.max("share"), 6).alias("support"), F.array_sort(F.collect_list(F.struct("nth", "id", "quote"))).alias("cited"))
    joined = queries.select("query_id").join(told, "query_id", "left")
    return joined.select(
        "query_id",
        F.col("cited").isNull().alias("refused"),
        F.coalesce("support", F.lit(0.0)).alias("support"),
        F.coalesce(F.array_join(F.transform("cited", lambda c: c["id"].cast("string")), ","), F.lit("")).alias("citations"),
        F.coalesce(F.array_join(F.transform("cited", lambda c: c.quote), "\n"), F.lit("")).alias("answer"),
    )


def chat(questions: DataFrame, hits: DataFrame, official_only: bool = True, least_score: float = 0.0) -> DataFrame:
    """(query_id, route, refused, reason, confidence, answer, citations, trace) of questions (query_id, query) over their hits (query_id, id, rank, score, title, content, official, policy_key, policy_status, publish_date).

    A question is refused, with the first reason in this order, if its hits do not ground it, do not cover all that it asks, or do not support the answer, which is the quotes of the hits that
    are current and contribute. Hits are the few that a search keeps. A refusal has no answer and no citations. ``trace`` is what happened as an object without nulls. Questions without hits are refused.
    """
    from . import evidence, validation

    grounds = evidence.ground(questions, hits, least_score=least_score, official_only=official_only)
    usable = hits.where((F.col("score") >= least_score) & (F.trim("content") != "") & (F.col("official") if official_only else F.lit(True)))
    body = usable.select("query_id", "id", F.concat_ws("\n", "title", "content").alias("body"))
    gate = evidence.assess(questions, body)
    current = grounds.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.id", "c.quote").join(gate.select("query_id", F.explode("supporting").alias("id")), ["query_id", "id"]).join(hits.select("query_id", "id", "rank"), ["query_id", "id"])
    cited = stored(current, "cited")
    drafts = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "quote"))).alias("c")).select("query_id", F.array_join(F.transform("c", lambda x: x["quote"]), "\n").alias("answer"), F.transform("c", lambda x: x["id"]).alias("ids"))
    held = validation.validate(questions.join(drafts.select("query_id"), "query_id", "left_semi"), drafts.select("query_id", "answer"), body.join(cited.select("query_id", "id"), ["query_id", "id"], "left_semi"))
    told = questions.join(grounds.select("query_id", "grounded", "reasons", "conflicts"), "query_id").join(gate.select("query_id", "sufficient", F.col("confidence").alias("coverage"), F.col("reason").alias("gap")), "query_id").join(drafts, "query_id", "left").join(held.select("query_id", "supported", F.col("confidence").alias("support"), F.col("reason").alias("doubt")), "query_id", "left")
    reason = (
        F.when(~F.col("grounded"), F.get("reasons", 0))
        .when(~F.col("sufficient"), F.col("gap"))
        .when(F.col("answer").isNull(), "no_current_evidence")
        .when(~F.col("supported"), F.col("doubt"))
    )
    filters = inferred_filters(F.col("query"))
    named = F.coalesce(filters["publish_date_gte"].cast("string"), filters["publish_date_lte"].cast("string"), filters["region"]).isNotNull()
    told = told.withColumn("reason", reason).withColumn("route", route(F.col("query"), named))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    trace = J.payload(route=F.col("route"), refused=F.col("reason").isNotNull(), reason=F.col("reason"), conflicts=F.col("conflicts"), coverage=F.col("coverage"), support=F.col("support"), citations=good(F.col("ids")))
    return told.select("query_id", "route", F.col("reason").isNotNull().alias("refused"), F.coalesce("reason", F.lit("answered")).alias("reason"), F.coalesce(good(F.least("coverage", "support")), F.lit(0.0)).alias("confidence"), good(F.col("answer")).alias("answer"), good(F.col("ids")).alias("citations"), trace.alias("trace"))


def answer_points(answers: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, points, covered, coverage): how many expected points (query_id, point) an answer (query_id, answer) contains, letters and digits alone; without points all is covered."""
    said = answers.select("query_id", T.normalised(F.coalesce("answer", F.lit(""))).alias("said"))
    wanted = points.select("query_id", T.normalised(F.col("point")).alias("point")).where("point <> ''").distinct()
    met = said.join(wanted, "query_id", "left").groupBy("query_id").agg(F.count("point").alias("points"), F.count_if(F.col("point").isNotNull() & F.contains("said", "point")).alias("covered"))
    return met.withColumn("coverage", F.round(F.coalesce(F.col("covered") / F.nullif("points", F.lit(0)), F.lit(1.0)), 6))
