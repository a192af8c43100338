"""Source discovery: topic relevance, official and quality scores, gaps, cooldowns and trial columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web

#: Words that tell a software policy from news, procurement and talk.
SOFTWARE = ("软件产业", "软件业", "软件和信息技术服务业", "软件和信息服务业", "工业软件", "软件企业", "软件服务", "信息服务业", "软件首版次")
DIGITAL = ("信息化", "数字经济", "数字化转型", "工业互联网", "电子信息", "信息产业")
POLICY_CUES = ("政策", "规划", "方案", "办法", "通知", "公告", "公示", "意见", "要点", "目录", "行动", "申报", "征集", "解读", "优惠", "核查", "管理", "支持", "项目")
PROCUREMENT_CUES = ("采购", "招标", "投标", "磋商", "成交", "运维", "预算评审", "代理机构")
NEWS_CUES = ("新闻", "新闻发布会", "会议", "调研", "活动", "工作动态")
AUTHORITY_NAMES = "四川省经济和信息化厅|经济和信息化厅"
#: Words of official pages, and the states in which a discovery run is active.
OFFICIAL_MARKERS = ("政府", "政务", "人民政府", "government", "official", "gov")
ACTIVE_RUNS = ("pending", "running", "awaiting_approval")
RELEVANT = ("DIRECT", "RELATED")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def relevance(title: Column, text: Column, topic: Column) -> Column:
    """DIRECT, RELATED, WEAK or UNRELATED: how a document bears on a topic.

    Software topics have rules of their own; for others the whole topic, or half of its words or more, must occur.
    """
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), "(?U)\\s+", " "))
    tight = lambda x: F.regexp_replace(F.lower(x), "(?U)\\s+", "")
    head, body, about = tight(title), tight(text), tight(topic)
    both = F.concat(head, body)
    in_head, in_body = _has(head, SOFTWARE), _has(body, SOFTWARE)
    cued = _has(both, POLICY_CUES)
    any_signal = in_head | in_body | _has(F.regexp_replace(both, AUTHORITY_NAMES, ""), DIGITAL)
    software = (
        F.when(_has(head, PROCUREMENT_CUES), "UNRELATED")
        .when(_has(head, NEWS_CUES), F.when(F.contains(both, about) | any_signal, "WEAK").otherwise("UNRELATED"))
        .when(F.contains(head, about), "DIRECT")
        .when(F.contains(body, about), "RELATED")
        .when(in_head & cued, "DIRECT")
        .when(in_body & cued, "RELATED")
        .when(any_signal, "WEAK")
        .otherwise("UNRELATED")
    )
    whole = F.trim(F.concat_ws(" ", flat(title), flat(text)))
    words = F.filter(F.split(flat(topic), " "), lambda w: F.length(w) >= 2)
    found = F.size(F.filter(words, lambda w: F.contains(whole, w)))
    general = F.when(F.contains(whole, flat(topic)), "DIRECT").when((F.size(words) > 0) & (2 * found >= F.size(words)), "RELATED").otherwise("UNRELATED")
    return F.when(flat(topic) == "", "UNRELATED").when(F.contains(about, F.lit("软件")), software).otherwise(general)


def official_score(url: Column, body: Column, suffixes: tuple[str, ...]) -> Column:
    """0.60 for a trusted suffix, 0.25 for HTTPS and 0.15 for an official word in the page."""
    score = F.when(web.trusted_suffix(web.host(url), suffixes).isNotNull(), 0.60).otherwise(0.0) + F.when(web.scheme(url) == "https", 0.25).otherwise(0.0)
    return F.bround(score + F.when(_has(F.lower(F.substring(body, 1, 100_000)), OFFICIAL_MARKERS), 0.15).otherwise(0.0), 4)


def trial_columns(pages: DataFrame, min_chars: int, *by: str) -> DataFrame:
    """Trial counts and quality of each column of fetched pages (chars, level): half for the share of usable pages, half for their length."""
    usable = (F.col("chars") >= min_chars) & F.col("level").isin(*RELEVANT)
    n = pages.groupBy(*by).agg(F.count("*").alias("fetched"), F.count_if(usable).alias("success"), F.coalesce(F.bround(F.avg(F.when(usable, F.col("chars")))), F.lit(0.0)).cast("long").alias("average_chars"))
    richness = F.least(F.lit(1.0), F.col("average_chars") / max(2 * min_chars, 1))
    return n.withColumn("quality", F.bround(0.5 * F.col("success") / F.col("fetched") + 0.5 * richness, 4)).withColumn("status", F.when(F.col("success") > 0, "trial_crawled").otherwise("failed"))


def candidate_scores(columns: DataFrame, official: DataFrame, min_chars: int, threshold: float, by: str) -> DataFrame:
    """(by, columns, documents, success, average_chars, quality, status) of source candidates from their trial columns and official scores."""
    told = F.col("average_chars") > 0
    n = columns.groupBy(by).agg(F.count("*").alias("columns"), F.sum("fetched").alias("documents"), F.sum("success").alias("success"), F.coalesce(F.bround(F.avg(F.when(told, F.col("average_chars")))), F.lit(0.0)).cast("long").alias("average_chars"))
    score = 0.35 * F.coalesce("official", F.lit(0.0)) + 0.15 * F.least(F.col("columns") / 2.0, F.lit(1.0)) + 0.25 * F.col("success") / F.greatest(F.col("documents"), F.lit(1)) + 0.25 * F.least(F.col("average_chars") / max(2 * min_chars, 1), F.lit(1.0))
    scored = n.join(official, by, "left").withColumn("quality", F.bround(score, 4))
    return scored.drop("official").withColumn("status", F.when(F.col("quality") >= threshold, "pending_approval").otherwise("rejected"))


def content_gap(documents: DataFrame, sources: DataFrame, topic: str, region: str | None, need_sources: int, need_documents: int) -> DataFrame:
    """(sources, documents, gap): enabled sources and their usable documents that name the topic, and whether either is too few."""
    said = F.contains(F.lower("title"), F.lit(topic.strip().lower())) | F.contains(F.lower("content"), F.lit(topic.strip().lower()))
    met = documents.where(F.col("final_status").isin("approved", "indexed")).where(said).join(sources.where("enabled").select("source_id", F.col("region").alias("source_region")), "source_id")
    ours = F.lit(True) if region is None else F.col("source_region") == region
    theirs = F.lit(True) if region is None else F.col("region") == region
    n = met.agg(F.countDistinct(F.when(ours, F.col("source_id"))).alias("sources"), F.count_if(theirs).alias("documents"))
    return n.withColumn("gap", (F.col("sources") < need_sources) | (F.col("documents") < need_documents))


def due_topics(topics: DataFrame, runs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(topic, due, reason): an active run comes before the cooldown since the latest one; spelling in case and spaces aside."""
    key = F.lower(F.trim("topic"))
    told = runs.groupBy(key.alias("key")).agg(F.bool_or(F.col("status").isin(*ACTIVE_RUNS)).alias("active"), F.max("created_at").alias("latest"))
    fresh = F.col("latest") > now - F.make_dt_interval(secs=F.lit(seconds))
    reason = F.when(F.col("key_of") == "", "empty_topic").when(F.col("active"), "active_run").when(fresh, "cooldown").otherwise("due")
    met = topics.withColumn("key_of", key).join(told, F.col("key_of") == F.col("key"), "left")
    return met.select("topic", (reason == "due").alias("due"), reason.alias("reason"))


def distinct_trials(links: DataFrame, by: str, limit: int) -> DataFrame:
    """The links that each column of a candidate tries: an address belongs to the first column that has it, and a column takes its best ``limit``."""
    owner = F.row_number().over(Window.partitionBy(by, "url").orderBy("column_id", "place"))
    own = links.withColumn("nth", owner).where("nth = 1").drop("nth")
    order = Window.partitionBy(by, "column_id").orderBy(F.desc("priority"), "place", "url")
    return own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
