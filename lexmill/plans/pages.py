"""Registered queries: links, pagination and kinds of crawled pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, web
from ..functions import text as T
from ..registry import query
from ..sources import tables
from .curation import CANONICAL, _paths

_link = 'href="([^"]*)">([^<]*)<'
_low = "lower(href)"
_dir = "/list|index[.]|newschild|common_list"
_nav = "|".join(web.NAVIGATION_WORDS)
_said = ", ".join(f"'{w}'" for w in web.ARTICLE_WORDS)
LINKS = f"""l AS (SELECT page_id, scheme || '://' || host AS base, unnest(regexp_extract_all(html, '{_link}', 1)) AS href, unnest(regexp_extract_all(html, '{_link}', 2)) AS label FROM canonical),
 s AS (SELECT DISTINCT page_id, base || regexp_replace(href, '/+', '/', 'g') AS url, label, least(6, 2 * len(list_filter([{_paths}], lambda t: contains({_low}, t)))) + CASE WHEN regexp_matches({_low}, '{web.DATE_PATH}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({_low}, '{web.NUMERIC_ID}') THEN 1 ELSE 0 END
  + least(4, len(list_filter([{_said}], lambda t: contains(lower(label), t)))) - CASE WHEN regexp_matches({_low}, '{_dir}') THEN 4 ELSE 0 END - CASE WHEN trim(label) = '' THEN 1 ELSE 0 END AS score FROM l WHERE trim(label) <> '' AND NOT regexp_matches(lower(label), '{_nav}'))"""


@query("link_candidates", f"WITH {CANONICAL}, {LINKS} SELECT page_id, url, label, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url, label) AS nth FROM s) WHERE nth <= 5")
def link_candidates(spark, sf):
    """The five likeliest links of each page to articles of its site."""
    p = tables.read(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(_link), F.lit(0))).alias("m"))
    found = p.select("page_id", "url", F.regexp_extract("m", _link, 1).alias("href"), F.regexp_extract("m", _link, 2).alias("label")).where(~web.excluded_link(F.col("href")) & ~web.navigation_label(F.col("label")))
    links = found.select("page_id", F.col("url").alias("page"), web.resolve("href", "url").alias("url"), "label").select("page_id", "page", F.explode(F.array(web.canonical_url(F.col("url")))).alias("url"), "label")  # a row of its own, so that later expressions do not repeat it
    own = links.where(web.same_site(web.host(F.col("page")), web.host(F.col("url"))) & ~web.extension(F.col("url")).isin(*web.OTHER_EXTENSIONS)).select("page_id", "url", "label", web.link_score(F.col("url"), F.col("label")).alias("score")).distinct()
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "url", "label")
    return own.withColumn("nth", F.row_number().over(order)).where("nth <= 5").drop("nth")


@query("api_hints", "SELECT page_id, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ' ') AS hints FROM (SELECT page_id, regexp_extract_all(html || '<script>fetch(\"/api/items?p=' || page_id || '\")</script>', '(?i)[\"''](https?://[^\"'']+|/[^\"'']*(?:api|ajax|json)[^\"'']*)[\"'']', 1) AS h FROM pages)")
def api_hints(spark, sf):
    """Addresses of data in a page's scripts."""
    p = tables.read(spark, sf, "pages")
    script = F.concat(F.lit('<script>fetch("/api/items?p='), F.col("page_id").cast("string"), F.lit('")</script>'))
    return p.select("page_id", F.array_join(web.api_hints(F.concat("html", script)), " ").alias("hints"))


@query("next_pages", "SELECT page_id, CASE WHEN n IS NOT NULL THEN regexp_replace(url, '[?]page=[0-9]+&([^#]*)(#.*)?$', '?\\1&page=' || (n + 1)) END AS next, n + 1 AS number FROM (SELECT *, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::BIGINT AS n FROM pages)")
def next_pages(spark, sf):
    """The page that follows each, by its links or by counting up; null where nothing says so."""
    p = tables.read(spark, sf, "pages").select("page_id", "url", html.parse_html("html").alias("a"))
    absolute = p.select("page_id", "url", F.posexplode_outer("a.page_links").alias("at", "x")).select("page_id", "url", "at", "x", web.resolve("x.href", "url").alias("to"))
    links = absolute.select("page_id", "url", F.struct("at", F.col("to").alias("href"), "x.text", "x.rel", "x.aria", web.page_number(F.col("to")).alias("n")).alias("l"))
    every = links.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.when(F.col("l.href").isNotNull(), F.col("l")))).alias("links"))
    after = every.select("page_id", F.explode_outer(F.array(web.next_page(F.col("url"), F.col("links")))).alias("next"))
    return after.select("page_id", "next", web.page_number(F.col("next")).alias("number"))


@query("detail_pages")
def detail_pages(spark, sf):
    """Which pages look like articles, by address and the share of text in links."""
    p = tables.read(spark, sf, "pages").select("page_id", "url", html.parse_html("html").alias("a"))
    return p.select("page_id", web.looks_like_detail(F.col("url"), F.length("a.text"), F.size("a.links")).alias("detail"), (F.length("a.text") < 120).alias("needs_ocr"))


@query("detail_documents")
def detail_documents(spark, sf):
    """Title, text, date, attachments and images of each page, and which selectors told them."""
    p = tables.read(spark, sf, "pages").select("page_id", html.extract_detail("html", "url", F.create_map(F.lit("publish_date"), F.lit(".published"))).alias("d")).select("page_id", "d.*")
    return p.withColumn("publish_date", T.written_date(F.col("publish_date")))


_forms = "['发布时间：{y}年{m}月{d}日 10:00', '{y}-{m}-{d}T08:00:00Z', 'am {y}/{m}/{d} und 2001-1-1', '{y}.{m}.{d}', '{m}/{d}/{y}', '{y}-13-{d}']"


@query("written_dates", "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN ts::DATE END AS day FROM events")
def written_dates(spark, sf):
    """Dates in the forms that pages write them in; the last two forms are none."""
    forms = F.from_json(F.lit(_forms.replace("'", '"')), "array<string>")
    e = tables.read(spark, sf, "events").select("event_id", F.get(forms, (F.col("event_id") % 6).cast("int")).alias("t"), "ts")
    for name, of in (("{y}", F.year), ("{m}", F.month), ("{d}", F.dayofmonth)):
        e = e.withColumn("t", F.replace("t", F.lit(name), of("ts").cast("string")))
    return e.select("event_id", T.written_date(F.col("t")).alias("day"))


@query("host_kinds", f"WITH {CANONICAL} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 = 1 THEN false END AS public FROM canonical")
def host_kinds(spark, sf):
    """Which hosts are addresses of the public internet; null for names, which are not looked up."""
    k = F.col("page_id")
    address = F.when(k % 5 == 0, F.format_string("8.8.%d.%d", k % 200, k % 100)).when(k % 5 == 1, F.get(F.array(F.lit("10.1.2.3"), F.lit("127.0.0.1"), F.lit("::1"), F.lit("169.254.0.9")), (k % 4).cast("int"))).otherwise(web.host(F.col("url")))
    return tables.read(spark, sf, "pages").select("page_id", web.is_public_address(address).alias("public"))
