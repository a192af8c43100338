"""Registered queries: crawls over the stored pages of each site, and the rules of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import web
from ..operators import sites
from ..registry import query
from ..sources import tables

#: The stored pages of a host are its list pages, each followed by the next by id and the last by the first.
_host = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
CRAWL = f"""p AS (SELECT page_id, url, {_host} AS host, html FROM pages), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS nth, count(*) OVER (PARTITION BY host) AS n FROM p),
 c AS (SELECT DISTINCT host, nth, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM o), f AS (SELECT host, href, min(nth) AS first FROM c GROUP BY 1, 2),
 w AS (SELECT o.host, o.nth, o.url, o.n, (SELECT count(*) FROM f WHERE f.host = o.host AND f.first = o.nth) AS new FROM o),
 i AS (SELECT *, new = 0 AND nth > 0 AND coalesce(lag(new) OVER (PARTITION BY host ORDER BY nth), 1) = 0 AS idle FROM w),
 s AS (SELECT *, CASE WHEN idle THEN 'no_new_articles' WHEN nth + 1 = n THEN 'loop' WHEN nth = 4 THEN 'max_pages' END AS stop FROM i),
 kept AS (SELECT * FROM s WHERE nth <= (SELECT min(nth) FROM s t WHERE t.host = s.host AND t.stop IS NOT NULL))"""


def _crawled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = tables.read(spark, sf, "pages").select("page_id", "url", "html", web.host(F.col("url")).alias("crawl"))
    order = Window.partitionBy("crawl").orderBy("page_id")
    first = F.min_by("url", "page_id")
    of_host = p.groupBy("crawl").agg(first.alias("url"))
    after = p.select("crawl", "url", F.lead("url").over(order).alias("later")).join(of_host.withColumnRenamed("url", "start"), "crawl")
    links = p.select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("candidate"))
    return sites.traverse(of_host, after.select("url", F.coalesce("later", "start").alias("next")), links, max_pages=5)


@query("crawled_lists", f"WITH {CRAWL} SELECT host AS crawl, nth::INT AS nth, url, new, stop FROM kept")
def crawled_lists(spark, sf):
    """The walk through each site's list pages: what was new on each, and why it ended."""
    return _crawled(spark, sf)[0]


@query("crawled_candidates", f"WITH {CRAWL} SELECT host AS crawl, first::INT AS nth, href AS candidate FROM f WHERE EXISTS (SELECT 1 FROM kept WHERE kept.host = f.host AND kept.nth = f.first)")
def crawled_candidates(spark, sf):
    """Each site's links and the list page that had them first."""
    return _crawled(spark, sf)[1]


#: A rule for each parent of a host that several hosts have in common, made of what its pages show.
RULES = f"""h AS (SELECT DISTINCT {_host} AS host FROM pages), x AS (SELECT host, unnest(generate_series(1, len(string_split(host, '.')))) AS nth, string_split(host, '.') AS parts FROM h),
 t AS (SELECT host, nth, array_to_string(parts[nth:], '.') AS suffix FROM x), r AS (SELECT suffix, count(*) AS hosts FROM t GROUP BY 1 HAVING count(*) > 1),
 m AS (SELECT host, arg_min(suffix, nth) AS suffix FROM t JOIN r USING (suffix) GROUP BY 1)"""


@query("site_rules", f"WITH {RULES} SELECT h.host, CASE WHEN r.suffix IS NULL THEN 'mode=html,page=own' ELSE 'host=' || r.suffix || ',limit=' || hosts || ',mode=' || CASE WHEN hosts > 2 THEN 'api' ELSE 'html' END || ',page=own' END AS settings, CASE WHEN r.suffix IS NULL THEN 'title=h2' ELSE 'content=#' || r.suffix || ',list_link=a.' || hosts || ',title=h2' END AS selectors FROM h LEFT JOIN m USING (host) LEFT JOIN r ON r.suffix = m.suffix")
def site_rules(spark, sf):
    """Settings and selectors of every host under the rule of its longest known suffix; what the host has itself comes before."""
    hosts = tables.read(spark, sf, "pages").select(web.host(F.col("url")).alias("host")).distinct()
    common = hosts.select(F.explode(sites.suffixes(F.col("host"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("hosts")).where("hosts > 1")
    n, pair = F.col("hosts").cast("string"), lambda *kv: F.map_from_arrays(F.array(*map(F.lit, kv[::2])), F.array(*kv[1::2]))
    rules = common.select("suffix", pair("limit", n, "page", F.lit("rule"), "mode", F.lit("x")).alias("listing"), pair("page", F.lit("paging")).alias("paging"), F.when(F.col("hosts") > 2, "api").otherwise(" ").alias("mode"), pair("link_selector", F.concat(F.lit("a."), n)).alias("links"), pair("title", F.lit("h1"), "content", F.concat(F.lit("#"), "suffix"), "publish_date", F.lit(" "), "else", F.lit("x")).alias("detail"))
    found = sites.rules_of_hosts(hosts, rules)
    show = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return found.select("host", show(sites.settings(F.col("listing"), F.col("paging"), F.col("mode"), F.col("suffix"), pair("page", F.lit("own")))).alias("settings"), show(sites.selectors(pair("title", F.lit("h2")), F.coalesce("links", pair("none", F.lit(""))), F.coalesce("detail", pair("none", F.lit(""))))).alias("selectors"))
