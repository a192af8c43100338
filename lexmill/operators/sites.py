"""Crawling over stored pages: list pages walked in rounds, and rules of sites merged by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def traverse(seeds: DataFrame, pages: DataFrame, links: DataFrame, max_pages: int = 10, stop_after: int = 2) -> tuple[DataFrame, DataFrame]:
    """Visits (crawl, nth, url, new, stop) and candidates (crawl, nth, candidate) of crawls (crawl, url) over stored pages (url, next) and their links (url, candidate).

    All crawls take one page a round: what a page links to counts as new where the crawl has not seen it. A crawl stops, and its last visit says why, where a
    page is not stored (``list_failed`` for the first, else ``pagination_failed``), ``stop_after`` pages in a row have nothing new (``no_new_articles``), nothing is next
    (``no_next``), the next page was visited (``loop``), or ``max_pages`` were taken. Only the frontier is joined, and what a round adds goes to the seen ones.
    """
    frontier = stored(seeds.select("crawl", "url", F.lit(0).alias("idle")), "frontier")
    candidates = links.select("url", "candidate").where("candidate is not null").distinct()
    visits, seen = [], None
    for nth in range(max_pages):
        at = frontier.join(pages.select("url", F.lit(True).alias("there"), "next"), "url", "left")
        fresh = at.where("there").select("crawl", "url").join(candidates, "url").select("crawl", "candidate").distinct()
        fresh = stored((fresh if seen is None else fresh.join(seen, ["crawl", "candidate"], "left_anti")).withColumn("nth", F.lit(nth)), "candidates")
        seen = fresh if seen is None else seen.unionByName(fresh)
        told = at.join(fresh.groupBy("crawl").agg(F.count("*").alias("new")), "crawl", "left").withColumn("new", F.coalesce("new", F.lit(0)))
        told = told.withColumn("idle", F.when(F.col("new") > 0, 0).otherwise(F.col("idle") + 1)).withColumn("nth", F.lit(nth))
        before = reduce(DataFrame.unionByName, [v.select("crawl", F.col("url").alias("next"), F.lit(True).alias("again")) for v in visits] + [told.select("crawl", F.col("url").alias("next"), F.lit(True).alias("again"))])
        stop = (
            F.when(F.col("there").isNull(), "pagination_failed" if nth else "list_failed")
            .when(F.col("idle") >= stop_after, "no_new_articles")
            .when(F.col("next").isNull(), "no_next")
            .when(F.col("again"), "loop")
            .when(F.lit(nth + 1 == max_pages), "max_pages")
        )
        visited = stored(told.join(before, ["crawl", "next"], "left").withColumn("stop", stop), "visits")
        visits.append(visited)
        frontier = visited.where("stop is null").select("crawl", F.col("next").alias("url"), "idle")
        if frontier.isEmpty():
            break
    every = reduce(DataFrame.unionByName, visits)
    return every.select("crawl", "nth", "url", "new", "stop"), seen.select("crawl", "nth", "candidate")


def suffixes(host: Column) -> Column:
    """A host and all that it is below, longest first."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (host) with the columns of the rule (suffix, ...) of the longest suffix of each; nulls where there is none. Suffixes are unique."""
    tried = hosts.select("host").distinct().select("host", F.posexplode(suffixes(F.col("host"))).alias("nth", "suffix"))
    known = tried.join(rules.select("suffix"), "suffix").groupBy("host").agg(F.min_by("suffix", "nth").alias("suffix"))
    return hosts.join(known, "host", "left").join(rules, "suffix", "left")


def overlaid(*maps: Column) -> Column:
    """One map of all; of equal keys the last map's value stays, of null maps nothing."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)
    return reduce(over, (F.coalesce(m, empty) for m in maps))


def settings(listing: Column, paging: Column, mode: Column, suffix: Column, own: Column) -> Column:
    """How a source is paged: a rule's hints on lists, then on paging, then its mode and host; what the source itself says comes last."""
    kind = F.coalesce(F.nullif(F.trim(mode), F.lit("")), F.lit("html"))
    fixed = F.map_filter(F.map_from_arrays(F.array(F.lit("mode"), F.lit("host")), F.array(kind, suffix)), lambda k, v: v.isNotNull())
    return overlaid(listing, paging, fixed, own)


def selectors(own: Column, listing: Column, detail: Column) -> Column:
    """A source's selectors; a rule's fill in only what it leaves out, and blank ones nothing."""
    said = lambda m: F.map_filter(m, lambda k, v: F.trim(v) != "")
    listed = F.coalesce(F.try_element_at(said(listing), F.lit("link_selector")), F.try_element_at(said(listing), F.lit("list_link")))
    link = F.map_filter(F.map_from_arrays(F.array(F.lit("list_link")), F.array(listed)), lambda k, v: v.isNotNull())
    parts = F.map_filter(said(detail), lambda k, v: k.isin("title", "content", "publish_date", "attachment"))
    return overlaid(link, parts, own)
