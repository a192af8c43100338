"""Registered queries: text functions, fingerprints, duplicates, quality rules, pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import html, web
from ..operators import quality
from ..registry import query
from ..sources import tables
from .retrieval import DOCS, toks


@query("token_counts", f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, len(list_distinct({toks('text')}))::BIGINT AS n_distinct FROM documents")
def token_counts(spark, sf):
    d = tables.documents(spark, sf).select("doc_id", T.tokens(F.col("content")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS raw_hash, sha256(regexp_replace(text, '\\s+', '', 'g')) AS content_hash FROM documents")
def content_hashes(spark, sf):
    d = tables.documents(spark, sf)
    return d.select("doc_id", F.sha2("content", 256).alias("raw_hash"), T.content_hash(F.col("content")).alias("content_hash"))


@query("exact_duplicates", "SELECT sha256(regexp_replace(text, '\\s+', '', 'g')) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    d = tables.documents(spark, sf)
    return d.groupBy(T.content_hash(F.col("content")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


SIMHASH = f"""tk AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1, 2),
 hs AS (SELECT doc_id, n, ('0x' || substr(sha256(token), 49, 8))::BIGINT AS h0, ('0x' || substr(sha256(token), 57, 8))::BIGINT AS h1 FROM tk),
 bits AS (SELECT doc_id, b, sum(n * (((h0 >> b) & 1) * 2 - 1)) AS v0, sum(n * (((h1 >> b) & 1) * 2 - 1)) AS v1 FROM hs, (SELECT unnest(range(32)) AS b) GROUP BY 1, 2),
 prints AS (SELECT d.doc_id, coalesce(sum(CASE WHEN v0 >= 0 THEN 1::BIGINT << b ELSE 0 END), 0)::BIGINT AS hi, coalesce(sum(CASE WHEN v1 >= 0 THEN 1::BIGINT << b ELSE 0 END), 0)::BIGINT AS lo FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY 1)"""


@query("token_simhash", f"WITH {SIMHASH} SELECT doc_id, hi, lo FROM prints")
def token_simhash(spark, sf):
    return T.token_simhash(tables.documents(spark, sf), "doc_id", "content")


@query("near_duplicate_pairs", f"WITH {SIMHASH}, k AS (SELECT hi, lo, min(doc_id) AS id FROM prints GROUP BY 1, 2) SELECT x.id AS a, y.id AS b, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::BIGINT AS distance FROM k x JOIN k y ON x.id < y.id WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3")
def near_duplicate_pairs(spark, sf):
    return quality.near_pairs(T.token_simhash(tables.documents(spark, sf), "doc_id", "content"), "doc_id")


@query("print_members", f"WITH {SIMHASH} SELECT doc_id, min(doc_id) OVER (PARTITION BY hi, lo) AS copy_of FROM prints")
def print_members(spark, sf):
    """Which document stands for each in ``near_duplicate_pairs``."""
    return quality.print_members(T.token_simhash(tables.documents(spark, sf), "doc_id", "content"), "doc_id")


@query(
    "authoritative_copies",
    """SELECT h AS content_hash, arg_max(doc_id, official::INT * 1000000000000 + n_chars * 1000000 + doc_id) AS authority_id, count(*) AS copies FROM (
 SELECT d.doc_id, d.n_chars, sha256(d.text) AS h, coalesce(l.quality = 1 AND l.toxic = 0, false) AS official FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""",
)
def authoritative_copies(spark, sf):
    d, labels = tables.documents(spark, sf), tables.read(spark, sf, "labels")
    copies = d.join(labels, "doc_id", "left").select("doc_id", "word_count", F.sha2("content", 256).alias("content_hash"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("official"), F.lit(0).alias("priority"), F.lit(None).cast("date").alias("publish_date"))
    return quality.authoritative(copies, "content_hash")


_hard, _title, _body = "len(trim(content)) < 40", "regexp_matches(title, '(?i)test page|page not found')", "regexp_matches(content, '(?i)access denied|captcha required')"
_soft, _topic = "len(trim(content)) < 180", "NOT regexp_matches(lower(title || chr(10) || content), 'policy|regulation|notice|support|application')"


@query(
    "rule_filter",
    f"""WITH {DOCS}, s AS (SELECT doc_id, content, title, coalesce(l.quality = 1 AND l.toxic = 0, false) AS official, {_hard} AS hard, {_title} AS bad_title, {_body} AS bad_body, {_soft} AS soft, {_topic} AS topic FROM docs LEFT JOIN labels l USING (doc_id)),
 r AS (SELECT *, hard OR bad_title OR bad_body AS out, CASE WHEN hard OR bad_title OR bad_body THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - CASE WHEN soft THEN 0.35 ELSE 0 END - CASE WHEN topic THEN 0.25 ELSE 0 END - CASE WHEN official THEN 0 ELSE 0.1 END, 4) END AS score FROM s)
 SELECT doc_id, score, CASE WHEN out OR score <= 0.25 THEN 'reject' WHEN score < 0.65 THEN 'review' ELSE 'accept' END AS decision,
  CASE WHEN hard THEN 'content_too_short_hard' WHEN bad_title THEN 'title_reject_pattern' WHEN bad_body THEN 'content_reject_pattern' ELSE array_to_string(list_filter([CASE WHEN soft THEN 'content_too_short_soft' END, CASE WHEN topic THEN 'relevance_keyword_missing' END, CASE WHEN NOT official THEN 'source_not_official' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM r""",
)
def rule_filter(spark, sf):
    d, labels = tables.documents(spark, sf), tables.read(spark, sf, "labels")
    official = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return d.join(labels, "doc_id", "left").select("doc_id", quality.rule_filter(F.col("title"), F.col("content"), official).alias("r")).select("doc_id", "r.*")


@query(
    "source_scores",
    """SELECT source AS source_name, count(*) AS documents, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS official_share, round(avg(n_chars), 6) AS mean_chars,
 round(0.35 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE) + 0.15 * least(count(DISTINCT lang) / 2.0::DOUBLE, 1) + 0.25 * avg(CASE WHEN n_chars >= 200 THEN 1.0 ELSE 0.0 END::DOUBLE) + 0.25 * least(avg(n_chars) / 400.0::DOUBLE, 1), 4) AS score
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def source_scores(spark, sf):
    d, labels = tables.documents(spark, sf), tables.read(spark, sf, "labels")
    official = F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))
    fetched = F.avg(F.when(F.col("word_count") >= 200, 1.0).otherwise(0.0))
    score = 0.35 * official + 0.15 * F.least(F.countDistinct("region") / 2.0, F.lit(1.0)) + 0.25 * fetched + 0.25 * F.least(F.avg("word_count") / 400.0, F.lit(1.0))
    return d.join(labels, "doc_id", "left").groupBy("source_name").agg(F.count("*").alias("documents"), F.round(official, 6).alias("official_share"), F.round(F.avg("word_count"), 6).alias("mean_chars"), F.round(score, 4).alias("score"))


@query(
    "text_scalars",
    """SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 220) AS quote, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk,
 substr(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) || '-' || substr(sha1(source), 1, 8) AS source_key,
 least(3600, (60 * pow(2, least(doc_id % 9, 6)))::INT)::BIGINT AS backoff FROM documents""",
)
def text_scalars(spark, sf):
    d = tables.documents(spark, sf)
    return d.select("doc_id", T.excerpt(F.col("content"), 220).alias("quote"), T.has_cjk(F.col("content")).alias("cjk"), T.slug_key(F.col("source_name")).alias("source_key"), T.backoff_seconds(F.col("doc_id") % 9).alias("backoff"))


@query("clean_texts")
def clean_texts(spark, sf):
    return T.clean_texts(tables.documents(spark, sf).select("doc_id", F.col("content").alias("cleaned")), "cleaned")


@query(
    "unique_paragraphs",
    """WITH p AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS parts FROM documents)),
 k AS (SELECT doc_id, place, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part, row_number() OVER (PARTITION BY doc_id, regexp_replace(part, '\\s+', '', 'g') ORDER BY place) AS nth FROM p WHERE regexp_replace(part, '\\s+', '', 'g') <> '')
 SELECT d.doc_id, count(place) FILTER (nth = 1) AS paragraphs, sha256(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY place) FILTER (nth = 1), '')) AS digest FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""",
)
def unique_paragraphs(spark, sf):
    d = tables.documents(spark, sf).select("doc_id", T.unique_paragraphs(F.col("content")).alias("t"))
    return d.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n\n"))).cast("long").alias("paragraphs"), F.sha2("t", 256).alias("digest"))


@query("parsed_pages")
def parsed_pages(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", "url", html.parse_html("html").alias("a"))
    tables_md = F.transform("a.tables", lambda t: t.markdown)
    return p.select("page_id", web.canonical_url(F.col("url")).alias("url"), F.length("a.text").alias("chars"), F.size("a.sections").alias("n_sections"), F.size("a.links").alias("n_links"), F.array_join(tables_md, "\n\n").alias("tables"))


@query("page_links", "SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY 1")
def page_links(spark, sf):
    p = tables.read(spark, sf, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links"))


_url = "^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
CANONICAL = f"""u AS (SELECT page_id, html, lower(regexp_extract(url, '{_url}', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '{_url}', 2)), ':(80|443)?$', '') AS host, regexp_replace(regexp_extract(url, '{_url}', 3), '/+', '/', 'g') AS path, regexp_extract(url, '{_url}', 4) AS q FROM pages),
 canonical AS (SELECT page_id, html, scheme, host, path, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_sort(kept), '&') END AS url
  FROM (SELECT *, list_filter(list_transform(string_split(q, '&'), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), lambda x: x <> '=' AND NOT regexp_matches(lower(x), '^(utm_|spm=|from=|source=)')) AS kept FROM u))"""
_paths = ", ".join(f"'{x}'" for x in web.ARTICLE_PATHS)
_score = f"least(6, 2 * len(list_filter([{_paths}], lambda t: contains(lower(path), t)))) + CASE WHEN regexp_matches(lower(path), '{web.DATE_PATH}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '{web.NUMERIC_ID}') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(lower(path), '/list|index[.]|newschild|common_list') THEN 4 ELSE 0 END"


@query("canonical_pages", f"WITH {CANONICAL} SELECT url, min(page_id) AS page_id, count(*) AS pages, ({_score} - 1)::BIGINT AS link_score FROM canonical GROUP BY url, path")
def canonical_pages(spark, sf):
    """Pages by canonical URL, the smallest id of each kept, with how many were folded and how article-like a bare link to it is."""
    p = tables.read(spark, sf, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages")).withColumn("link_score", web.link_score(F.col("url"), F.lit("")))


_bytes = "list_transform(range(1, 65), lambda i: ('0x' || substr(d, (2 * ((i - 1) % 32) + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1)"


@query("token_embedding", f"SELECT item_id, round(len(v) * 1.0::DOUBLE, 6) AS size, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first, round(v[8], 6) AS eighth, round(v[64], 6) AS last FROM (SELECT item_id, list_transform(v, lambda x: x / n) AS v FROM (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT item_id, {_bytes} AS v FROM (SELECT item_id, sha256(text) AS d FROM benchmark))))")
def token_embedding(spark, sf):
    """The deterministic stand-in embedding of 64 numbers."""
    b = tables.read(spark, sf, "benchmark").select("item_id", T.digest_embedding(F.col("text"), 64).alias("v"))
    return b.select("item_id", F.size("v").cast("double").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), *[F.round(F.element_at("v", k), 6).alias(n) for k, n in ((1, "first"), (8, "eighth"), (64, "last"))])
