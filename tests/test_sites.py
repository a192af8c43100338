from pyspark.sql import functions as F

from lexmill.functions import html
from lexmill.operators import sites


def test_crawls_stop_for_their_reasons(spark):
    pages = spark.createDataFrame([("a1", "a2"), ("a2", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b4"), ("b4", None), ("c1", "gone"), ("e1", None), ("f1", "f2"), ("f2", "f3"), ("f3", "f4"), ("f4", "f5")], "url string, next string")
    links = spark.createDataFrame([("a1", "x"), ("a2", "y"), ("a2", "x"), ("b1", "x"), ("b2", "x"), ("b3", "x"), ("b4", "z"), ("c1", "x"), ("c1", None), *[(f"f{i}", f"n{i}") for i in range(1, 5)]], "url string, candidate string")
    seeds = spark.createDataFrame([(u, f"{u}1") for u in "abcdef"] + [("twin", "a1")], "crawl string, url string")
    visits, found = sites.traverse(seeds, pages, links, max_pages=3)
    told = {}
    for r in sorted(visits.collect(), key=lambda r: (r.crawl, r.nth)):
        told.setdefault(r.crawl, []).append((r.url, r.new, r.stop))
    assert told == {
        "a": [("a1", 1, None), ("a2", 1, "loop")],
        "twin": [("a1", 1, None), ("a2", 1, "loop")],
        "b": [("b1", 1, None), ("b2", 0, None), ("b3", 0, "no_new_articles")],
        "c": [("c1", 1, None), ("gone", 0, "pagination_failed")],
        "d": [("d1", 0, "list_failed")],
        "e": [("e1", 0, "no_next")],
        "f": [("f1", 1, None), ("f2", 1, None), ("f3", 1, "max_pages")],
    }
    assert sorted(tuple(r) for r in found.where("crawl = 'a'").collect()) == [("a", 0, "x"), ("a", 1, "y")]
    assert sites.traverse(seeds.limit(0), pages, links)[0].count() == 0


def test_the_longest_suffix_rules_and_own_settings_win(spark):
    hosts = spark.createDataFrame([("a.b.gov.cn",), ("b.gov.cn",), ("other.org",), ("xb.gov.cn",)], "host string")
    rules = spark.createDataFrame([("gov.cn", 1), ("b.gov.cn", 2)], "suffix string, rule int")
    assert {r.host: r.rule for r in sites.rules_of_hosts(hosts, rules).collect()} == {"a.b.gov.cn": 2, "b.gov.cn": 2, "xb.gov.cn": 1, "other.org": None}
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.lit(None).cast("map<string,string>")
    one = spark.range(1)
    got = one.select(sites.settings(m(a="list", b="list", mode="no"), m(b="paging"), F.lit(" "), F.lit("h"), m(host="own"))).first()[0]
    assert got == {"a": "list", "b": "paging", "mode": "html", "host": "own"}
    got = one.select(sites.selectors(m(title="mine"), m(list_link="li", link_selector=" "), m(title="rule", content="c", attachment="  ", x="y"))).first()[0]
    assert got == {"title": "mine", "list_link": "li", "content": "c"}
    assert one.select(sites.settings(m(), m(), F.lit(None).cast("string"), F.lit(None).cast("string"), m())).first()[0] == {"mode": "html"}


def test_deep_pages_are_walked_without_recursion():
    deep = "<div>" * 20_000 + "<p>bottom</p><a href='/x'>go</a>" + "</div>" * 20_000
    page = html.parse(f"<body>{deep}<nav>{deep}</nav><h2>Title</h2><p>after</p></body>")
    assert page["text"] == "bottom\n\n## Title\n\nafter" and [link["href"] for link in page["links"]] == ["/x"]
    assert html.parse("<table>" * 3000 + "<tr><td>x</td></tr>")["tables"]


PAGE = """<html><head><title>Site</title><meta property="og:title" content="OG"></head><body><nav><a href="/f.pdf">nav file</a></nav><h1>Main &amp; title</h1>
<div class="meta"><span class="date x">发布 2024年3月5日</span></div><div class="content"><p>One <b>two</b></p><div class="share">share</div><script>x()</script>
<a href="/files/a.PDF#p2">Annex</a><a href="/files/a.PDF">again</a><a href="b.docx"></a><a href="/c.html">page</a><img src="i.png" alt="An image"><img data-src="/j.png"><img src="i.png"></div></body></html>"""


def test_details_by_selectors():
    d = html.detail(PAGE, "https://h/d/")
    assert (d["title"], d["title_source"], d["content_source"], d["date_source"], d["publish_date"]) == ("Main & title", "h1", ".content", ".date", "发布 2024年3月5日")
    assert d["text"] == "One\ntwo\nAnnex\nagain\npage" and d["images"] == ["https://h/d/i.png", "https://h/j.png"] and d["alts"] == ["An image"]
    assert [(a["name"], a["url"], a["type"]) for a in d["attachments"]] == [("nav file", "https://h/f.pdf", "pdf"), ("Annex", "https://h/files/a.PDF", "pdf"), ("b.docx", "https://h/d/b.docx", "docx")]
    assert (d["method"], d["needs_ocr"], d["warnings"], d["fault"]) == ("image", True, ["SHORT_TEXT_WITH_ATTACHMENT", "OCR_REQUIRED"], None)
    own = html.detail(PAGE, "https://h/d/", {"title": "meta[property='og:title']", "content": "div .share", "attachment": "div.content a", "publish_date": " "})
    assert (own["title"], own["title_source"], own["text"], len(own["attachments"])) == ("OG", "meta[property='og:title']", "share", 2)
    assert html.detail(PAGE, "https://h/", {"title": "h1::before"})["fault"].startswith("unknown selector")


def test_details_that_are_none(spark):
    pages = {None: "no title", "<h1>T</h1><p>x</p>": "no content", "<h1> </h1><article>x</article>": "title or content is empty", "<h1>T</h1><article> </article>": "title or content is empty", "<h2>T</h2><main>x</main>": None}
    df = spark.createDataFrame([(p, None) for p in pages], "html string, url string")
    rows = df.select("html", html.extract_detail("html", "url", F.lit(None).cast("map<string,string>")).alias("d")).collect()
    assert {r.html: r.d.fault for r in rows} == pages and all(r.d.publish_date is None for r in rows)
