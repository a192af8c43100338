"""Literal rows for text, chunk, routing, rule, URL and HTML functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import html, web
from lexmill.functions import text as T
from lexmill.operators import answers, chunking, quality


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_chunks_of_a_heading_and_sentences():
    config = chunking.ChunkConfig(30, 10, 45, 5)
    got = chunking.chunks("第一章 申报条件\n" + "企业应当具备法人资格。" * 10, config)
    assert len(got) > 1 and all(c["char_count"] <= 45 for c in got)
    assert got[0]["section_title"] == "第一章 申报条件" and got[0]["section_path"] == ["第一章 申报条件"]
    assert [c["chunk_index"] for c in got] == list(range(len(got)))


def test_chunk_paths_and_packing():
    got = chunking.chunks("intro\n\nmore\n# A\nbody a\n## B\nbody b\n# C\n1.2. numbered\nx")
    assert [(c["section_path"], c["content"]) for c in got] == [
        ([], "intro\n\nmore"),
        (["A"], "A\nbody a"),
        (["A", "B"], "B\nbody b"),
        (["C"], "C"),
        (["1.2. numbered"], "1.2. numbered\nx"),
    ]
    assert chunking.chunks(None) == chunking.chunks(" \n ") == []
    text = "\n\n".join("w" * 300 for _ in range(6))
    sizes = [c["char_count"] for c in chunking.chunks(text)]
    assert sizes == [602, 724, 724]
    long = chunking.chunks("a" * 5000)
    assert all(c["char_count"] <= 1200 for c in long) and long[1]["content"].startswith("a" * 120)
    with pytest.raises(ValueError):
        chunking.ChunkConfig(overlap=800)


def test_chunk_ids_and_attachment_pages(spark):
    docs = spark.createDataFrame([(1, "# A\nx"), (2, "")], "doc_id long, content string")
    files = spark.createDataFrame([(1, 7, "f.pdf", "one\ftwo", None), (1, 8, "g.txt", "three", None), (2, 9, "h", None, 1)], "doc_id long, attachment_id long, attachment_name string, parsed_text string, page_count int")
    rows = chunking.chunk_documents(docs, attachments=files).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.attachment_id, r.page_number, r.chunk_index, r.section_path, r.content) for r in rows] == [(1, None, None, 0, ["A"], "A\nx"), (1, 7, 1, 1, ["f.pdf"], "one"), (1, 7, 2, 2, ["f.pdf"], "two"), (1, 8, None, 3, ["g.txt"], "three")]
    again = {r.chunk_id for r in chunking.chunk_documents(docs, attachments=files).collect()}
    assert again == {r.chunk_id for r in rows} and len(again) == 4
    assert again.isdisjoint(r.chunk_id for r in chunking.chunk_documents(docs, attachments=files, version="2").collect())


def test_cleaning(spark):
    texts = ["Ａ　b\t c\r\n打印本页\r\n\n\n x \n\nA b c\n\n责任编辑：某人\nend", None, "", "p\n\nq\n\np \n\n q", "line\nline\n\nline"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.x for r in T.clean_texts(rows, "x").orderBy("i").collect()]
    assert got == ["A b c\n\nx\n\nend", None, "", "p\n\nq", "line\nline\n\nline"]


def test_excerpts(spark):
    assert column(spark, ["  a  b ", "one two three", "abcdefgh", " x" * 9], lambda c: T.compact_excerpt(c, 7)) == ["a b", "one", "abcdefg", "x x x"]


def test_routes_and_filters(spark):
    asked = ["四川 2022年之后 有多少份政策？", "explain the documents before 2020", "how many documents", "罚款多少", "how many documents, explain", "晚于2021 北京", "total notices"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, x string").select("i", answers.inferred_filters(F.col("x")).alias("f"), "x")
    any_filter = F.coalesce(F.col("f.publish_date_gte").cast("string"), F.col("f.publish_date_lte").cast("string"), F.col("f.region")).isNotNull()
    got = rows.select("i", answers.route(F.col("x"), any_filter).alias("r"), "f.*").orderBy("i").collect()
    assert [r.r for r in got] == ["sql", "sql+rag", "sql", "rag", "sql+rag", "rag", "rag"]
    assert (got[0].region, got[1].publish_date_lte, got[5].publish_date_gte, got[5].region) == ("四川省", datetime.date(2019, 12, 31), datetime.date(2022, 1, 1), "北京")
    with pytest.raises(ValueError, match="unsupported"):
        answers.checked_filters({"region": "x", "owner": 1})
    table = spark.createDataFrame([(1, "北京", datetime.date(2024, 5, 1)), (2, "北京", None), (3, "上海", datetime.date(2024, 5, 1))], "id int, region string, publish_date date")
    assert [r.id for r in table.where(answers.structured_filter({"region": "北京", "publish_date_gte": "2024-01-01", "publish_date_lte": "2024-05-01"})).collect()] == [1]
    one = answers.applied_filters(F.lit("beijing after 2020"), {"region": "上海", "city": "x"})
    assert spark.range(1).select(one.alias("f")).first().f.asDict() == {"publish_date_gte": datetime.date(2021, 1, 1), "publish_date_lte": None, "region": "上海", "city": "x"}
    payload = spark.createDataFrame([({"publish_date": "2024-01-01", "k": "1"},), ({"k": "1"},)], "p map<string,string>")
    assert payload.where(answers.payload_filter(F.col("p"), {"publish_date_gte": "2023", "k": 1})).count() == 1


def test_rule_filter(spark):
    rows = [("t", "x" * 39, True), ("Page Not Found", "y" * 200, True), ("t", "Access denied " + "z" * 200, True), ("t", "policy " + "a" * 200, True), ("t", "a" * 60, False), ("t", "a" * 200, False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string, o boolean")
    got = [tuple(r.r) for r in frame.select("i", quality.rule_filter(F.col("t"), F.col("c"), F.col("o")).alias("r")).orderBy("i").collect()]
    assert got == [(0.0, "reject", "content_too_short_hard"), (0.0, "reject", "title_reject_pattern"), (0.0, "reject", "content_reject_pattern"), (1.0, "accept", ""), (0.3, "review", "content_too_short_soft,relevance_keyword_missing,source_not_official"), (0.65, "accept", "relevance_keyword_missing,source_not_official")]


def test_canonical_urls(spark):
    urls = [" HTTP://Example.COM.:80//a//b?utm_x=1&b=2&a=&SPM=3&c=x%20y+z&d=~*#top", "https://h", "https://h:8443?x", "ftp://h/a", "http://u:p@h/", "http://h:99999/", "http://[::1]:80/x", None, "nothing", "http://h/?q=%zz&é=ü"]
    assert column(spark, urls, web.canonical_url) == ["http://example.com/a/b?a=&b=2&c=x+y+z&d=~%2A", "https://h/", "https://h:8443/?x=", None, None, None, "http://[::1]/x", None, None, "http://h/?q=%25zz&%C3%A9=%C3%BC"]


def test_hosts_and_addresses(spark):
    assert column(spark, ["10.0.0.1", "8.8.8.8", "::1", "127.0.0.1", "169.254.1.1", "224.0.0.1", "::ffff:10.0.0.1", "name"], web.is_public_address) == [False, True, False, False, False, False, False, None]
    assert column(spark, ["a.gov.cn", "gov.cn", "xgov.cn", "b.edu"], lambda c: web.trusted_suffix(c, (".gov.cn", "edu"))) == [".gov.cn", ".gov.cn", None, ".edu"]
    assert column(spark, ["a.b.c", "b.c", "x.c"], lambda c: web.same_site(c, F.lit("b.c"))) == [True, True, False]


def test_links(spark):
    urls = ["http://h/art/2024/01/02/1234.html", "http://h/list/index.html", "http://h/", "http://h/news/12345"]
    assert column(spark, urls, lambda c: web.link_score(c, F.lit("关于通知的公告"))) == [8, -2, 2, 5]
    assert column(spark, ["http://h/a?page=3", "http://h/a", "http://h/a?PageNum=x"], web.page_number) == [3, None, None]
    assert column(spark, ["http://h/a.PDF?x=1", "http://h/a.b/c", "http://h"], web.extension) == [".pdf", "", ""]
    links = [[("http://h/3", "3", "", ""), ("http://h/2?page=2", "Next >", "", "")], [("http://h/l?page=5", "5", "", ""), ("http://h/l?page=4", "4", "", "")], [("http://h/x", "x", "next", "")], []]
    rows = spark.createDataFrame([(i, "http://h/l?page=3&k=v", x) for i, x in enumerate(links)], "i int, u string, l array<struct<href:string,text:string,rel:string,aria:string>>")
    rows = rows.select("i", "u", F.transform("l", lambda x: x.withField("n", web.page_number(x["href"]))).alias("l"))
    assert [r.n for r in rows.select("i", web.next_page(F.col("u"), F.col("l")).alias("n")).orderBy("i").collect()] == ["http://h/2?page=2", "http://h/l?page=4", "http://h/x", "http://h/l?k=v&page=4"]
    assert column(spark, ['{"a": 1}', "<div class='x detail'>", "<a href='/'>", "<script>", "text"], lambda c: web.page_kind(c, F.lit("text/html"))) == ["json_api", "html_detail_or_mixed", "html_list_or_navigation", "spa_shell", "unknown"]


PAGE = """<html><body><nav><a href="/n">n</a></nav><main><h1>Title</h1><p>One <b>two</b><p>three<ul><li>a<li>b</ul>
<table><tr><td>1</td><td>x|y</td></tr><tr><td>2</td><td>3</td><td>4</td></tr></table><h2>Sub</h2><table><tr><th>k</th></tr><tr><td><p>v</p></td></tr></table><a href="/l">go</a></main><p>outside</p></body></html>"""


def test_html_parse():
    a = html.parse(PAGE)
    first = "| column_1 | column_2 | column_1 |\n| --- | --- | --- |\n| 1 | x\\|y |  |\n| 2 | 3 | 4 |"
    assert a["text"] == f"# Title\n\nOne two\n\nthree\n\n- a\n\n- b\n\n{first}\n\n## Sub\n\n| k |\n| --- |\n| v |"
    assert [(s["title"], s["level"]) for s in a["sections"]] == [("Title", 1), ("Sub", 2)]
    assert a["links"] == [{"text": "go", "href": "/l"}]
    assert html.parse(None)["text"] == ""


def test_markdown_table_columns(spark):
    rows = spark.createDataFrame([(["a"], [["1", "2|3"], [None]])], "h array<string>, r array<array<string>>")
    assert rows.select(html.markdown_table(F.col("h"), F.col("r")).alias("m")).first().m == "| a | column_1 |\n| --- | --- |\n| 1 | 2\\|3 |\n|  |  |"
