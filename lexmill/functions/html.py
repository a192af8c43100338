"""HTML pages as text, sections, tables and links: one Arrow-batched UDF over a small tree, and Markdown tables as columns."""

from __future__ import annotations

import os
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Elements that hold no content, roots of content, elements without an end.
SKIPPED = {"script", "style", "noscript", "nav", "footer", "header", "form", "aside"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_block = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Starting one of these ends an open element of the kinds beside it.
_ends = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_heading = re.compile("h[1-6]$")


class Node:
    __slots__ = ("tag", "attrs", "inner")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.inner = tag, attrs, []

    def walk(self):
        """Nodes below in document order. Pages nest as deep as they like, so nothing here recurses."""
        rest = self.inner[::-1]
        while rest:
            if isinstance(x := rest.pop(), Node):
                yield x
                rest.extend(reversed(x.inner))

    def strings(self):
        rest = self.inner[::-1]
        while rest:
            if isinstance(x := rest.pop(), Node):
                rest.extend(reversed(x.inner))
            elif x.strip():
                yield x.strip()

    def text(self) -> str:
        return " ".join(self.strings())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]
        self.kinds = Counter()

    def _close(self):
        self.kinds[self.open.pop().tag] -= 1

    def handle_starttag(self, tag, attrs):
        if tag in _block:
            self.handle_endtag("p")
        for kind in _ends.get(tag, ()):
            if self.open[-1].tag == kind:
                self._close()
        node = Node(tag, dict(attrs))
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.kinds[tag] += 1

    def handle_endtag(self, tag):
        if self.kinds[tag]:
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.open[-1].inner.append(data)


def _prune(node: Node) -> None:
    rest = [node]
    while rest:
        node = rest.pop()
        node.inner = [x for x in node.inner if not (isinstance(x, Node) and x.tag in SKIPPED)]
        rest += [x for x in node.inner if isinstance(x, Node)]


def _is_root(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("id") == "UCAP-CONTENT" or "pages_content" in (node.attrs.get("class") or "").split()


def table_rows(table: Node) -> tuple[list[str], list[list[str]]]:
    """Headers and rows; without a header cell columns are numbered."""
    rows = [[c.text() for c in row.walk() if c.tag in ("th", "td")] for row in table.walk() if row.tag == "tr"]
    if not rows:
        return [], []
    if any(n.tag == "th" for n in table.walk()):
        return rows[0], rows[1:]
    return [f"column_{i + 1}" for i in range(len(rows[0]))], rows


def markdown(headers: list[str], rows: list[list[str]]) -> str:
    width = max([len(headers), *map(len, rows)])
    if not width:
        return ""
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ").strip()
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    names = headers + [f"column_{i + 1}" for i in range(width)][: width - len(headers)]
    return "\n".join([line(names), line(["---"] * width), *(line(r + [""] * (width - len(r))) for r in rows)])


def parse(html: str | None) -> dict:
    """Text in Markdown, sections under headings, tables and links of a page's content root."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    page = tree.open[0]
    rels = [{"href": n.attrs["href"], "text": n.text(), "rel": n.attrs.get("rel") or "", "aria": n.attrs.get("aria-label") or ""} for n in page.walk() if n.tag in ("a", "link") and n.attrs.get("href")]
    _prune(page)
    every = list(page.walk())
    root = next((n for n in every if _is_root(n)), None) or next((n for n in every if n.tag == "body"), page)
    parts, sections, tables, now = [], [], [], [None, 0, []]

    def close():
        if now[0] is not None or now[2]:
            sections.append({"title": now[0], "level": now[1], "text": "\n".join(now[2]).strip()})

    rest = [(x, False) for x in reversed(root.inner)]
    while rest:
        x, in_table = rest.pop()
        if isinstance(x, Node):
            if _heading.match(x.tag):
                close()
                now[:] = [x.text(), int(x.tag[1]), []]
                parts.append("#" * now[1] + " " + now[0])
            elif x.tag == "table":
                headers, rows = table_rows(x)
                if shown := markdown(headers, rows) if headers or rows else "":
                    tables.append({"headers": headers, "rows": rows, "markdown": shown})
                    now[2].append(shown)
                    parts.append(shown)
            elif x.tag in ("p", "li") and not in_table and (said := x.text()):
                said = f"- {said}" if x.tag == "li" else said
                now[2].append(said)
                parts.append(said)
            rest.extend((y, in_table or x.tag == "table") for y in reversed(x.inner))
    close()
    links = [{"text": n.text(), "href": n.attrs["href"]} for n in root.walk() if n.tag == "a" and n.attrs.get("href") is not None]
    return {"text": "\n\n".join(parts), "sections": sections, "tables": tables, "links": links, "page_links": rels}


#: Where a page's title, content and date are, first ones first, and what is no content within it.
TITLES = ("h1", "h2", "meta[property='og:title']", "title")
CONTENTS = ("article", "main", "[role='main']", ".article", ".content", ".detail", ".TRS_Editor", ".pages_content", ".article-content", ".news-content", "#UCAP-CONTENT", "#content")
DATES = ("time", "meta[property='article:published_time']", ".date", ".time")
NOISE = "script,style,noscript,nav,header,footer,aside,form,.share,.print,.related,.pager,.pagination"
ATTACHMENTS = frozenset(".pdf .doc .docx .xls .xlsx .zip .rar".split())
_part = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]")


def selector(text: str):
    """A test of (node, parents) for a list of selectors: tags, classes, ids and attributes, and what is below what. An unknown form is a ValueError."""

    def compound(word: str):
        tests, at = [], 0
        for m in _part.finditer(word):
            if m.start() != at:
                break
            at = m.end()
            tests.append(m.groupdict())
        if at != len(word) or not tests:
            raise ValueError(f"unknown selector {text!r}")
        return tests

    def fits(node: Node, tests) -> bool:
        have = lambda k: node.attrs.get(k) or ""
        return all(
            t["tag"] in (node.tag, "*") if t["tag"] else t["cls"] in have("class").split() if t["cls"] else t["id"] == have("id") if t["id"] else t["attr"] in node.attrs and t["value"] in (None, have(t["attr"]))
            for t in tests
        )

    chains = [[compound(w) for w in one.split()] for one in text.split(",") if one.strip()]
    if not chains:
        raise ValueError("an empty selector")

    def test(node: Node, parents: dict[int, Node]) -> bool:
        for *above, last in chains:
            if fits(node, last):
                while above and (node_above := parents.get(id(node))) is not None:
                    node = node_above
                    if fits(node, above[-1]):
                        above = above[:-1]
                if not above:
                    return True
        return False

    return test


def _first(nodes: list[Node], parents: dict[int, Node], selectors: list[str]) -> tuple[Node | None, str | None]:
    for s in selectors:
        test = selector(s)
        for n in nodes:
            if test(n, parents):
                return n, s
    return None, None


def detail(html: str | None, url: str | None, own: dict[str, str] | None = None) -> dict:
    """What a detail page says, and which selector told it: a source's own first, then the usual ones.

    Without a title or content element, with an empty title, or with neither text, attachment nor image, ``fault`` says so. Links count once by their address.
    """
    own = {k: v for k, v in (own or {}).items() if v and v.strip()}
    out = dict.fromkeys(DETAIL.names)
    try:
        tree = _Tree()
        tree.feed(html or "")
        tree.close()
        page = tree.open[0]
        nodes = list(page.walk())
        parents = {id(x): n for n in [page, *nodes] for x in n.inner if isinstance(x, Node)}
        pick = lambda key, usual: _first(nodes, parents, [*([own[key]] if key in own else []), *usual])
        (title, out["title_source"]), (content, out["content_source"]), (date, out["date_source"]) = pick("title", TITLES), pick("content", CONTENTS), pick("publish_date", DATES)
        linked = selector(own.get("attachment", "a"))
    except ValueError as error:
        return out | {"fault": str(error)}
    if title is None or content is None:
        return out | {"fault": "no title" if title is None else "no content"}
    said = lambda n: ((n.attrs.get("content") or "") if n.tag == "meta" else n.text()).strip()
    out["title"], out["publish_date"] = said(title), said(date) if date else None
    attachments: dict[str, dict] = {}
    for n in nodes:
        if n.attrs.get("href") and linked(n, parents):
            try:
                at = urldefrag(urljoin(url or "", n.attrs["href"])).url
            except ValueError:
                continue
            kind = os.path.splitext(urlsplit(at).path)[1].lower()
            if kind in ATTACHMENTS:
                attachments.setdefault(at, {"name": n.text() or at.rsplit("/", 1)[-1], "url": at, "type": kind[1:]})
    noise = selector(NOISE)
    gone = {id(n) for n in content.walk() if noise(n, parents)}
    strings, images, rest = [], {}, content.inner[::-1]
    while rest:
        x = rest.pop()
        if not isinstance(x, Node):
            strings += [x.strip()] if x.strip() else []
        elif id(x) not in gone:
            rest.extend(reversed(x.inner))
            if x.tag == "img" and (src := (x.attrs.get("src") or x.attrs.get("data-src") or "").strip()):
                images.setdefault(urljoin(url or "", src), (x.attrs.get("alt") or "").strip())
    text = "\n".join(strings)
    few, least = len(text) < 300, len(text) < 120
    out |= {"text": text, "attachments": list(attachments.values()), "images": list(images), "alts": [a for a in images.values() if a]}
    out |= {"method": ("image" if least else "mixed") if images else "html", "needs_ocr": bool(images) and few}
    out["warnings"] = ["SHORT_TEXT_WITH_ATTACHMENT"] * bool(attachments and few) + ["OCR_REQUIRED"] * bool(images and few)
    if not out["title"] or not (text or attachments or images):
        out["fault"] = "title or content is empty"
    return out


def _struct(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


_s, _strings = StringType(), ArrayType(StringType())
PARSED = _struct(
    text=_s,
    sections=ArrayType(_struct(title=_s, level=IntegerType(), text=_s)),
    tables=ArrayType(_struct(headers=_strings, rows=ArrayType(_strings), markdown=_s)),
    links=ArrayType(_struct(text=_s, href=_s)),
    page_links=ArrayType(_struct(href=_s, text=_s, rel=_s, aria=_s)),
)


DETAIL = _struct(
    title=_s, title_source=_s, text=_s, content_source=_s, publish_date=_s, date_source=_s,
    attachments=ArrayType(_struct(name=_s, url=_s, type=_s)), images=_strings, alts=_strings, method=_s, needs_ocr=BooleanType(), warnings=_strings, fault=_s,
)


@F.pandas_udf(DETAIL)
def extract_detail(html: pd.Series, url: pd.Series, own: pd.Series) -> pd.DataFrame:
    """``detail`` of pages, their addresses and a source's own selectors (map<string,string>)."""
    return pd.DataFrame([detail(*row) for row in zip(html, url, own, strict=True)], columns=DETAIL.names)


@F.pandas_udf(PARSED)
def parse_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(html.map(parse)), columns=PARSED.names)


def markdown_table(headers: Column, rows: Column) -> Column:
    """A Markdown table; short rows are filled up, headers numbered where rows are longer, pipes escaped."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("column_"), i.cast("string")))
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    filled = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    names = F.slice(F.concat(headers, numbers), F.lit(1), width)
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(width == 0, "").otherwise(F.array_join(F.concat(F.array(line(names), rule), F.transform(rows, lambda r: line(filled(r)))), "\n"))
