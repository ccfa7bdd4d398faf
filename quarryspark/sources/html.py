"""HTML pages: metadata by expressions, main text by a parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import absolute

# What is no content, where content stands, and how long parts may be.
_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "nav", "aside", "footer", "header", "form", "button", "dialog"}
_CHROME = ("ad", "ads", "advert", "cookie", "banner", "breadcrumb", "sidebar", "menu", "share", "related", "promo", "newsletter")
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MAIN = ("article", "main", "[role=main]", "#content", ".content", ".post", ".entry-content", "#main", ".markdown-body", ".prose", "body")
_DATES = ("article:published_time", "date", "pubdate", "publish-date", "datepublished")
TITLE, DESCRIPTION, ALT, IMAGES, LINKS, LEAST, PARAGRAPH, MOST_LINKS = 300, 600, 300, 12, 2000, 200, 120, 0.9


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)

    def fits(self, selector: str) -> bool:
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == ".":
            return selector[1:] in self.attrs.get("class", "").split()
        return self.attrs.get("role") == "main" if selector[0] == "[" else self.tag == selector

    def chrome(self) -> bool:
        return self.tag in _SKIP or any(c in _CHROME for c in self.attrs.get("class", "").lower().split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {})
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    try:
        t.feed(html or "")
        t.close()
    except AssertionError:  # the parser's own checks on malformed declarations
        pass
    return t.top


def stripped(top: Node) -> Node:
    """The tree without what is no content."""
    for node in list(top.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or not c.chrome()]
    return top


def main_content(top: Node) -> Node:
    """The part with most text that isn't links, paragraphs counting more; of nested parts the one whose selector comes first."""
    found: list[Node] = []
    nodes = list(top.walk())
    for selector in _MAIN:
        for node in nodes:
            if node.tag and node.fits(selector):
                up, inside = node.parent, False
                while up is not None and not inside:
                    inside, up = any(up is f for f in found), up.parent
                if not inside and not any(node is f for f in found):
                    found.append(node)
    best, most = None, -1.0
    for node in found:
        n = len(node.text())
        if n < LEAST:
            continue
        inner = list(node.walk())
        links = sum(len(a.text()) for a in inner if a.tag == "a")
        score = n * (1 - min(MOST_LINKS, links / n)) + PARAGRAPH * sum(x.tag == "p" for x in inner)
        if score > most:
            best, most = node, score
    return best or next((x for x in nodes if x.tag == "body"), top)


def markdown(node: Node, base: str = "") -> str:
    """Headings with #, lists with - or numbers, fences, quotes, emphasis, images and links (not empty ones)."""
    blocks: list[str] = []
    line: list[str] = []

    def flush(before: str = "") -> None:
        text = re.sub(r"[ \t\r\n]+", " ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(before + text)

    def inline(x, lead: str) -> None:
        if isinstance(x, str):
            line.append(x)
            return
        tag = x.tag
        if tag == "img":
            if x.attrs.get("src"):
                line.append(f"![{x.attrs.get('alt', '')}]({absolute(x.attrs['src'], base) if base else x.attrs['src']})")
        elif tag == "a":
            text = re.sub(r"\s+", " ", x.text()).strip()
            href = x.attrs.get("href", "")
            if text:
                line.append(f"[{text}]({absolute(href, base) if base else href})" if href else text)
        elif tag in ("strong", "b", "em", "i", "code"):
            sign = {"strong": "**", "b": "**", "code": "`"}.get(tag, "_")
            text = x.text().strip()
            if text:
                line.append(f"{sign}{text}{sign}")
        elif tag == "pre":
            flush(lead)
            blocks.append("```\n" + x.text().strip("\n") + "\n```")
        elif tag == "br":
            line.append(" ")
        elif tag in _BLOCK or tag in ("body", "html", "figure", "dl", "dd", "dt", "tbody", "thead"):
            flush(lead)
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                own = "#" * int(tag[1]) + " "
            elif tag == "li":
                up = x.parent
                own = f"{[c for c in up.children if isinstance(c, Node) and c.tag == 'li'].index(x) + 1}. " if up is not None and up.tag == "ol" else "- "
            else:
                own = "> " if tag == "blockquote" else lead if tag in ("p", "div") else ""
            for c in x.children:
                inline(c, own)
            flush(own)
        else:
            for c in x.children:
                inline(c, lead)

    for c in node.children:
        inline(c, "")
    flush()
    out: list[str] = []
    for b in blocks:
        joined = re.match(r"(- |\d+\. )", b) and out and re.match(r"(- |\d+\. )", out[-1].rsplit("\n", 1)[-1])
        if joined:
            out[-1] += "\n" + b
        else:
            out.append(b)
    return "\n\n".join(out)


def read(html: str | None, url: str = "") -> dict:
    """Title, text (as markdown), lang, description, date, canonical, links and images of a page; broken or empty pages give empty values."""
    top = tree(html)
    nodes = list(top.walk())
    of = lambda tag: next((x for x in nodes if x.tag == tag), None)
    meta: dict[str, str] = {}
    for x in nodes:
        if x.tag == "meta":
            meta.setdefault((x.attrs.get("property") or x.attrs.get("name") or x.attrs.get("itemprop") or "").lower(), x.attrs.get("content", ""))
    seen = lambda href: absolute(href, url) if url else href
    title = of("title")
    title = " ".join(title.text().split()) if title else ""
    time = of("time")
    dates = [*(meta.get(k) for k in _DATES), time.attrs.get("datetime") if time else None, time.text() if time else None]
    canonical = next((x.attrs["href"] for x in nodes if x.tag == "link" and "canonical" in x.attrs.get("rel", "").lower() and x.attrs.get("href")), None)
    images = [(seen(meta["og:image"]), meta.get("og:title", ""))] if meta.get("og:image") else []
    for x in [x for x in nodes if x.tag == "img" and _within(x, ("article", "main"))][:IMAGES]:
        src = x.attrs.get("src") or x.attrs.get("data-src")
        images += [(seen(src), x.attrs.get("alt", "")[:ALT])] if src else []
    links = [seen(x.attrs["href"]) for x in nodes if x.tag == "a" and x.attrs.get("href")]
    lang = of("html").attrs.get("lang", "") if of("html") else ""
    head = of("head")
    if head is not None and head.parent is not None:
        head.parent.children = [c for c in head.parent.children if c is not head]
    text = markdown(main_content(stripped(top)), url)
    return {
        "title": (title or meta.get("og:title", ""))[:TITLE], "text": text, "lang": lang, "description": (meta.get("description") or meta.get("og:description") or "")[:DESCRIPTION],
        "published": next((d.strip() for d in dates if d and d.strip()), None), "canonical": seen(canonical) if canonical else None,
        "links": [x for x in links if x.startswith("http") or not url][:LINKS], "images": [{"url": u, "alt": a} for u, a in images if u.startswith("http") or not url][:IMAGES],
    }


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in tags:
            return True
        up = up.parent
    return False


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html: what read() finds in each. One page at a time in Python, as no built-in parses HTML."""

    def run(batches):
        for b in batches:
            rows = [read(h.as_py(), u.as_py() or "") for h, u in zip(b.column("html"), b.column("url"))]
            kinds = {"links": pa.list_(pa.string()), "images": pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string())]))}
            cols = [pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in _FIELDS]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *cols], ["page_id", "url", *_FIELDS])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id bigint, url string, title string, text string, lang string, description string, published string, canonical string, links array<string>, images array<struct<url:string,alt:string>>")


_FIELDS = ("title", "text", "lang", "description", "published", "canonical", "links", "images")


def meta(pages: DataFrame) -> DataFrame:
    """page_id, title, lang, n_links by expressions alone."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    return pages.select("page_id", title.alias("title"), F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


def published(s):
    """A date in one of the known forms as a timestamp; others are null."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss z", "yyyy-MM", "yyyy")
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in forms))
