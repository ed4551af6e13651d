"""Paragraphs of HTML pages: one Arrow stage on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers in order of preference: (tag, attribute, value).
CONTENT = [("div", "id", "mw-content-text"), ("div", "class", "mw-parser-output")]
BODY = ("body", None, None)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


class _Tree(HTMLParser):
    """Collects the paragraphs in each container. A paragraph goes on until its end tag, unless autoclose ends it."""

    def __init__(self, containers, autoclose: bool):
        super().__init__(convert_charrefs=True)
        self.containers, self.autoclose = containers, autoclose
        self.stack: list[tuple[str, int, list]] = []  # tag, paragraph, containers that begin here
        self.paragraphs: list[list[str]] = []
        self.within: dict[int, list[int]] = {}  # the first of each container: its paragraphs
        self.opened: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if self.autoclose and tag in _ENDS_P and any(t == "p" for t, _, _ in self.stack):
            self.handle_endtag("p")
        given, begins = dict(attrs), []
        for k, (name, attribute, value) in enumerate(self.containers):
            fits = tag == name and (attribute is None or (given.get(attribute) or "") == value or (attribute == "class" and value in (given.get("class") or "").split()))
            if fits and k not in self.within:
                self.within[k] = []
                begins.append(k)
        number = -1
        if tag == "p":
            number = len(self.paragraphs)
            self.paragraphs.append([])
            for k in self.opened:
                self.within[k].append(number)
        self.stack.append((tag, number, begins))
        self.opened += begins

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for _, _, begins in self.stack[i:]:
                    self.opened = [k for k in self.opened if k not in begins]
                del self.stack[i:]
                return

    def handle_data(self, data):
        if any(t in SILENT for t, _, _ in self.stack):
            return
        said = data.strip()
        if said:
            for _, number, _ in self.stack:
                if number >= 0:
                    self.paragraphs[number].append(said)


def paragraphs(html: str | None, body: bool = True, autoclose: bool = False) -> list[str]:
    """Texts of the paragraphs in the first container there is, in page order; text nodes are trimmed and joined bare."""
    tree = _Tree([*CONTENT, BODY] if body else CONTENT, autoclose)
    tree.feed(html or "")
    tree.close()
    first = min(tree.within, default=None)
    return ["".join(tree.paragraphs[i]) for i in tree.within[first]] if first is not None else []


def explode_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", body: bool = True, autoclose: bool = False) -> DataFrame:
    """(article_id, para_pos, paragraph): one row a paragraph, from 0."""

    def run(batches):
        for batch in batches:
            out = [(i, k, p) for i, html in zip(batch["article_id"], batch["html"]) for k, p in enumerate(paragraphs(html, body, autoclose))]
            yield pd.DataFrame(out, columns=["article_id", "para_pos", "paragraph"])

    narrow = pages.select(F.col(id_col).cast("long").alias("article_id"), F.col(html_col).alias("html"))
    return narrow.mapInPandas(run, "article_id long, para_pos int, paragraph string")


def search_results(html: str | None, base: str, limit: int) -> list[tuple[str, str]]:
    """(title, url) of a result page's first `limit` entries: links in the items of div.results."""
    block = re.search(r"""(?is)<div[^>]*class=["'][^"']*\bresults\b[^"']*["'][^>]*>(.*)""", html or "")
    out = []
    for item in re.findall(r"(?is)<li\b[^>]*>(.*?)(?=<li\b|</ul|</ol|\Z)", block[1] if block else "")[:limit]:
        link = re.search(r"""(?is)<a\b[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", item)
        if link:
            title = re.sub(r"<[^>]*>", "", link[2]).strip()
            out.append((title, link[1] if link[1].startswith("http") else base.rstrip("/") + "/" + link[1].lstrip("/")))
    return out
