"""HTML to text where column expressions cannot: Arrow-batched UDFs over the standard parser."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "template"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "source", "wbr"}


class _Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIP

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in _SKIP))

    def handle_data(self, data):
        if not self.skip and (text := data.strip()):
            self.pieces.append(text)


def plain_text(page: str | None) -> str:
    """The text of a fragment, its pieces joined by one blank; scripts and styles left out. Null gives ''."""
    if not page:
        return ""
    if "<" not in page and "&" not in page:
        return page.strip()
    parser = _Pieces()
    parser.feed(page)
    parser.close()
    return " ".join(parser.pieces)


@F.pandas_udf(T.StringType())
def _parsed(pages: pd.Series) -> pd.Series:
    return pages.map(plain_text)


def clean_html(value: Column | str) -> Column:
    """The text of a fragment. Only values that hold markup or entities go to the parser; the others are trimmed in the JVM."""
    value = F.col(value) if isinstance(value, str) else value
    marked = F.coalesce(F.contains(value, F.lit("<")) | F.contains(value, F.lit("&")), F.lit(False))
    plain = F.coalesce(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.when(marked, _parsed(F.when(marked, value))).otherwise(plain)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: html.unescape(x) if x else x)


class _Page(HTMLParser):
    """Title, publication time and paragraphs of an article page by ordered fallbacks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.h1: list[str] = []
        self.title: list[str] = []
        self.meta: dict[str, str] = {}
        self.time: str | None = None
        self.inside: list[str] = []
        self.anywhere: list[str] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        got = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = got.get("property") or got.get("name") or got.get("itemprop")
            if name:
                self.meta.setdefault(name.lower(), got.get("content", ""))
        if tag == "time" and self.time is None:
            self.time = got.get("datetime")
        if tag not in _VOID:
            self.stack.append((tag, got))
        if tag == "p":
            self.open = []

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag == "p" and self.open is not None:
                    text = re.sub(r"\s+", " ", " ".join(self.open)).strip()
                    if text:
                        self.anywhere.append(text)
                        if any(t == "article" or "article" in g.get("class", "") or g.get("itemprop") == "articleBody" for t, g in self.stack):
                            self.inside.append(text)
                    self.open = None
                del self.stack[i:]
                break

    def handle_data(self, data):
        tags = {t for t, _ in self.stack}
        if tags & _SKIP:
            return
        if "h1" in tags:
            self.h1.append(data)
        elif "title" in tags:
            self.title.append(data)
        if self.open is not None:
            self.open.append(data)


def read_page(page: str | None) -> tuple[str | None, str | None, str | None]:
    """(title, content, published): h1, og:title or title; paragraphs of the article, else all; meta time, else <time>."""
    if not page:
        return None, None, None
    parser = _Page()
    parser.feed(page)
    parser.close()
    text = lambda xs: re.sub(r"\s+", " ", " ".join(xs)).strip() or None
    title = text(parser.h1) or parser.meta.get("og:title") or text(parser.title)
    content = "\n".join(parser.inside or parser.anywhere) or None
    when = parser.meta.get("article:published_time") or parser.meta.get("datepublished") or parser.time
    return title, content, when or None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "content", "published")]))
def page_parts(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x) for x in pages], columns=["title", "content", "published"])
