"""The main body of a page: two-pass block rules over the lines of its text.

Method: each line of raw_text is a block. Pass one classifies blocks by stop-word density, length, link
density (the share of the line's letters that stand in anchors of raw_html, where that has any) and closing
punctuation into good, bad and ambiguous (short). Pass two keeps an ambiguous block if the decided block before or
after it is good (not only the nearer one: a body's short first and last paragraphs stand beside furniture), and drops
good blocks that stand apart from the body's own run, behind bad blocks, and are shorter than it (than half of it, where they
stand near).
The headline is found by the title. No phrases of page furniture are known.

Defined results: rows without raw_html or raw_text give no lines; an empty text has the one empty line,
which belongs to no body; repeated rows give equal results once; pages and lines of any length are
processed whole; extra columns are ignored. Pages with bad blocks but no good one keep only the headline; where
no block is decided, the short ones are body.

Scale: a pure map over rows (Arrow batches), no shuffle; raw_html is only scanned for its anchors.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of the two languages of the data, after the public stop-word lists of the Snowball stemmers.
STOP_WORDS = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от меня еще нет о из ему "
    "теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может "
    "они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того "
    "потому этого какой совсем ним здесь этом один почти мой тем чтобы нее были куда зачем всех никогда можно при наконец два об "
    "другой хоть после над больше тот через эти нас про них какая много разве три эту моя впрочем хорошо свою этой перед иногда "
    "лучше чуть том нельзя такой им более всегда конечно всю между это которые который однако также поскольку хотя несмотря "
    "the of and to in a is that for on it as with was at by be this from are or an which but not have has were had their its they "
    "his her he she we you will would there been if more when who also into than about after before over".split()
)
SENTENCE = re.compile(r"[.!?…][»\"”)]*(?=\s+[«\"A-ZА-ЯЁ]|\s*$)")
END = re.compile(r"[.!?…][»\"”)\]]*\W*$")
ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
TAG = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W_]+")
GOOD, BAD, SHORT = 1, 0, -1
#: Lines apart, counted from line to line: more than APART make another group, more than FAR one surely not of the body.
APART, FAR = 2, 3


def _plain(s: str) -> str:
    return " ".join(s.replace("ё", "е").replace("Ё", "Е").lower().split())


def _letters(s: str) -> str:
    return "".join(WORD.findall(s.lower().replace("ё", "е")))


def anchors(page: str) -> set[str]:
    """The texts of a page's links."""
    return {_plain(html.unescape(TAG.sub(" ", x))) for x in ANCHOR.findall(page)} if "<a" in page or "<A" in page else set()


def link_share(plain: str, links: set[str]) -> float:
    """The share of a line's letters that stand in anchors."""
    rest = plain
    for x in sorted((x for x in links if len(x) > 2 and x in plain), key=len, reverse=True):
        rest = re.sub(rf"(?<!\w){re.escape(x)}(?!\w)", " ", rest)
    return 1 - len(_letters(rest)) / max(len(_letters(plain)), 1) if rest != plain else 0.0


def stop_share(line: str) -> float:
    """Stop-word density: the share of a line's words that are function words."""
    words = WORD.findall(_plain(line))
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def first_pass(line: str, links: set[str], min_words: int = 9, stop_low: float = 0.06) -> int:
    plain = _plain(line)
    if not plain:
        return BAD
    words = WORD.findall(plain)
    if len(words) < 2 or plain in links or link_share(plain, links) > 0.5:
        return BAD
    if not END.search(line):
        return BAD
    stops = stop_share(line)
    sentences = len(SENTENCE.findall(line.strip()))
    if len(words) >= min_words and (stops >= stop_low or sentences > 1):
        return GOOD
    # A lone short line that asks, exclaims or trails off reads as a heading or a cut link.
    return BAD if sentences <= 1 and line.rstrip()[-1] in "?!…" and len(words) < 16 else SHORT


def find_headline(lines: list[str], title: str | None, page: str) -> int:
    """Index of the headline, or -1: the first line that equals or begins like the title (its stored form may be cut)."""
    names = []
    if title:
        names.append(_letters(title))
    m = re.search(r"<title[^>]*>(.*?)</title>", page, re.I | re.S)
    if m:
        names.append(_letters(html.unescape(m.group(1))))
    m = re.search(r"<h1[^>]*>(.*?)</h1>", page, re.I | re.S)
    if m:
        names.insert(0, _letters(html.unescape(TAG.sub("", m.group(1)))))
    keyed = [_letters(x) for x in lines]
    for name in names:
        if len(name) < 8:
            continue
        for i, k in enumerate(keyed):
            if k == name or (len(name) >= 20 and (k.startswith(name) or (len(k) >= 20 and name.startswith(k)))):
                return i
    return -1


def main_lines(text: str, page: str, title: str | None) -> list[bool]:
    """Per line of ``text``: does it belong to the main body?"""
    lines = text.split("\n")
    links = anchors(page)
    label = [first_pass(x, links) for x in lines]
    head = find_headline(lines, title, page)
    last = len(lines) - 1
    # A text cut in its last line: that line may lack its end.
    if last > head + 1 and label[last] == BAD and lines[last].strip() and label[last - 1] != BAD and _plain(lines[last]) not in links:
        label[last] = GOOD
    start, end = head + 1, len(lines)
    # Pass two: a short block is body if the decided block before or after it is good: a body's first and last paragraphs
    # stand beside furniture. Where nothing is decided, it is body too.
    out = [False] * len(lines)
    for i in range(start, end):
        if label[i] == SHORT:
            before = next((label[j] for j in range(i - 1, start - 1, -1) if label[j] != SHORT), None)
            after = next((label[j] for j in range(i + 1, end) if label[j] != SHORT), None)
            near = [x for x in (before, after) if x is not None]
            out[i] = GOOD in near or not near
        else:
            out[i] = label[i] == GOOD
    # Good blocks apart from the body: behind lines of furniture, and shorter than it: the more lines, the longer they may be.
    groups: list[list[int]] = []
    for i in range(start, end):
        if out[i] and groups and i - groups[-1][-1] <= APART:
            groups[-1].append(i)
        elif out[i]:
            groups.append([i])
    if len(groups) > 1:
        weight = [sum(len(lines[i]) for i in g) for g in groups]
        best = weight.index(max(weight))
        for n, g in enumerate(groups):
            gap = g[0] - groups[best][-1] if n > best else groups[best][0] - g[-1]
            if n != best and weight[n] < (1.0 if gap > FAR else 0.5) * weight[best]:
                for i in g:
                    out[i] = False
    if head >= 0:
        out[head] = True
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers = [], []
        for i, text, page, title in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            for n, keep in enumerate(main_lines(text, page, title), 1):
                if not keep:
                    ids.append(i)
                    numbers.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["raw_article_id", "line_no"])


def furniture_lines(rows: DataFrame) -> DataFrame:
    """(raw_article_id, line_no) of raw_text lines outside the main body, for rows with raw_html."""
    pages = rows.filter("raw_html is not null and raw_text is not null and id is not null").selectExpr("cast(id as bigint) id", "raw_text", "raw_html", "raw_title")
    return pages.mapInArrow(_map, "raw_article_id bigint, line_no int")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, page, title in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            out.append("\n".join(x for x, k in zip(text.split("\n"), main_lines(text, page, title)) if k))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["raw_article_id", "body"])


def bodies(rows: DataFrame) -> DataFrame:
    """(raw_article_id, body): each page's main body."""
    pages = rows.filter("raw_html is not null and raw_text is not null and id is not null").selectExpr("cast(id as bigint) id", "raw_text", "raw_html", "raw_title")
    return pages.mapInArrow(_bodies, "raw_article_id bigint, body string")
