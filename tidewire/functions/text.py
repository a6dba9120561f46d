"""Text functions as column expressions: cleaning, titles, ids, display. Nulls count as empty where a text is due."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_PLACE, _DAY = r"\p{Lu}[\p{L} -]{1,40}?", r"\d\d?\s+\p{Ll}+\.?"


def dateline(agency: str, after_place: str, ends: str, place: str = _PLACE) -> str:
    """The pattern of a dateline: place, what parts it from the day, the day, the agency's mark, and what ends it."""
    return rf"(?m)^{place}{after_place}\s*{_DAY}\s*{agency}{ends}\s*"


#: Datelines by a part of the source's name. The names and the marks of the agencies.
DATELINES = {
    "tass|тасс": dateline("/ТАСС/", ",", r"\.?", r"\p{Lu}[\p{Lu} -]{1,40}?"),
    "interfax|интерфакс": dateline(r"INTERFAX\.RU", r"\.", r"\s*\p{Pd}"),
}
#: A line that holds one of these is noise.
NOISE_PHRASES = ("оставайтесь на связи", "читайте рбк", "рбк в «максе»", "рбк в max", "материал дополняется", "[ рбк ]")
NO_TITLE = "Без заголовка"


def squeeze(text: Column) -> Column:
    """White space of any kind to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip_dateline(text: Column, source: Column) -> Column:
    """Removes an agency's dateline at the start of any paragraph of its own texts."""
    out = text
    for names, pattern in DATELINES.items():
        out = F.when(F.lower(F.coalesce(source, F.lit(""))).rlike(names), F.regexp_replace(out, pattern, "")).otherwise(out)
    return out


def drop_noise_lines(text: Column, phrases: tuple[str, ...] = NOISE_PHRASES) -> Column:
    lines = F.split(text, "\n", -1)
    noisy = lambda x: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(x), p))
    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~noisy(x)), "\n"), r"(?U)^\s+|\s+$", ""))


def feed_text(text: Column) -> Column:
    """Unescaped feed HTML to lines: breaks to line ends, paragraphs to blank lines, other tags dropped."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<\s*br\s*/?\s*>", "\n")
    out = F.regexp_replace(out, r"(?i)</?p[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", ""))


def canonical_name(name: Column) -> Column:
    """ё to е, and the first letter upper; the rest stays (initcap would lower it)."""
    out = F.translate(name, "ёЁ", "еЕ")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))


def cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def cut_with_mark(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(cut(text, most), F.lit(mark))).otherwise(text)


def shorten(text: Column, most: int = 80) -> Column:
    """Unchanged up to ``most`` letters, else cut before three dots, without blanks before them."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(cut(text, most - 3)), F.lit("...")))


def article_id(prefix: Column, url: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.substring(F.md5(url), 1, 12))


def post_id(prefix: str, id: Column, inserted: Column, text: Column) -> Column:
    whole = F.concat_ws("|", F.coalesce(id, F.lit("")), F.coalesce(inserted, F.lit("")), cut(F.coalesce(text, F.lit("")), 100))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(whole, 256), 1, 16))


def post_title(text: Column, author: Column, tickers: Column) -> Column:
    """The longer of first line and first sentence (or 100 letters if under 20), with author and two tickers, cut at 200."""
    line = F.split(F.trim(text), "\n", 2)[0]
    sentence = F.split(text, r"\.", 2)[0]
    longer = F.when(F.length(line) > F.length(sentence), line).otherwise(sentence)
    title = F.trim(F.when(F.length(longer) < 20, cut(text, 100)).otherwise(longer))
    title = F.when((author != "") & (author != "Аноним"), F.concat(author, F.lit(": "), title)).otherwise(title)
    title = F.when(F.size(tickers) > 0, F.concat(title, F.lit(" ["), F.array_join(F.slice(tickers, 1, 2), ", "), F.lit("]"))).otherwise(title)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_TITLE)).otherwise(cut_with_mark(title, 200))


def author_name(nickname: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(nickname, F.lit("")), F.nullif(name, F.lit("")), F.lit("Аноним"))


def profile_url(base: str, nickname: Column, id: Column) -> Column:
    some = (F.coalesce(nickname, F.lit("")) != "") & (F.coalesce(id, F.lit("")) != "")
    return F.when(some, F.concat(F.lit(base.rstrip("/") + "/"), nickname, F.lit("/"), id)).otherwise("")


#: The letters that mean something in the two dialects of markdown.
MARKDOWN = {1: "_*`[", 2: "_*[]()~`>#+-=|{}.!\\"}


def escape_markdown(text: Column, dialect: int = 2) -> Column:
    letters = "".join("\\" + c for c in MARKDOWN[dialect])
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"([{letters}])", r"\\$1")


def bold(text: Column, dialect: int = 2) -> Column:
    return F.concat(F.lit("*"), escape_markdown(text, dialect), F.lit("*"))


def result_list(rows, order, title: Column, most_title: int = 70, most: int = 3500):
    """(number, line) of the found rows: escaped titles cut at ``most_title``, until the list would be longer than ``most``
    letters. A display operator: its rows are few, those of one answer."""
    w = Window.orderBy(*order)
    line = F.concat(F.row_number().over(w).cast("string"), F.lit(". "), escape_html(cut(F.coalesce(title, F.lit("")), most_title)))
    rows = rows.select(F.row_number().over(w).alias("number"), line.alias("line"))
    total = F.sum(F.length("line") + 1).over(Window.orderBy("number"))
    return rows.withColumn("total", total).filter(F.col("total") <= most).drop("total")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bar(count: Column, most: Column, width: int = 10) -> Column:
    """A bar of ``width`` cells: at least one for a count above 0, never more than all."""
    cells = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(count.cast("double") / most.cast("double") * width).cast("int")))
    cells = F.when(most <= 0, 0).when((count > 0) & (cells < 1), 1).otherwise(F.coalesce(cells, F.lit(0)))
    return F.rpad(F.repeat(F.lit("█"), cells), width, "░")


def grouped_number(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_ticker(name: Column) -> Column:
    """A dollar sign before capitals, within braces, or at the end."""
    return name.rlike(r"\$(?:\p{Upper}[\p{Upper}\d]|\s*\z)|\{\$[^}]+\}")


def has_symbol(name: Column) -> Column:
    """A pictograph: one of the dingbats and symbols blocks or of the supplementary pictographs."""
    return name.rlike(r"[\p{InMiscellaneous_Symbols}\p{InDingbats}\x{1F000}-\x{1FAFF}]")


def has_brackets(name: Column) -> Column:
    """Angle or curly brackets, the remains of markup."""
    return F.translate(name, "<>{}", "") != name


def all_capitals(name: Column) -> Column:
    """Two letters or more: Latin capitals, digits and underscores after a capital."""
    first = F.substring(name, 1, 1)
    return (F.length(name) >= 2) & first.between("A", "Z") & (F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "") == "")


def has_loose_edge(name: Column) -> Column:
    """The first or last letter is neither of a word nor the quotation mark that opens or closes one."""
    of_word = r"[\p{L}\p{M}\p{N}\p{Pc}]"
    first, last = F.substring(name, 1, 1), F.substring(name, -1, 1)
    return (name != "") & ~((first.rlike(of_word) | (first == "«")) & (last.rlike(of_word) | (last == "»")))


def noise_class(name: Column) -> Column:
    """The first surface fault of a name, or null."""
    return (
        F.when(has_ticker(name), "ticker")
        .when(has_symbol(name), "emoji")
        .when(has_brackets(name), "html_artifact")
        .when(F.length(F.replace(name, F.lit(" "), F.lit(""))) < 3, "too_short")
        .when(has_loose_edge(name), "punct_edge")
    )


def buckets(name: Column) -> Column:
    """All surface and structural faults of a name (those that need a tagger are left to a pluggable engine)."""
    tests = {
        "A_ticker": has_ticker(name),
        "A_emoji": has_symbol(name),
        "A_html_artifact": has_brackets(name),
        "A_caps_latin": all_capitals(name),
        "A_punct_edge": has_loose_edge(name),
        "B_too_short": F.length(F.replace(name, F.lit(" "), F.lit(""))) < 3,
        "B_lower_case": (F.lower(name) == name) & name.rlike(r"[А-Яа-яЁё]"),
    }
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def importance_label(score: Column) -> Column:
    return F.when(score >= 0.9, "subject").when(score >= 0.5, "key").otherwise("mention")


def snippet(text: Column, mention: Column, around: int = 75) -> Column:
    """The mention with ``around`` letters on either side, stripped; null where it does not occur."""
    at = F.position(F.lower(mention), F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    part = F.trim(F.substr(text, start, at + F.length(mention) + around - start))
    return F.when(at > 0, part)


def occurrences(text: Column, mention: Column) -> Column:
    """How often the mention occurs, ignoring case, without overlaps; at least 1."""
    low, m = F.lower(text), F.lower(mention)
    n = (F.length(low) - F.length(F.replace(low, m, F.lit("")))) / F.length(m)
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(0)).cast("int"))
