"""Text as Column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware libraries see it; Java's \s knows ASCII only.
WS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
#: A token: a longest run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row: inside a lambda, a plain expression would be computed for every
    element again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clean(c: Column) -> Column:
    """No carriage returns, single blanks, single line ends, nothing at either end; null counts as empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{2,}", "\n"))


def words(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"{WS}+"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def title(name: Column, link: Column) -> Column:
    """The name with blanks for hyphens, else the same of the link's readable part, else nothing."""
    slug = F.regexp_extract(F.coalesce(link, F.lit("")), r"/([^/]+?)-\p{Nd}+\.aspx", 1)
    return strip(F.translate(F.coalesce(F.when(name != "", name), slug), "-", " "))


def header_title(text: Column) -> Column:
    return F.split(F.split(text, "\n", 2)[0], " > ", 2)[0]


def body(text: Column) -> Column:
    return F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit(""))


def snippet(text: Column, size: int = 260) -> Column:
    """The start of the body, its line ends as blanks."""
    return F.substring(F.regexp_replace(body(text), r"\n+", " "), 1, size)


def anchor(label: Column) -> Column:
    """`dieu-N` of the first article a label names, else ''."""
    n = F.regexp_extract(label, rf"Điều{WS}+(\p{{Nd}}+[a-zđ]?)", 1)
    return F.when(n != "", F.concat(F.lit("dieu-"), n)).otherwise("")


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(escaped: Column, terms: list[str]) -> Column:
    """<mark> around whole words that are one of the terms, the longest first."""
    if not terms:
        return escaped
    import re
    alt = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(escaped, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({alt})(?![\p{{L}}\p{{N}}_])", "<mark>$1</mark>")
