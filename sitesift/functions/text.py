"""Text scalars as native columns."""

from __future__ import annotations

import html as html_module

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the text rules see it: Unicode white space and the ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Entities that are decoded by name, the ampersand last.
ENTITIES = [
    ("nbsp", "\u00a0"), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("reg", "®"), ("trade", "™"), ("middot", "·"),
    ("bull", "•"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"),
    ("laquo", "«"), ("raquo", "»"), ("deg", "°"), ("times", "×"), ("euro", "€"), ("pound", "£"), ("cent", "¢"), ("sect", "§"),
    ("agrave", "à"), ("aacute", "á"), ("eacute", "é"), ("egrave", "è"), ("ecirc", "ê"), ("iacute", "í"), ("oacute", "ó"), ("uacute", "ú"),
    ("ntilde", "ñ"), ("ccedil", "ç"), ("auml", "ä"), ("ouml", "ö"), ("uuml", "ü"), ("szlig", "ß"),
]


_ENTITY_TABLE = "array(" + ", ".join("named_struct('name', '&{};', 'char', '{}')".format(name, char.replace("'", "\\'")) for name, char in ENTITIES) + ")"


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize(text: Column) -> Column:
    """Lower-cased and collapsed; null is empty."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def _point(number: Column) -> Column:
    """The character of a code point; U+FFFD for one that is none."""
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """HTML references: numeric ones, and those of ENTITIES by name; `&amp;` last, so nothing is decoded twice."""
    table = F.expr(_ENTITY_TABLE)
    named = F.aggregate(table, text, lambda acc, e: F.replace(acc, e["name"], e["char"]))
    parts = F.split(named, "&#")
    digits = lambda p: F.regexp_extract(p, r"^([0-9]{1,7});?", 1)
    hexes = lambda p: F.regexp_extract(p, r"^[xX]([0-9a-fA-F]{1,6});?", 1)

    def decoded(p: Column) -> Column:
        number = F.when(digits(p) != "", digits(p).try_cast("bigint")).when(hexes(p) != "", F.conv(hexes(p), 16, 10).try_cast("bigint"))
        rest = F.regexp_replace(p, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
        return F.when(number.isNull(), F.concat(F.lit("&#"), p)).otherwise(F.concat(_point(number), rest))

    # a text without a numeric reference skips the work
    numeric = F.when(F.size(parts) <= 1, named).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), decoded), "")))
    return F.when(F.contains(text, F.lit("&")), F.replace(numeric, F.lit("&amp;"), F.lit("&"))).otherwise(text)


@F.pandas_udf(StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """All HTML references, also those without a semicolon: the exact form, in Arrow batches, for those who need more than ENTITIES."""
    return text.map(html_module.unescape, na_action="ignore")


def strip_tags(html: Column) -> Column:
    return collapse(unescape(F.regexp_replace(html, r"(?s)<[^>]+>", " ")))


def page_text(html: Column, limit: int = 200_000) -> Column:
    """A fetched page as text: script, style, noscript blocks, comments and tags go; five references are decoded in turn (so `&amp;lt;` gives `<`); capped."""
    text = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}.*?>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("amp", "&"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.substring(collapse(text), 1, limit)


def body_text(html: Column) -> Column:
    """The evaluator's own text of a page, when none is given: no comment removal and no cap, all references."""
    text = F.coalesce(html, F.lit(""))
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}.*?>.*?</{tag}>", " ")
    return strip_tags(text)


def word_count(text: Column) -> Column:
    """Words of at least two Latin or two Arabic letters."""
    return F.regexp_count(text, F.lit(r"[a-zA-Z]{2,}|[\u0600-\u06FF]{2,}"))


def percent_decoded(text: Column) -> Column:
    """%XX decoded, `+` and malformed sequences kept; bytes that are no UTF-8 become U+FFFD."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def log_norm(x: Column, cap: float) -> Column:
    """ln(1 + x) / ln(1 + cap), at most 1; 0 for x <= 0."""
    return F.when(x > 0, F.least(F.lit(1.0), F.log1p(x) / F.log1p(F.lit(float(cap))))).otherwise(0.0)


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to even, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x, 0).cast("int")))
