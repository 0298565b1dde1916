"""Contact extraction as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import percent_decoded, unescape

# The patterns that contacts are found by.
EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:\+?[0-9][0-9\s().\-]{7,}[0-9])"
WHATSAPP = r"(?i)(https?://(?:wa\.me|api\.whatsapp\.com)/[^\s\"'<]+)"
AT_FORMS = ["(at)", "[at]", " at "]
EMAIL_ATTRIBUTES = "href|data-email|data-mail|data-contact|data-clipboard-text"
PHONE_ATTRIBUTES = "href|data-phone|data-tel|data-contact"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _flat_map(values: Column, f) -> Column:
    return F.flatten(F.transform(values, f))


def emails(text: Column) -> Column:
    """Addresses in lower case, in order; `(at)`, `[at]` and ` at ` count as @ (in this order)."""
    spelled = reduce(lambda c, a: F.replace(c, F.lit(a), F.lit("@")), AT_FORMS, text)
    return F.transform(_all(spelled, EMAIL), F.lower)


def _attributes(raw: Column, names: str) -> Column:
    return _all(raw, rf"(?is)\b(?:{names})\s*=\s*[\"']([^\"']+)[\"']", 1)


def decoded_html(html: Column) -> Column:
    return percent_decoded(unescape(F.coalesce(html, F.lit(""))))


def attribute_emails(raw: Column) -> Column:
    """mailto: targets (cut at `?`, several by comma, semicolon or space) and attribute values of decoded HTML."""
    mailto = _all(raw, r"(?i)\bmailto:\s*([^\"'\s>]+)", 1)
    parts = _flat_map(mailto, lambda m: F.split(F.split_part(m, F.lit("?"), F.lit(1)), r"[,\s;]+"))
    return F.concat(_flat_map(parts, emails), _flat_map(_attributes(raw, EMAIL_ATTRIBUTES), emails))


def protected_emails(html: Column) -> Column:
    """data-cfemail: hex bytes, each xor the first."""
    html = F.coalesce(html, F.lit(""))
    held = F.when(F.contains(html, F.lit("cfemail")), unescape(html)).otherwise("")
    codes = _all(held, r"(?is)\bdata-cfemail\s*=\s*[\"']([0-9a-fA-F]+)[\"']", 1)
    codes = F.filter(codes, lambda c: (F.length(c) >= 4) & (F.length(c) % 2 == 0))

    def decoded(code: Column) -> Column:
        byte = lambda i: F.conv(code.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        plain = F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int") - 1), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(byte(F.lit(0)))), 2, "0"))
        return F.make_valid_utf8(F.unhex(F.array_join(plain, "")).cast("string"))

    return _flat_map(F.transform(codes, decoded), emails)


def joined_emails(raw: Column) -> Column:
    """Script text such as "info" + "@" + "example.com"."""
    pattern = r"(?is)([\"'])([a-zA-Z0-9._%+\-]{1,64})\1\s*\+\s*([\"'])@\3\s*\+\s*([\"'])([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\4"
    both = F.arrays_zip(_all(raw, pattern, 2).alias("a"), _all(raw, pattern, 5).alias("b"))
    joined = F.transform(both, lambda p: F.lower(F.concat(p["a"], F.lit("@"), p["b"])))
    return F.filter(joined, lambda e: F.size(emails(e)) > 0)


def phone_candidates(text: Column) -> Column:
    return _all(text, PHONE)


def e164(candidate: Column) -> Column:
    """A candidate as +digits, or null. Without `+` or `00` it is taken as a Saudi number.

    Saudi numbers follow the public numbering plan (mobile 5x and nine digits, fixed 11 to 17 and nine digits, 800, 811 and 9200 services); of other
    countries' numbers only the length is checked.
    """
    trimmed = F.trim(candidate)
    digits = F.regexp_replace(trimmed, r"[^0-9]", "")
    foreign = F.startswith(trimmed, F.lit("+")) | F.startswith(digits, F.lit("00"))
    whole = F.when(foreign, F.regexp_replace(digits, "^00", "")).when(digits.rlike("^966[0-9]{8,10}$"), digits).otherwise(F.concat(F.lit("966"), F.regexp_replace(digits, "^0", "")))
    whole = F.regexp_replace(whole, "^9660", "966")
    saudi = whole.rlike(r"^966(5[0-9]{8}|1[1-7][0-9]{7}|800[0-9]{7}|811[0-9]{7}|9200[0-9]{5})$")
    other = ~F.startswith(whole, F.lit("966")) & F.length(whole).between(10, 15) & ~F.startswith(whole, F.lit("0"))
    return F.when(saudi | other, F.concat(F.lit("+"), whole))


def phones(text: Column) -> Column:
    return F.filter(F.transform(phone_candidates(text), e164), lambda p: p.isNotNull())


def attribute_phones(raw: Column) -> Column:
    tel = _all(raw, r"(?i)\btel:\s*([^\"'\s>]+)", 1)
    return F.concat(_flat_map(tel, lambda t: phones(F.split_part(t, F.lit("?"), F.lit(1)))), _flat_map(_attributes(raw, PHONE_ATTRIBUTES), phones))


def whatsapp(text: Column) -> Column:
    return _all(text, WHATSAPP, 1)


def _set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def contacts(text: Column, html: Column, raw: Column, site_domain: Column) -> Column:
    """emails, phones, whatsapp (distinct, sorted) and websites. raw: decoded_html(html)."""
    return F.struct(
        _set(emails(text), attribute_emails(raw), protected_emails(html), joined_emails(raw)).alias("emails"),
        _set(phones(text), attribute_phones(raw)).alias("phones"),
        _set(whatsapp(text), whatsapp(raw)).alias("whatsapp"),
        F.array(site_domain).alias("websites"),
    )
