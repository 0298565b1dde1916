"""URL scalars as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"

# What a crawl never fetches, and platforms that are no company's own site.
SKIPPED_SCHEMES = ["mailto:", "tel:", "javascript:"]
SKIPPED_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".zip", ".rar", ".7z", ".pdf"]
PLATFORMS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com",
    "maps.google.com", "google.com", "pinterest.com",
]
EVALUATION_PLATFORMS = [
    "facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com", "linkedin.com", "www.linkedin.com",
    "youtube.com", "www.youtube.com", "maps.google.com",
]


def ensure_http(url: Column) -> Column:
    """Stripped; https:// in front unless it starts with http:// or https:// (in lower case); empty stays empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", "").when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def with_scheme(url: Column) -> Column:
    """Stripped; https:// in front of a URL that has no scheme of its own."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when((u == "") | u.rlike(_SCHEME), u).otherwise(F.concat(F.lit("https://"), u))


def with_http_prefix(url: Column) -> Column:
    """https:// in front of what does not begin with `http`."""
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))


def domain(url: Column) -> Column:
    """The network location in lower case without one leading `www.`; port and user stay; empty without `//`."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _NETLOC, 1))
    return F.regexp_replace(host, r"^www\.", "")


def crude_domain(url: Column) -> Column:
    """Scheme text deleted anywhere, up to the first slash, lower case, without `www.`; a query stays."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.regexp_replace(F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), r"^www\.", "")


def path(url: Column) -> Column:
    """The path in lower case, without parameters of its last segment, query and fragment."""
    u = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), _SCHEME, ""), r"^//[^/?#]*", "")
    return F.lower(F.regexp_replace(F.regexp_extract(u, r"^[^?#]*", 0), r";[^/]*$", ""))


def segments(path_: Column) -> Column:
    return F.filter(F.split(path_, "/"), lambda s: s != "")


def resolve(base: Column, href: Column) -> Column:
    """A reference against an absolute base: absolute, `//host`, `/path`, `?query`, `#fragment` and relative ones; dot segments are removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(bare, r"^(.*/)", 1))
    joined = (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
        .otherwise(F.concat(folder, href))
    )
    return F.when(joined.rlike(r"/\.{1,2}(/|$|[?#])"), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(origin) + 1, F.lit(1 << 30))
    path_ = F.regexp_extract(rest, r"^[^?#]*", 0)
    tail = F.substring(rest, F.length(path_) + 1, F.lit(1 << 30))
    parts = F.split(path_, "/")
    kept = F.aggregate(
        F.slice(parts, 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    folder = F.when(path_.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise("")
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, folder).otherwise(""), tail)


def crawlable(url: Column) -> Column:
    """Stripped and without fragment; empty for schemes and file endings that are no pages (an ending before a query passes)."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    low = F.lower(u)
    skipped = low.rlike("^(" + "|".join(SKIPPED_SCHEMES) + ")") | low.rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_ENDINGS) + ")$")
    return F.when(skipped, "").otherwise(u)


def company_domain(domain_: Column) -> Column:
    return (domain_ != "") & ~domain_.isin(PLATFORMS)


def evaluable_domain(domain_: Column) -> Column:
    return ~domain_.isin(EVALUATION_PLATFORMS)
