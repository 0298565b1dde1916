"""What a page says about itself: sections, JSON-LD, links, name and place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms
from .lexicon import literals
from .text import collapse, normalize, strip_tags

SECTIONS = ("title", "meta", "h1", "h2", "footer", "contact")

# JSON-LD types of a business, words that are no name, and what marks a contact block.
BUSINESS_TYPES = ["organization", "localbusiness", "store", "professionalservice"]
NO_NAME = "home|homepage|official|website"
CONTACT_BLOCKS = "contact|footer|reach|get-in-touch|اتصل|تواصل"


def _first(html: Column, pattern: str) -> Column:
    return strip_tags(F.regexp_extract(html, "(?is)" + pattern, 1))


def _several(html: Column, tag: str, n: int) -> Column:
    return strip_tags(F.array_join(F.slice(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), 1, n), " "))


def sections(html: Column) -> Column:
    """title, meta (description, og:site_name, og:title), first h1, first two h2, first footer, first two contact blocks, as plain text."""
    html = F.coalesce(html, F.lit(""))
    metas = [_first(html, rf"<meta[^>]+{kind}=[\"']{name}[\"'][^>]+content=[\"'](.*?)[\"']") for kind, name in (("name", "description"), ("property", "og:site_name"), ("property", "og:title"))]
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<(section|div)[^>]+(?:id|class)=[\"'][^\"']*({CONTACT_BLOCKS})[^\"']*[\"'][^>]*>(.*?)</\1>"), F.lit(3))
    return F.struct(
        _first(html, r"<title[^>]*>(.*?)</title>").alias("title"),
        F.array_join(F.filter(F.array(*metas), lambda m: m != ""), " ").alias("meta"),
        _several(html, "h1", 1).alias("h1"), _several(html, "h2", 2).alias("h2"), _several(html, "footer", 1).alias("footer"),
        F.array_join(F.slice(F.transform(blocks, strip_tags), 1, 2), " ").alias("contact"),
    )


def json_ld(html: Column) -> Column:
    """name, city, country of the first business among the first six JSON-LD scripts; malformed scripts are skipped."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.filter(F.transform(F.slice(scripts, 1, 6), lambda s: F.try_parse_json(F.trim(s))), lambda v: v.isNotNull())
    items = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))

    def kinds(item: Column) -> Column:
        def of(path: str) -> Column:
            return F.coalesce(F.try_variant_get(item, path, "array<string>"), F.transform(F.array(F.try_variant_get(item, path, "string")), lambda x: x))

        one = F.filter(of("$.@type"), lambda x: x.isNotNull() & (x != ""))
        return F.when(F.size(one) > 0, one).otherwise(of("$.type"))

    business = F.filter(items, lambda i: F.exists(kinds(i), lambda k: F.lower(k).isin(BUSINESS_TYPES)))
    found = F.get(business, F.lit(0))
    text = lambda path: F.nullif(F.trim(F.when(F.schema_of_variant(F.try_variant_get(found, path, "variant")) == "STRING", F.try_variant_get(found, path, "string"))), F.lit(""))
    return F.struct(text("$.name").alias("name"), text("$.address.addressLocality").alias("city"), F.coalesce(text("$.address.addressCountry"), text("$.address.addressCountry.name")).alias("country"))


def _clean_name(name: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(collapse(name), rf"(?iU)\b({NO_NAME})\b", ""))
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def company_name(site_domain: Column, title: Column, h1: Column, ld_name: Column) -> Column:
    """JSON-LD name, else the first part of the title, else h1 of three characters, else the domain's first label."""
    part = F.trim(F.get(F.split(title, r"\s*(?:\||-|–|—|:|::)\s*"), F.lit(0)))
    label = F.split_part(F.split_part(site_domain, F.lit(":"), F.lit(1)), F.lit("."), F.lit(1))
    return _clean_name(F.coalesce(ld_name, F.nullif(part, F.lit("")), F.when(F.length(h1) >= 3, h1), label))


def city(body: Column, strong: Column, ld_city: Column, cities: list[str] = terms.CITIES) -> Column:
    """JSON-LD city, else the listed one with the most mentions (twice in strong sections); the first of equals wins."""
    listed = F.transform(literals([c.lower() for c in cities]), lambda c, i: F.struct(c.alias("city"), (-i).alias("place")))
    mentions = lambda text, c: F.when(F.contains(text, c), ((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(c)).cast("int")).otherwise(0)
    scored = F.transform(listed, lambda x: F.struct((2 * mentions(strong, x["city"]) + mentions(body, x["city"])).alias("score"), x["place"].alias("place"), x["city"].alias("city")))
    best = F.array_max(scored)
    return F.coalesce(F.lower(collapse(ld_city)), F.when(best["score"] > 0, best["city"]), F.lit("unknown"))


def listed_city(text: Column, cities: list[str] = terms.CITIES) -> Column:
    """The first listed city that a text contains, else unknown (the batch projection's own rule)."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(c.lower())), F.lit(c)) for c in cities], F.lit("unknown"))


def country(body: Column, site_domain: Column, ld_country: Column) -> Column:
    here = F.endswith(site_domain, F.lit(".sa")) | body.rlike("saudi|ksa|السعود")
    return F.coalesce(ld_country, F.when(here, "Saudi Arabia"), F.lit("unknown"))


def links(html: Column) -> Column:
    """href and anchor text of each closed link, in order."""
    pattern = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    hrefs, bodies = (F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(k)) for k in (1, 2))
    zipped = F.arrays_zip(hrefs.alias("href"), bodies.alias("anchor"))
    return F.filter(F.transform(zipped, lambda l: F.struct(_href(l["href"]).alias("href"), strip_tags(l["anchor"]).alias("anchor"))), lambda l: l["href"] != "")


def _href(href: Column) -> Column:
    from .text import unescape

    return unescape(href)


def link_scores(url: Column, anchor: Column) -> dict[str, Column]:
    """A score for each kind of page that a crawl prefers."""
    u, a = F.lower(url), F.lower(anchor)
    kinds = {"contact": terms.LINK_CONTACT, "about": terms.LINK_ABOUT, "services": terms.LINK_SERVICES, "projects": terms.LINK_PROJECTS}
    among = lambda text, words: F.size(F.filter(literals([w.lower() for w in words]), lambda w: F.contains(text, w)))
    extra = {"contact": 20 * u.rlike(r"whatsapp|wa\.me").cast("int"), "projects": 10 * u.rlike("gallery|portfolio").cast("int")}
    return {k: 100 * among(u, v) + 80 * among(a, v) + extra.get(k, F.lit(0)) for k, v in kinds.items()}


__all__ = ["SECTIONS", "city", "company_name", "country", "json_ld", "link_scores", "links", "listed_city", "normalize", "sections"]
