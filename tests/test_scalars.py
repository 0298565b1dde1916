import html as html_lib
import math
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from sitesift.functions import contacts, lexicon, page, terms, text, urls


def values(spark, rows, expr, column="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col(column))).collect()]


def test_domain(spark):
    rows = ["HTTP://WWW.A.SA", "http://user@Ex.com:8080/a", "example.com/x", "//www.b.com/x?y", None, "mailto:x", "https://www.www.c.sa#f"]

    def want(u):
        host = (urlparse(u or "").netloc or "").lower()
        return host[4:] if host.startswith("www.") else host

    assert values(spark, rows, urls.domain) == [want(u) for u in rows]
    assert values(spark, ["https://www.A.sa/x?y", "a.sa?y/z"], urls.crude_domain) == ["a.sa", "a.sa?y"]


def test_schemes(spark):
    rows = [" a.com ", "http://a", "HTTPS://a", "", None, "mailto:x"]
    assert values(spark, rows, urls.ensure_http) == ["https://a.com", "http://a", "https://HTTPS://a", "", "", "https://mailto:x"]
    assert values(spark, rows, urls.with_scheme)[2:] == ["HTTPS://a", "", "", "mailto:x"]


def test_resolve(spark):
    base = "https://a.com/x/y?q=1#f"
    rows = ["/p", "p", "../p", "./p", "?z=2", "#g", "//b.com/c", "http://c.com", "p/../q", "/a/../../b/"]
    assert values(spark, rows, lambda c: urls.resolve(F.lit(base), c)) == [urljoin(base, r) for r in rows]


def test_crawlable(spark):
    rows = ["a#b", "tel:1", "MAILTO:x", "x.PDF", "x.pdf?y", " b "]
    assert values(spark, rows, urls.crawlable) == ["a", "", "", "", "x.pdf?y", "b"]


def test_page_text(spark):
    rows = ["&amp;lt;b", "<p>a</p><script>x</script><!-- c --><noscript>n</noscript>b&nbsp;c", None, "x" * 200_001]
    got = values(spark, rows, text.page_text)
    assert got[:3] == ["<b", "a b c", ""] and len(got[3]) == 200_000


def test_unescape(spark):
    rows = ["&amp;lt;", "&#65;&#x42;&#1575;z", "a & b", "&copy;&quot;", "&#xZZ;", None]
    assert values(spark, rows, text.unescape) == [html_lib.unescape(r) if r is not None else None for r in rows]


def test_numbers(spark):
    assert values(spark, ["a bb ccc مطبخ م"], text.word_count) == [3]
    df = spark.createDataFrame([(54.5,), (55.5,), (-3.0,), (140.0,)], "x double")
    assert [r[0] for r in df.select(text.half_even(F.col("x"))).collect()] == [54, 56, 0, 100]
    got = spark.range(1).select(text.log_norm(F.lit(3.0), 12)).first()[0]
    assert got == pytest.approx(math.log1p(3) / math.log1p(12))
    assert values(spark, ["a%20b+c", "bad%zz"], text.percent_decoded) == ["a b+c", "bad%zz"]


def test_term_counts(spark):
    rows = ["carpet car, car", "fit-out fit out fitout", "مطابخ مطابخ", "used cars here", "kitchen design kitchen kitchens"]

    def one(txt, term):
        if lexicon.latin(term):
            return len(re.findall(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", txt))
        return txt.count(term)

    bags = {"car": ["car"], "fitout": terms.FITOUT, "kitchen": terms.KITCHEN, "negative": terms.NEGATIVE, "hp": terms.HIGH_PRECISION}
    for bag in bags.values():
        want = [sum(one(r, t.lower()) for t in bag) for r in rows]
        assert values(spark, rows, lambda c, bag=bag: lexicon.total(c, bag)) == want
    assert values(spark, rows, lambda c: lexicon.count(c, "car"))[0] == 2
    assert values(spark, ["used cars"], lambda c: lexicon.total(c, terms.NEGATIVE)) == [2]


def test_bucket_signal(spark):
    assert values(spark, ["turnkey solutions", "turnke", ""], lambda c: lexicon.some_of(c, terms.FITOUT, 2)) == [1.0, 0.0, 0.0]


def test_emails(spark):
    rows = ["a(at)x.com", "a (at) x.com", "us at x.com", "A@B.Co, c@d.org", "none"]
    assert values(spark, rows, contacts.emails) == [["a@x.com"], [], ["us@x.com"], ["a@b.co", "c@d.org"], []]
    raw = '<a href="mailto:a@x.com,b@x.com?subject=q"> <i data-email=\'C@x.com\'>'
    assert sorted(set(values(spark, [raw], contacts.attribute_emails)[0])) == ["a@x.com", "b@x.com", "c@x.com"]
    code = "5a" + "".join(f"{b ^ 0x5A:02x}" for b in b"info@x.com")
    assert values(spark, [f'<a data-cfemail="{code}">', '<a data-cfemail="5">', None], contacts.protected_emails) == [["info@x.com"], [], []]
    assert values(spark, ['"info" + "@" + "x.com"', "'a' + \"@\" + 'b'"], contacts.joined_emails) == [["info@x.com"], []]


def test_phones(spark):
    rows = ["+966 50 123 4567", "0501234567", "00966501234567", "920012345", "+1 (743) 555-3824", "12345678901", "+9661"]
    assert [values(spark, [r], contacts.phones)[0] for r in rows[:5]] == [["+966501234567"], ["+966501234567"], ["+966501234567"], ["+966920012345"], ["+17435553824"]]
    assert values(spark, rows[5:], contacts.phones) == [[], []]
    assert values(spark, ['<a href="tel:+966501234567?x">'], contacts.attribute_phones)[0][0] == "+966501234567"
    assert values(spark, ["see https://wa.me/966x and http://API.whatsapp.com/send?p"], contacts.whatsapp) == [["https://wa.me/966x", "http://API.whatsapp.com/send?p"]]


def test_sections_and_json_ld(spark):
    html = (
        "<title>T &amp; x</title><meta name='description' content='D'><meta content='no' name='description'><meta property='og:site_name' content='S'>"
        "<h1>One</h1><h1>Two</h1><h2>a</h2><h2>b</h2><h2>c</h2><div class='my-contact'>Call</div><footer>F</footer>"
        "<script type='application/ld+json'>{bad</script><script type='application/ld+json'>{\"@type\":\"Organization\",\"name\":\"N\",\"address\":{\"addressLocality\":\"Riyadh\",\"addressCountry\":{\"name\":\"SA\"}}}</script>"
    )
    got = spark.createDataFrame([(html,)], "x string").select(page.sections(F.col("x")).alias("s"), page.json_ld(F.col("x")).alias("l")).first()
    assert got["s"].asDict() == {"title": "T & x", "meta": "D S", "h1": "One", "h2": "a b", "footer": "F", "contact": "Call"}
    assert got["l"].asDict() == {"name": "N", "city": "Riyadh", "country": "SA"}


def test_company_name(spark):
    name = lambda title, h1, ld: spark.range(1).select(page.company_name(F.lit("shop.a.sa"), F.lit(title), F.lit(h1), F.lit(ld))).first()[0]
    assert name("walk-in closets", "", None) == "walk"
    assert name("home", "", None) == "unknown"
    assert name("", "ab", None) == "shop"
    assert name("x", "y", "LD Co") == "LD Co"


def test_city_first_of_equals(spark):
    got = spark.range(1).select(page.city(F.lit("jeddah riyadh"), F.lit(""), F.lit(None).cast("string")), page.city(F.lit("jeddah jeddah"), F.lit("riyadh"), F.lit(None).cast("string"))).first()
    assert tuple(got) == ("riyadh", "riyadh")


def test_terms_that_overlap_themselves(spark):
    from sitesift.functions import lexicon

    rows = spark.createDataFrame([("co co co",), ("a-a-a x",), ("anna anna",)], "t string")
    for term in ("co co", "a-a", "anna"):
        got = rows.select(lexicon.total(F.col("t"), [term, "x"]).alias("a"), (lexicon.count(F.col("t"), term) + lexicon.count(F.col("t"), "x")).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
