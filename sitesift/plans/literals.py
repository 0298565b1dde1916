"""Rows given as literals for queries whose branches the synthetic pages never take, and what each has to give, worked out by hand."""

from __future__ import annotations

# "info@x.sa" with each byte xor 0x5a, after the key 5a.
_PROTECTED = "5a" + "".join(f"{b ^ 0x5A:02x}" for b in b"info@x.sa")

CONTACTS = [
    ("write to Sales (at) Acme.com or a@b.sa, a@b.sa", ""),
    ("", '<a href="mailto:one@x.sa,two@x.sa?subject=hi">m</a>'),
    ("", f'<span data-cfemail="{_PROTECTED}">[protected]</span>'),
    ("", '<script>var e = "Info" + "@" + "x.com.sa";</script>'),
    ("call 050 123 4567 or +966 11 234 5678", '<a href="tel:+966551234567">t</a>'),
    ("https://wa.me/966551234567 now", '<a href="https://api.whatsapp.com/send?phone=1">w</a>'),
    ("", '<p data-email="d%40x.sa" data-phone="0551234567"></p>'),
    ("no contact 12 34", "<p>none</p>"),
    ("00971 4 123 4567 and 0123", ""),
]
JSON_LD = [
    ('<script type="application/ld+json">{"@type": "Organization", "name": " Acme ", "address": {"addressLocality": "Riyadh", "addressCountry": "SA"}}</script>',),
    ('<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type": "Person", "name": "P"}, {"@type": ["Thing", "Store"], "name": "S", "address": {"addressCountry": {"name": "KSA"}}}]</script>',),
    ('<script type="application/ld+json">{"@type": "WebSite", "name": "W"}</script>',),
    ("<p>none</p>",),
]
SECTIONS = [
    ('<title>T &amp; U</title><meta name="description" content="D"><meta property="og:site_name" content="S"><meta property="og:title" content="O"><h1>A</h1><h1>B</h1><h2>1</h2><h2>2</h2><h2>3</h2><footer>F</footer>',),
    ('<div id="contact">C1 <b>x</b></div><section class="page-footer">C2</section><div class="reach-us">C3</div>',),
    ("",),
]
CODED = [("&lt;a&gt; &amp;lt; &#65;&#x42; &copy;",), ("&notin; &frac12 x",), ("100% a%40b %zz %e9",), ("a+b%2Bc",)]
BODIES = [("<style>x</style><p>One &amp; two</p><script>no</script> <!-- kept --> three",), ("",)]
URLS = ["acme.sa", " https://www.b.sa/x ", "acme.sa", "http://acme.sa/y", ""]
ERRORS = [("HTTP 429: Quota exceeded", "{}"), ("", '{"error": {"status": "RESOURCE_EXHAUSTED"}}'), ("", '{"error": {"details": [{"reason": "dailyLimit"}]}}'), ("timeout", "{}"), ("", '{"error": {"message": "bad key"}}')]


def _sql(columns: str, rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({columns})"


_SITES = """with h as (select page_id, lower(regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '')) as domain from pages),
c as (select domain, min(page_id) as first from h where domain not in ('', 'facebook.com', 'instagram.com', 'linkedin.com', 'twitter.com', 'x.com', 'youtube.com', 'tiktok.com', 'maps.google.com', 'google.com', 'pinterest.com') group by 1),
p as (select * from c order by first, domain limit 40), k as (select distinct domain from h where page_id % 5 = 0)"""

ORACLE_SQL = {
    "q_service_run": f"{_SITES} select 'r1' as run_id, sha1(domain) as lead_id, '2024-02-01' as created_at from p where domain not in (select domain from k)",
    "q_master_leads": f"""{_SITES}, a as (select domain from k union select domain from p)
select sha1(domain) as lead_id, case when domain in (select domain from k) then '2024-01-01' else '2024-02-01' end as created_at, case when domain in (select domain from p) then '2024-02-01' else '2024-01-01' end as last_seen_at from a""",
    "q_page_cache": "select url, max(page_id) >= 100 as cached from pages group by 1",
    "q_contacts": _sql(
        "id, emails, phones, whatsapp, websites",
        [
            (0, "a@b.sa", "", "", "x.sa"), (1, "one@x.sa two@x.sa", "", "", "x.sa"), (2, "info@x.sa", "", "", "x.sa"), (3, "info@x.com.sa", "", "", "x.sa"),
            (4, "", "+966112345678 +966501234567 +966551234567", "", "x.sa"), (5, "", "+966551234567", "https://api.whatsapp.com/send?phone=1 https://wa.me/966551234567", "x.sa"),
            (6, "d@x.sa", "+966551234567", "", "x.sa"), (7, "", "", "", "x.sa"), (8, "", "+97141234567", "", "x.sa"),
        ],
    ),
    "q_json_ld": "select id, name, city, country from (values (0, 'Acme', 'Riyadh', 'SA'), (1, 'S', null, 'KSA'), (2, null, null, null), (3, null, null, null)) as t(id, name, city, country)",
    "q_page_sections": _sql("id, title, meta, h1, h2, footer, contact", [(0, "T & U", "D S O", "A", "1 2", "F", ""), (1, "", "", "", "", "", "C1 x C2"), (2, "", "", "", "", "", "")]),
    "q_decoded": _sql(
        "id, native, whole, percent",
        [
            (0, "<a> &lt; AB ©", "<a> &lt; AB ©", "&lt;a&gt; &amp;lt; &#65;&#x42; &copy;"), (1, "&notin; &frac12 x", "∉ ½ x", "&notin; &frac12 x"),
            (2, "100% a%40b %zz %e9", "100% a%40b %zz %e9", "100% a@b %zz �"), (3, "a+b%2Bc", "a+b%2Bc", "a+b+c"),
        ],
    ),
    "q_body_text": _sql("id, text", [(0, "One & two three"), (1, "")]),
    "q_manual_urls": _sql("domain, example_url, rank, query", [("acme.sa", "http://acme.sa/y", 3, "manual_urls"), ("b.sa", "https://www.b.sa/x", 2, "manual_urls")]),
    "q_search_cache": _sql("q, state", [("b", "hit"), ("a", "miss"), ("c", "miss")]),
    "q_quota": _sql("id, exhausted", [(0, True), (1, True), (2, True), (3, False), (4, False)]),
}
