"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions import terms
from ..functions.lexicon import latin
from .config import ScoringConfig
from .evaluation_sql import FLAGS, RECALL_FLAGS, case_sites, evaluation, flags, numbers

_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1))"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}]+', ' ', 'g'))"


def _page_text(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}.*?>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?is)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    for name, char in (("nbsp", " "), ("amp", "&"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"substr({_collapse(x)}, 1, 200000)"


def _entities(x: str) -> str:
    for name, char in (("nbsp", "\u00a0"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _strip(x: str) -> str:
    return _collapse(_entities(f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"))


def _first(pattern: str) -> str:
    return _strip(f"regexp_extract(html, '(?is){pattern}', 1)")


def _count(x: str, term: str) -> str:
    """Boundary counts by doubling what is not alphanumeric, as RE2 looks neither ahead nor behind."""
    if not latin(term):
        return f"((length({x}) - length(replace({x}, '{term}', ''))) // {len(term)})"
    spread = "".join(c if c.isalnum() else f"\\{c}\\{c}" if c != " " else "  " for c in term)
    return f"len(regexp_extract_all(' ' || regexp_replace({x}, '([^a-z0-9])', '\\1\\1', 'g') || ' ', '[^a-z0-9]{spread}[^a-z0-9]'))"


def _weighted(words: list[str]) -> str:
    sections = (("title", 3.0), ("h1", 2.0), ("footer", 1.5), ("norm", 1.0))
    return "cast(" + " + ".join(f"{w} * ({' + '.join(_count(s, t) for t in words)})" for s, w in sections) + " as double)"


def _some(words: list[str], least: int) -> str:
    return f"case when {' + '.join(f'cast(contains(norm, {t!r}) as int)' for t in words)} >= {least} then 1.0::double else 0.0::double end"


_NORM = f"norm as (select page_id, url, html, {_collapse('lower(' + _page_text('html') + ')')} as norm, {_DOMAIN} as domain, {_PATH} as path from pages)"
_WORDS = "cast(len(regexp_extract_all(norm, '[a-zA-Z]{2,}|[\\x{0600}-\\x{06FF}]{2,}')) as bigint)"
_SMALL = f"""sec as (select *, {_collapse('lower(' + _first('<title[^>]*>(.*?)</title>') + ')')} as title, {_collapse('lower(' + _first('<h1[^>]*>(.*?)</h1>') + ')')} as h1,
  {_collapse('lower(' + _first('<footer[^>]*>(.*?)</footer>') + ')')} as footer from norm),
cnt as (select page_id, {_weighted(["of the", "the", "und"])} as hp, {_weighted(["the", "that", "la", "en"])} as mp, {_weighted(["and", "for", "is"])} as biz, {_weighted(["re", "ou"])} as neg,
  {_weighted(["th", "die"])} as kitchen_hits, {_some(["of", "to", "was"], 2)} as fitout, {_some(["in", "is", "st"], 2)} as portfolio, {_WORDS} as words from sec)"""
_QUERY = f"coalesce(nullif(regexp_extract({_PATH}, '^/*([^/]+)', 1), ''), '')"
_HITS = f"hit as (select page_id as seq, {_DOMAIN} as domain, trim(url) as url, {_QUERY} as query, strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%S') as at from pages where trim(url) <> '' and {_DOMAIN} not in ('', 'facebook.com', 'instagram.com', 'linkedin.com', 'twitter.com', 'x.com', 'youtube.com', 'tiktok.com', 'maps.google.com', 'google.com', 'pinterest.com'))"
_LEADS = f"lead as (select page_id, {_DOMAIN} as domain, case when page_id % 3 = 0 then '' else 'p' || page_id || '@x.com' end as email, '' as phone, cast(page_id as varchar) as discovered_at, sha1({_DOMAIN}) as lead_id from pages)"


def _log(x: str, cap: int) -> str:
    return f"case when {x} > 0 then least(1.0, ln(1 + {x}) / ln(1 + {cap}.0)) else 0 end"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words) + "]"


def _links(source: str) -> str:
    """f: links of the source's pages (page_id, url, html) to their own domain; nth counts those of one URL."""
    href = """'(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
    return f"""l as (select page_id, url, {_DOMAIN} as domain, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as origin, regexp_extract_all(html, {href}, 1)[1:250] as h, regexp_extract_all(html, {href}, 2)[1:250] as b from {source}),
u as (select page_id, domain, origin, unnest(range(len(h))) as i, unnest(h) as h, unnest(b) as b from l),
a as (select page_id, i, regexp_replace({_entities("case when starts_with(h, '/') then origin || h else h end")}, '#.*$', '') as link, {_strip('b')} as anchor, domain from u where h <> ''),
f as (select *, row_number() over (partition by page_id, link order by i) as nth from a where regexp_replace(lower(regexp_extract(link, '//([^/?#]*)', 1)), '^www\\.', '') = domain)"""


def _wanted(source: str) -> str:
    """wanted: page_id, nr (from 1), link: home, then the best link of each kind, or guesses where there is no link."""

    def score(words: list[str], more: str = "0") -> str:
        return " + ".join(f"100 * cast(contains(lower(link), '{w}') as int) + 80 * cast(contains(lower(anchor), '{w}') as int)" for w in (w.lower() for w in words)) + f" + {more}"

    scores = (
        score(terms.LINK_CONTACT, "20 * cast(regexp_matches(lower(link), 'whatsapp|wa\\.me') as int)"), score(terms.LINK_ABOUT), score(terms.LINK_SERVICES),
        score(terms.LINK_PROJECTS, "10 * cast(regexp_matches(lower(link), 'gallery|portfolio') as int)"),
    )
    return f"""{_links(source)},
k as (select page_id, i, link, unnest([1, 2, 3, 4]) as place, unnest([{", ".join(scores)}]) as score from f where nth = 1),
best as (select page_id, place, arg_max(link, score * 1000 - i) as link from k where score > 0 group by page_id, place),
folder as (select page_id, case when bare = origin then origin || '/' else regexp_extract(bare, '^(.*/)', 1) end as folder
  from (select page_id, regexp_extract(url, '^[^?#]*') as bare, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as origin from {source}) where page_id not in (select page_id from f)),
each as (select page_id, 0 as place, url as link from {source} union all select * from best
  union all select page_id, unnest([1, 2, 3, 4, 5]), folder || unnest(['contact', 'contact-us', 'about', 'services', 'projects']) from folder),
placed as (select page_id, row_number() over (partition by page_id order by min(place)) as nr, link from each group by page_id, link),
wanted as (select * from placed where nr <= 5)"""


def _collected(source: str) -> str:
    """The end of a query over `wanted` and `fetched` (url, ok, body): what is read of each site."""
    return f"""plain as (select url, ok, {_page_text('body')} as t from fetched),
got as (select w.page_id, w.nr, coalesce(p.ok, false) as ok, p.t from wanted w left join plain p on p.url = w.link),
alive as (select page_id from got where nr = 1 and ok),
done as (select page_id, cast(length(coalesce(string_agg(t, chr(10) order by nr) filter (where ok and t <> ''), '')) as bigint) as chars, count(*) filter (where ok and t <> '') as visited, count(*) filter (where not ok) as failed
  from got where page_id in (select page_id from alive) group by 1)
select s.url, coalesce(d.chars, 0) as chars, coalesce(d.visited, 0) as visited, coalesce(d.failed, 1) as failed from {source} s left join done d using (page_id)"""


#: As the registry's own: links renamed so that kinds of pages occur, and none at all on every fifth page.
_NAMED = """named as (select page_id, url, case when page_id % 5 = 0 then replace(html, '<a ', '<b ') else replace(replace(replace(replace(html, 'href="/a', 'href="/about-'), 'href="/t', 'href="/our-work/'),
  'href="/e', 'href="/services/e'), 'href="/d', 'href="/contact/whatsapp-') end as html from pages)"""


_KEYWORDS = [(t, w) for t, ws in (("kitchen_en", terms.QUERY_KITCHEN_EN), ("kitchen_ar", terms.QUERY_KITCHEN_AR), ("fitout_en", terms.QUERY_FITOUT_EN), ("fitout_ar", terms.QUERY_FITOUT_AR), ("architect_en", terms.QUERY_ARCHITECT_EN), ("architect_ar", terms.QUERY_ARCHITECT_AR)) for w in ws]
_GENERATED = f"""c as (select * from (values {', '.join(f"({i}, '{c}')" for i, c in enumerate(terms.QUERY_CITIES))}) as t(c, city)),
k as (select * from (values {', '.join(f"({i}, '{t}', '{w}')" for i, (t, w) in enumerate(_KEYWORDS))}) as t(k, tag, word)),
g as (select cast(c * {len(_KEYWORDS)} + k as bigint) as seq, word || ' ' || city as q, tag, city from c, k)"""
_ANY = lambda x, words: f"(len(list_filter({_list(words)}, lambda t: contains({x}, t))) > 0)"

ORACLE_SQL: dict[str, str] = {
    "q_domain_normalize": f"select page_id, {_DOMAIN} as domain, regexp_replace(lower(split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1)), '^www\\.', '') as crude, case when trim(url) = '' then '' when regexp_matches(trim(url), '^https?://') then trim(url) else 'https://' || trim(url) end as with_http, {_PATH} as path from pages",
    "q_platform_filter": f"with {_HITS} select domain, count(*) as pages from hit group by 1",
    "q_path_depth": f"select cast(len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) as bigint) as depth, count(*) as pages from pages group by 1",
    "q_html_text": f"select page_id, length({_page_text('html')}) as chars, sha256({_page_text('html')}) as text_sha256 from pages",
    "q_word_count": f"with {_NORM}, w as (select page_id, {_WORDS} as words, length(norm) as chars from norm) select *, words <= 30 or chars < 200 as empty_content from w",
    "q_sections": f"select page_id, {_first('<title[^>]*>(.*?)</title>')} as title, {_first('<h1[^>]*>(.*?)</h1>')} as h1, {_first('<footer[^>]*>(.*?)</footer>')} as footer, '' as meta, {_first('<h2[^>]*>(.*?)</h2>')} as h2 from pages",
    "q_term_counts": f"with n as (select doc_id, {_collapse('lower(text)')} as norm from documents) select doc_id, {_count('norm', 'the')} as n_the, {_count('norm', 'of the')} as n_of_the, {_count('norm', 're')} as n_re, {_count('norm', 'und')} as n_und from n",
    "q_term_substrings": f"with n as (select doc_id, {_collapse('lower(text)')} as norm from documents) select doc_id, {_count('norm', 'é')} as n_e_acute, {_count('norm', 'ö')} as n_o_umlaut, {_count('norm', 'ñ')} as n_tilde from n",
    "q_weighted_counts": f"with {_NORM}, {_SMALL} select * from cnt",
    "q_density_score": f"with {_NORM}, {_SMALL}, x as (select *, (hp + 0.5 * mp) / greatest(words, 300) as density from cnt), y as (select *, 35 * ({_log('hp', 12)}) + 18 * ({_log('mp', 40)}) + 15 * ({_log('biz', 12)}) + 20 * least(1.0, density * 120) - 35 * ({_log('neg', 8)}) as parts from x) select page_id, round(density, 6) as density, cast(greatest(0, least(100, round_even(round(parts, 6), 0))) as integer) as score from y",
    "q_emails": "with e as (select doc_id, regexp_extract_all(replace(replace(replace(text, '(at)', '@'), '[at]', '@'), ' at ', '@'), '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b') as e from documents) select doc_id, unnest(range(1, len(e) + 1)) as pos, lower(unnest(e)) as email from e",
    "q_phone_candidates": "with e as (select doc_id, regexp_extract_all(text, '\\+?[0-9][0-9\\s().\\-]{7,}[0-9]') as e from documents) select doc_id, unnest(range(1, len(e) + 1)) as pos, unnest(e) as phone from e",
    "q_source_type": f"""with {_NORM}, s as (select *, len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 1 as home, regexp_matches(path, '/blog|/news|/post|/article|/insights|/press|/updates') as art,
  regexp_matches(domain, '\\.(gov|edu)\\.sa$|moc\\.gov\\.sa|momah\\.gov\\.sa|balady\\.gov\\.sa') or contains(norm, 'e-services') as official,
  {_ANY('domain', terms.MARKETPLACE_HOSTS)} or regexp_matches(path, '/tags/|/property/|/details|/listing|/classified|/ad/|/in/') as listed from norm)
select page_id, case when official then 'gov_edu' when listed then 'marketplace' when art and not home then 'article'
  when regexp_matches(path, '/product|/category|/categories|/catalog|/cart|/checkout|/shop') or regexp_matches(norm, 'add to cart|checkout|basket|سلة|الدفع') then 'ecommerce' else 'company_site' end as source_type,
  art and home and not official and not listed as guard from s""",
    "q_geo_signals": f"""with {_NORM}, c as (select page_id, norm, domain, t.city, (length(norm) - length(replace(norm, t.city, ''))) // length(t.city) as n, t.i
  from norm, (select unnest({_list(terms.CITIES)}) as city, unnest(range({len(terms.CITIES)})) as i) as t),
b as (select page_id, any_value(norm) as norm, any_value(domain) as domain, max(n) as n, coalesce(arg_max(city, n * 1000 - i), 'unknown') as best, bool_or(contains(norm, city)) as has from c group by 1),
k as (select *, case when n > 0 then best else 'unknown' end as city, case when regexp_matches(norm, 'saudi|ksa|السعود') then 1.0 when n > 0 then 0.85 when has then 0.8 when ends_with(domain, '.sa') then 0.7 else 0.0 end::double as ksa from b)
select page_id, city, ksa, ksa < 0.7 and (ends_with(domain, '.ae') or {_ANY('norm', terms.FOREIGN)}) as non_ksa, case when ends_with(domain, '.sa') or regexp_matches(norm, 'saudi|ksa|السعود') then 'Saudi Arabia' else 'unknown' end as country from k""",
    "q_company_name": f"""with t as (select page_id, {_DOMAIN} as domain, {_collapse('lower(' + _first('<title[^>]*>(.*?)</title>') + ')')} as title, {_collapse('lower(' + _first('<h1[^>]*>(.*?)</h1>') + ')')} as h1 from pages),
n as (select page_id, coalesce(nullif(trim(regexp_split_to_array(title, '\\s*(?:\\||-|–|—|:|::)\\s*')[1]), ''), case when length(h1) >= 3 then h1 end, split_part(split_part(domain, ':', 1), '.', 1)) as name from t),
c as (select page_id, trim(regexp_replace(name, '(?i)\\b(home|homepage|official|website)\\b', '', 'g')) as name from n) select page_id, case when name = '' then 'unknown' else name end as company_name from c""",
    "q_hit_rank": f"with {_HITS} select cast(seq // 10 as bigint) as response, row_number() over (partition by seq // 10 order by seq) as rank, url from hit",
    "q_source_text": f"with {_HITS} select domain, 'google_cse|query=' || arg_min(query, seq) || '|rank=1|url=' || arg_min(url, seq) as source from hit group by 1",
    "q_site_texts": f"with p as (select {_DOMAIN} as site, page_id, {_page_text('html')} as t from pages) select site, count(*) filter (where t <> '') as pages, sha256(coalesce(string_agg(t, chr(10) order by page_id) filter (where t <> ''), '')) as text_sha256 from p group by 1",
    "q_links": f"with {_links('pages')} select page_id, row_number() over (partition by page_id order by i) as pos, link, anchor from f where nth = 1",
    "q_best_links": f"with {_wanted('pages')} select s.url, string_agg(w.link, ' ' order by w.nr) as wanted from wanted w join pages s using (page_id) group by s.page_id, s.url",
    "q_best_links_named": f"with {_NAMED}, {_wanted('named')} select s.url, string_agg(w.link, ' ' order by w.nr) as wanted from wanted w join named s using (page_id) group by s.page_id, s.url",
    "q_collect_sites": f"with {_wanted('pages')}, fetched as (select url, page_id % 7 <> 0 as ok, html as body from pages), {_collected('pages')}",
    "q_collect_linked": f"""with {_NAMED}, {_wanted('named')}, fetched as (select url, page_id % 7 <> 0 as ok, html as body from named
  union all (select distinct link, length(link) % 3 <> 0, case when length(link) % 3 = 1 then '' else '<p>' || link || '</p>' end from wanted where nr > 1 and length(link) % 5 <> 0 and link not in (select url from named))), {_collected('named')}""",
    "q_upsert_leads": f"""with {_LEADS}, o as (select domain, arg_min(lead_id, page_id) as lead_id, arg_min(discovered_at, page_id) as discovered_at, coalesce(arg_max(email, page_id) filter (where email <> ''), '') as email from lead where page_id % 2 = 0 group by 1),
n as (select domain, arg_min(lead_id, page_id) as lead_id, arg_min(discovered_at, page_id) as discovered_at, coalesce(arg_max(email, page_id) filter (where email <> ''), '') as email from lead where page_id % 2 = 1 group by 1)
select coalesce(n.domain, o.domain) as domain, coalesce(nullif(n.email, ''), o.email, n.email) as email, '' as phone, coalesce(o.discovered_at, n.discovered_at) as discovered_at, coalesce(o.lead_id, n.lead_id) as lead_id from o full join n on o.domain = n.domain""",
    "q_new_vs_known": f"with {_LEADS}, n as (select distinct lead_id, domain from lead where page_id % 2 = 1) select *, case when lead_id in (select lead_id from lead where page_id % 2 = 0) then 'known' else 'new' end as state from n",
    "q_run_metrics": f"with {_LEADS}, n as (select distinct lead_id from lead where page_id % 2 = 1), k as (select distinct lead_id from lead where page_id % 2 = 0) select count(*) as leads_found_total, count(*) filter (where k.lead_id is null) as leads_new, count(k.lead_id) as leads_duplicates from n left join k on n.lead_id = k.lead_id",
    "q_keyset_page": f"with {_LEADS}, r as (select page_id + 1 as id, lead_id from lead order by 1 limit 50), m as (select max(id) as c from r) select page_id + 1 as id, lead_id from lead, m where page_id + 1 > c order by 1 limit 50",
    "q_signal_keys": f"with {_NORM} select case when page_id % 2 = 0 then 'total_words' else 'chars' end as key, count(*) as n, cast(sum(case when page_id % 2 = 0 then {_WORDS} else length(norm) end) as double) as total from norm group by 1",
    "q_csv_wide_signals": f"with {_NORM}, {_LEADS} select lead_id, l.domain, email, discovered_at, case when page_id % 2 = 1 then cast(cast(length(norm) as double) as varchar) else '' end as signal_chars, case when page_id % 2 = 0 then cast(cast({_WORDS} as double) as varchar) else '' end as signal_total_words from norm join lead l using (page_id)",
    "q_query_generator": f"with {_GENERATED} select * from g",
    "q_search_requests": f"with {_GENERATED} select seq, page, q, 1 + page * 10 as start from g, (select unnest(range(3)) as page)",
    "q_last_seen": f"with {_HITS} select * from (select domain, seq, url, row_number() over (partition by domain order by seq desc) as place from hit) where place <= 20",
    # without a (query, url) that comes back after it was dropped, the kept hits are the last 20 first occurrences
    "q_candidate_fold": f"""with {_HITS}, f as (select domain, query, url, min(seq) as seq from hit group by 1, 2, 3), r as (select *, row_number() over (partition by domain order by seq desc) as i from f),
k as (select domain, count(*) as kept, sha256(string_agg(url, '|' order by seq)) as urls_sha256 from r where i <= 20 group by 1)
select domain, arg_min(hit."at", hit.seq) as first_seen_at, arg_max(hit."at", hit.seq) as last_seen_at, arg_min(hit.url, hit.seq) as example_url, any_value(kept) as kept, any_value(urls_sha256) as urls_sha256 from hit join k using (domain) group by 1""",
    "q_stream_upsert": "with e as (select cast(user_id as varchar) as domain, event_id, case when event_type = 'click' then event_type || event_id else '' end as email from events) select domain, sha1(domain) as lead_id, coalesce(arg_max(email, event_id) filter (where email <> ''), '') as email, '' as phone, cast(min(event_id) as varchar) as discovered_at from e group by 1",
}


_PLAIN = f"""raw as (select page_id, url, {_collapse('lower(' + _first('<title[^>]*>(.*?)</title>') + ')')} as title, {_collapse('lower(' + _first('<h1[^>]*>(.*?)</h1>') + ')')} as h1,
  {_collapse('lower(' + _first('<footer[^>]*>(.*?)</footer>') + ')')} as footer, {_page_text('html')} as given from pages)"""
_COUNTRY = "case when ends_with(domain, '.sa') or regexp_matches(norm, 'saudi|ksa|السعود') then 'Saudi Arabia' else 'unknown' end"
_NAME = """(select case when c = '' then 'unknown' else c end from (select trim(regexp_replace(coalesce(nullif(trim(regexp_split_to_array(title, '\\s*(?:\\||-|–|—|:|::)\\s*')[1]), ''), case when length(h1) >= 3 then h1 end, split_part(split_part(domain, ':', 1), '.', 1)), '(?i)\\b(home|homepage|official|website)\\b', '', 'g')) as c))"""
_PRECISE = f"page_id, domain, score as relevance_score, decision, lead_type, category, source_type, {_COUNTRY} as country, city, confidence"
_RECALLED = f"page_id, domain, recall_score as relevance_score, recall_decision as decision, lead_type, recall_category as category, source_type, {_COUNTRY} as country, city, recall_confidence as confidence"


def _evaluation(raw: str, select: str, config: ScoringConfig = ScoringConfig()) -> str:
    return f"with {evaluation(raw, _DOMAIN, _PATH, _collapse, config)} select {select} from out"


def evaluations(small: ScoringConfig) -> dict[str, str]:
    """SQL of the queries that evaluate sites; small: the registry's small lexicon."""
    cases = case_sites(_page_text("html"), _collapse)
    return {
        "q_evaluate_precision": _evaluation(_PLAIN, f"{_PRECISE}, {_NAME} as company_name, {numbers()}, {flags(FLAGS)}"),
        "q_evaluate_recall": _evaluation(_PLAIN, f"{_RECALLED}, {flags(RECALL_FLAGS)}"),
        "q_evaluate_small_lexicon": _evaluation(_PLAIN, f"page_id, score as relevance_score, decision, category, {numbers()}, {flags(FLAGS)}", small),
        "q_score_precision": _evaluation(cases, f"{_PRECISE}, {numbers()}"),
        "q_score_recall": _evaluation(cases, f"{_RECALLED}, {flags(RECALL_FLAGS)}"),
        "q_gates": _evaluation(cases, f"page_id, {flags(FLAGS)}"),
        "q_category": _evaluation(cases, "page_id, bucket, c_architect, c_fitout, c_showroom, c_designer, c_developer, proof"),
    }
