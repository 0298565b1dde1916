"""SQL for DuckDB that evaluates sites as `operators.evaluate` does: term counts by joining sections to a table of terms, then gates, score, decision and category."""

from __future__ import annotations

from ..functions import terms
from ..functions.lexicon import latin
from .config import ScoringConfig

#: Sites whose sections and texts hold terms of the default lexicon, by page_id modulo their number: url, title, h1, footer, what is added to the page's text.
CASES = [
    ("https://www.acme-kitchens.com.sa/", "Acme Kitchens | Home", "Kitchen showroom in Riyadh", "Riyadh, Saudi Arabia", "kitchen cabinets and modular kitchen design. visit our showroom, opening hours. call 050 123 4567 or info@acme-kitchens.com.sa. our projects"),
    ("https://buildco.sa/en", "BuildCo - contracting", "General contractor", "Jeddah", "turnkey fit-out contracting, interior finishing, general contractor in jeddah, engineering office. +966 11 234 5678 sales (at) buildco.sa"),
    ("https://studio.example.com/blog/2020/style", "News", "Interior trends", "", "interior design trends and architect portfolio"),
    ("https://haraj.com.sa/in/riyadh", "Sofa for sale", "Used kitchen", "", "for sale by owner, used kitchen, riyadh, call me 0551234567"),
    ("https://mart.example.com/product/12", "Shop", "Add to cart", "", "add to cart checkout basket"),
    ("https://store.example.ae/shop/sets", "Dubai store", "Kitchen sets", "Dubai", "kitchen cabinets kitchen showroom dubai add to cart our projects portfolio fit-out"),
    ("https://www.moe.gov.sa/", "Ministry", "e-services", "Riyadh", "saudi e-services"),
    ("https://carzone.com.sa/", "Cars dealership", "Car dealer", "", "cars auto dealership bank loan insurance riyadh"),
    ("https://devco.com.sa/ar/", "DevCo", "Real estate developer", "Dammam", "real estate developer, property development, master developer, construction company in dammam. project management. services and clients. info@devco.com.sa"),
    ("https://empty.sa", "", "", "", ""),
    ("https://www.madar-arch.com", "Madar: architects", "Architectural design", "Makkah", "architect architectural design engineering consultancy مكتب هندسي استشارات هندسية تصميم معماري الرياض السعودية https://wa.me/966551234567"),
]


def _values(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words if w) + "]"


def _patterns(words: list[str]) -> str:
    """Terms with the word that has to be there and a pattern over text in which all but letters and digits is doubled; null for a substring."""
    rows = []
    for w in words:
        t = w.lower()
        spread = "".join(c if c.isalnum() else f"\\{c}\\{c}" if c != " " else "  " for c in t)
        need = max(t.split(" "), key=len) if latin(t) else t
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        rows.append(f"({quote(t)}, {quote(need)}, {quote('[^a-z0-9]' + spread + '[^a-z0-9]') if latin(t) else 'null'})")
    return ", ".join(rows)


def _phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    whole = f"case when starts_with(trim({x}), '+') or starts_with({digits}, '00') then regexp_replace({digits}, '^00', '') when regexp_matches({digits}, '^966[0-9]{{8,10}}$') then {digits} else '966' || regexp_replace({digits}, '^0', '') end"
    return f"regexp_replace({whole}, '^9660', '966')"


_SAUDI = "'^966(5[0-9]{8}|1[1-7][0-9]{7}|800[0-9]{7}|811[0-9]{7}|9200[0-9]{5})$'"


def _log(x: str, cap: int) -> str:
    return f"case when {x} > 0 then least(1.0, ln(1 + {x}) / ln(1 + {cap}.0)) else 0 end"


def case_sites(page_text: str, collapse) -> str:
    """CTE `raw`: page_id, url, title, h1, footer (normalized), body text as given."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(map(q, c))})" for i, c in enumerate(CASES))
    low = lambda x: collapse(f"lower({x})")
    own = f"case when c.i = 9 then '' when page_id % 2 = 0 then {page_text} else '' end"
    return f"""cases(i, url, title, h1, footer, extra) as (values {rows}),
raw as (select page_id, c.url, {low('c.title')} as title, {low('c.h1')} as h1, {low('c.footer')} as footer, repeat(extra || ' ', 1 + page_id % 3) || {own} as given from pages join cases c on page_id % {len(CASES)} = c.i)"""


def evaluation(raw: str, domain: str, path: str, collapse, config: ScoringConfig) -> str:
    """CTEs up to `out`: everything that an evaluation tells of each row of `raw` (page_id, url, title, h1, footer, given)."""
    lex = config.lexicon
    lists = {
        "hp": lex.high_precision, "mp": lex.mid_precision, "biz": lex.business_intent, "neg": lex.negative, "kitchen_hits": lex.kitchen, "individual": lex.individual_markers,
        "business": lex.business_markers, "service_ev": terms.SERVICE_EVIDENCE, "developer_ev": terms.DEVELOPER_EVIDENCE, "b2b": terms.PROJECT_EVIDENCE, "c_showroom": lex.showroom,
        "c_fitout": lex.fitout, "c_architect": lex.architect, "c_developer": lex.developer, "c_designer": lex.designer, "proof": terms.SHOWROOM_PROOF, "hard": lex.hard_negative, "off": terms.OFF_VERTICAL,
    }
    bags = ", ".join(f"('{name}', '{t.lower().replace(chr(39), chr(39) * 2)}')" for name, words in lists.items() for t in words if t)
    every = sorted({t.lower() for words in lists.values() for t in words if t})
    summed = ",\n".join(f"  coalesce(sum(n * w) filter (where bag = '{name}' and kind = 'all'), 0.0) as {name}" for name in lists if name not in ("hard", "off"))
    some = lambda words, least: f"case when len(list_filter({_values(words)}, lambda t: contains(norm, t))) >= {least} then 1.0::double else 0.0::double end"
    places = f"(length(norm) - length(replace(norm, t, ''))) // length(t) + 2 * ((length(strong) - length(replace(strong, t, ''))) // length(t))"
    any_ = lambda x, words: f"(len(list_filter({_values(words)}, lambda t: contains({x}, t))) > 0)"
    cats = {"architect": f"1.02 * ({_log('c_architect', 14)})", "fit-out": _log("c_fitout", 14), "showroom": f"(case when proof >= 2 then least(1.0, 1.05 * ({_log('c_showroom', 10)}) + 0.1) else 1.05 * ({_log('c_showroom', 10)}) end)", "designer": _log("c_designer", 10), "developer": f"0.95 * ({_log('c_developer', 10)})"}
    top = "greatest(" + ", ".join(cats.values()) + ")"
    bucket = f"case when lead_type = 'B2C' then 'individual' when {top} <= 0 then 'unknown' " + " ".join(f"when abs({v} - {top}) < 1e-9 then '{k}'" for k, v in cats.items()) + " else 'unknown' end"
    return f"""{raw},
s0 as (select *, {domain} as domain, {path} as path, {collapse('lower(given)')} as norm, concat_ws(' ', title, h1, '', footer) as strong,
  list_filter(list_transform(regexp_extract_all(given, '\\+?[0-9][0-9\\s().\\-]{{7,}}[0-9]'), lambda x: {_phone('x')}), lambda p: regexp_matches(p, {_SAUDI}) or (not starts_with(p, '966') and length(p) between 10 and 15 and not starts_with(p, '0'))) as phones,
  regexp_matches(replace(replace(replace(given, '(at)', '@'), '[at]', '@'), ' at ', '@'), '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}\\b') as email, regexp_matches(given, '(?i)https?://(?:wa\\.me|api\\.whatsapp\\.com)/[^\\s"''<]+') as wa from raw),
towns as (select page_id, t, {places} as n, i from s0, (select unnest({_values(lex.cities)}) as t, unnest(range({len(lex.cities)})) as i)),
town as (select page_id, case when max(n) > 0 then arg_max(t, n * 1000 - i) else 'unknown' end as city from towns group by 1),
s1 as (select s0.*, city, len(phones) > 0 as phone, len(list_filter(phones, lambda p: starts_with(p, '966'))) > 0 as own_phone,
  len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 1 as home, regexp_matches(path, '/blog|/news|/post|/article|/insights|/press|/updates') as art,
  regexp_matches(domain, '\\.(gov|edu)\\.sa$|moc\\.gov\\.sa|momah\\.gov\\.sa|balady\\.gov\\.sa') or contains(norm, 'e-services') as official,
  {any_('domain', terms.MARKETPLACE_HOSTS)} or regexp_matches(path, '/tags/|/property/|/details|/listing|/classified|/ad/|/in/') as listed,
  cast(len(regexp_extract_all(norm, '[a-zA-Z]{{2,}}|[\\x{{0600}}-\\x{{06FF}}]{{2,}}')) as bigint) as words from s0 join town using (page_id)),
s2 as (select *, case when official then 'gov_edu' when listed then 'marketplace' when art and not home then 'article'
  when regexp_matches(path, '/product|/category|/categories|/catalog|/cart|/checkout|/shop') or regexp_matches(norm, 'add to cart|checkout|basket|سلة|الدفع') then 'ecommerce' else 'company_site' end as kind,
  art and home and not official and not listed as guard,
  case when own_phone or regexp_matches(norm, 'saudi|ksa|السعود') then 1.0 when city in (select unnest({_values(lex.cities)})) then 0.85 when {any_('norm', lex.cities)} then 0.8 when ends_with(domain, '.sa') then 0.7 else 0.0 end::double as ksa from s1),
s3 as (select *, ksa < 0.7 and (ends_with(domain, '.ae') or {any_('norm', terms.FOREIGN)}) as foreign_ from s2),
part as (select page_id, unnest(['title', 'h1', 'footer', 'body', 'domain']) as part, unnest([title, h1, footer, norm, domain]) as x from s3),
term(t, need, pattern) as (values {_patterns(every)}),
found as (select page_id, part, t, case when not contains(x, need) then 0 when pattern is null then (length(x) - length(replace(x, t, ''))) // length(t) else len(regexp_extract_all(' ' || regexp_replace(x, '([^a-z0-9])', '\\1\\1', 'g') || ' ', pattern)) end as n from part, term),
bag(bag, t) as (values {bags}),
weight(kind, part, w) as (values ('all', 'title', 3.0::double), ('all', 'h1', 2.0), ('all', 'footer', 1.5), ('all', 'body', 1.0), ('head', 'title', 3.0), ('head', 'h1', 2.0), ('hard', 'title', 1.0), ('hard', 'h1', 1.0), ('hard', 'domain', 1.0), ('front', 'domain', 3.0), ('front', 'title', 2.5), ('front', 'h1', 2.0), ('front', 'body', 1.0)),
cnt as (select page_id,
{summed},
  coalesce(sum(n * w) filter (where bag = 'neg' and kind = 'head'), 0.0) as neg_head, coalesce(sum(n * w) filter (where bag = 'hard' and kind = 'hard'), 0.0) as hard_head, coalesce(sum(n * w) filter (where bag = 'off' and kind = 'front'), 0.0) as off_vertical
  from found join bag using (t) join weight using (part) where n > 0 group by 1),
e0 as (select s3.*, {', '.join(f'coalesce({c}, 0.0)::double as {c}' for c in (*[n for n in lists if n not in ("hard", "off")], "neg_head", "hard_head", "off_vertical"))},
  {some(lex.kitchen, 1)} as kitchen, {some(lex.interior, 1)} as interior, {some(lex.fitout, 2)} as fitout, {some(lex.architect, 1)} as architect, {some(lex.portfolio, 2)} as portfolio,
  words <= 30 or length(norm) < 200 as empty_content from s3 left join cnt using (page_id)),
e1 as (select *, (hp + 0.5 * mp) / greatest(words, 300) as density, case when kind = 'marketplace' and individual >= 2 and business < 2 then 'B2C' else 'B2B' end as lead_type,
  kind = 'ecommerce' as shop, portfolio = 1 or fitout = 1 or hp >= 6 or b2b >= 1 as b2b_evidence, email or phone as reach, neg_head > 0 or hard_head > 0 as hard_hit, ksa >= 0.7 or ends_with(domain, '.sa') or own_phone as ksa_gate,
  hp >= 1 or (mp >= 20 and kitchen_hits >= 10) as keyword_gate, off_vertical >= 2 and hp < 2 and fitout = 0 and architect = 0 and interior = 0 as off_guard from e0),
e2 as (select *, case when shop and b2b_evidence then 'company_site' when shop then 'retail_catalog' else kind end as source_type,
  ksa_gate and reach and (fitout = 1 or architect = 1 or interior = 1 or service_ev >= 3) and (biz >= 2 or hp >= 1) as service_gate, ksa_gate and developer_ev >= 2 and (biz >= 2 or mp >= 20) as developer_gate,
  ksa_gate and reach and mp >= 20 and (hp >= 2 or fitout = 1 or (kitchen = 1 and portfolio = 1)) and neg < 40 as fallback_gate,
  (hp >= 6 or (fitout = 1 and mp >= 20) or (kitchen = 1 and portfolio = 1 and mp >= 20 and neg < 20)) and not hard_hit as capped, {bucket} as bucket,
  least(10, email::int * {config.has_email} + phone::int * {config.has_phone} + wa::int * {config.has_whatsapp})::double as contact_bonus,
  (case when ksa >= 0.7 then {config.ksa_bonus} else 0 end + case when foreign_ then {config.non_ksa_penalty} else 0 end)::double as geo_bonus from e1),
e3 as (select *, ((hp >= 2 or (hp >= 1 and biz >= 2 and density >= 0.015)) or (keyword_gate and ksa_gate) or developer_gate or fallback_gate or service_gate) and not empty_content as content_gate,
  case when source_type = 'company_site' and lead_type = 'B2B' and bucket = 'showroom' and kitchen = 1 and reach and neg <= 5 then 10.0 else 0.0 end::double as showroom_bonus, case when off_guard then -35.0 else 0.0 end::double as sanity_penalty,
  case source_type when 'gov_edu' then {config.penalty_gov_edu} when 'article' then {config.penalty_article} when 'marketplace' then {config.penalty_marketplace} when 'retail_catalog' then {config.penalty_retail_catalog} else 0 end::double as page_penalty,
  {config.negative_max} * ({_log('(neg + 1.5 * neg_head)', 8)}) as negative from e2),
e4 as (select *, {config.hp_max} * ({_log('hp', 12)}) + {config.mp_max} * ({_log('mp', 40)}) + {config.biz_max} * ({_log('biz', 12)}) + {config.density_max} * least(1.0, density * 120.0) + geo_bonus + contact_bonus + page_penalty
  + case when capped then greatest(negative, -15.0) else negative end + sanity_penalty + showroom_bonus as base from e3),
e5 as (select *, greatest(0, least(100, cast(round_even(case when not ksa_gate or not content_gate then least(base, 55.0) else base end, 0) as int))) as score,
  ksa >= 0.4 or ends_with(domain, '.sa') or own_phone as soft, kitchen = 1 or kitchen_hits >= 1 or fitout = 1 or interior = 1 or architect = 1 as clear from e4),
e6 as (select *, case when empty_content then 'review' when score >= {config.relevant} then 'accept' when score >= {config.maybe_low} or developer_gate then 'review' else 'reject' end as p_decision,
  case when score >= {config.relevant} then least(0.95, 0.72 + (score - {config.relevant}) / 100.0) when score < {config.maybe_low} then least(0.90, 0.60 + ({config.maybe_low} - score) / 100.0) else 0.55 end as sure,
  (foreign_ and not soft) or source_type in ('gov_edu', 'marketplace') or (hard_hit and not clear) as refuse,
  case when score >= {config.maybe_low} and source_type = 'company_site' then bucket when lead_type = 'B2C' and source_type = 'marketplace' then 'individual' else 'unknown' end as p_category from e5),
e7 as (select *, case when empty_content then least(sure, 0.35) else sure end as p_sure, case when refuse then 'reject' when empty_content then 'review' else 'accept' end as r_decision,
  case when not refuse and source_type in ('company_site', 'retail_catalog') then bucket when lead_type = 'B2C' and source_type = 'marketplace' then 'individual' else 'unknown' end as r_category from e6),
out as (select *, case when p_decision = 'accept' then 'accept' else 'reject' end as decision, round(case when p_decision = 'accept' then p_sure else least(p_sure, 0.60) end, 6)::double as confidence, case when p_decision = 'accept' then p_category else 'unknown' end as category,
  case when r_decision = 'accept' then 'accept' else 'reject' end as recall_decision, case when refuse then 10 when empty_content then 50 else 80 end as recall_score,
  round(case when r_decision = 'accept' then 0.60 else least(case when refuse then 0.80 else 0.35 end, 0.60) end, 6)::double as recall_confidence, case when r_decision = 'accept' then r_category else 'unknown' end as recall_category from e7)"""


#: Signals and what they are called in `out`.
NUMBERS = {
    "ksa_signal": "ksa", "kitchen_signal": "kitchen", "kitchen_hits": "kitchen_hits", "interior_signal": "interior", "fitout_signal": "fitout", "architect_signal": "architect", "portfolio_signal": "portfolio",
    "total_words": "words", "density": "density", "individual_intent": "individual", "business_markers_strength": "business", "service_evidence": "service_ev", "developer_evidence": "developer_ev",
    "page_penalty": "page_penalty", "contact_bonus": "contact_bonus", "geo_bonus": "geo_bonus", "hp_count": "hp", "mp_count": "mp", "biz_count": "biz", "neg_count": "neg", "neg_title_h1": "neg_head",
    "sanity_penalty": "sanity_penalty", "showroom_bonus": "showroom_bonus",
}
FLAGS = {
    "non_ksa": "foreign_", "has_email": "email", "has_phone": "phone", "has_whatsapp": "wa", "empty_content": "empty_content", "ecommerce_overridden": "shop and b2b_evidence", "retail_catalog": "shop and not b2b_evidence",
    "hard_negative_hit": "hard_hit", "article_guard_blocked": "guard", "off_vertical_guard": "off_guard", "ksa_gate": "ksa_gate", "content_gate": "content_gate", "content_gate_fallback": "fallback_gate",
    "content_gate_service": "service_gate", "content_gate_keyword": "keyword_gate", "content_gate_developer": "developer_gate", "neg_capped": "capped",
}
RECALL_FLAGS = {"recall_non_ksa_reject": "foreign_ and not soft", "recall_source_reject": "source_type in ('gov_edu', 'marketplace')", "recall_hard_negative_reject": "hard_hit and not clear", "recall_clear_kitchen": "clear", "recall_empty_review": "empty_content"}


def flags(named: dict[str, str]) -> str:
    return ", ".join(f"case when {v} then 1.0 else 0.0 end::double as {k}" for k, v in named.items())


def numbers() -> str:
    return ", ".join(f"round({v}::double, 6) as {k}" for k, v in NUMBERS.items())
