"""Site evaluation: evidence, gates, score, decision, category and reasons of each site, as one narrow projection chain.

Input: url, html, text. Nothing is shuffled. Each stage is a projection of its own, so that a text that many terms are counted in is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, page, terms
from ..functions.contacts import contacts, decoded_html
from ..functions.text import body_text, half_even, log_norm, normalize, word_count
from ..functions.urls import domain, path, segments
from ..plans.config import ScoringConfig

WEIGHTS = {"title": 3.0, "meta": 3.0, "h1": 2.0, "h2": 1.5, "contact": 2.0, "footer": 1.5}

# What page types are told by.
ARTICLE_PATHS = ["/blog", "/news", "/post", "/article", "/insights", "/press", "/updates"]
LISTING_PATHS = ["/tags/", "/property/", "/details", "/listing", "/classified", "/ad/", "/in/"]
SHOP_PATHS = ["/product", "/category", "/categories", "/catalog", "/cart", "/checkout", "/shop"]
SHOP_WORDS = ["add to cart", "checkout", "basket", "سلة", "الدفع"]
GOVERNMENT = ["moc.gov.sa", "momah.gov.sa", "balady.gov.sa"]
SOURCE_SIGNAL = {"company_site": 1.0, "ecommerce": 0.8, "retail_catalog": 0.6, "marketplace": 0.5, "article": 0.2, "gov_edu": 0.0}

SIGNALS = (
    "ksa_signal non_ksa source_type has_email has_phone has_whatsapp kitchen_signal kitchen_hits interior_signal fitout_signal architect_signal portfolio_signal total_words "
    "empty_content density individual_intent business_markers_strength service_evidence developer_evidence ecommerce_overridden retail_catalog page_penalty contact_bonus geo_bonus "
    "hp_count mp_count biz_count neg_count neg_title_h1 hard_negative_hit article_guard_blocked off_vertical_guard sanity_penalty ksa_gate content_gate content_gate_fallback "
    "content_gate_service content_gate_keyword content_gate_developer neg_capped showroom_bonus"
).split()
RECALL_SIGNALS = "recall_mode recall_non_ksa_reject recall_source_reject recall_hard_negative_reject recall_clear_kitchen recall_empty_review".split()


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(lexicon.literals(words), lambda w: F.contains(text, w))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def source_type(site_domain: Column, path_: Column, body: Column) -> Column:
    """type and guard. A page under an article path is one unless the URL looks like a home page; then the guard is set."""
    home = path_.isin("", "/", "/en", "/en/", "/ar", "/ar/") | (F.size(segments(path_)) <= 1)
    article = _any(path_, ARTICLE_PATHS)
    official = site_domain.rlike(r"\.(gov|edu)\.sa$") | _any(site_domain, GOVERNMENT) | F.contains(body, F.lit("e-services"))
    listed = _any(site_domain, terms.MARKETPLACE_HOSTS) | _any(path_, LISTING_PATHS)
    kind = (
        F.when(official, "gov_edu").when(listed, "marketplace").when(article & ~home, "article")
        .when(_any(path_, SHOP_PATHS) | _any(body, SHOP_WORDS), "ecommerce").otherwise("company_site")
    )
    return F.struct(kind.alias("type"), (article & home & ~official & ~listed).alias("guard"))


def ksa_signal(body: Column, phones: Column, site_domain: Column, city: Column, cities: list[str]) -> Column:
    low = [c.lower() for c in cities]
    return (
        F.when(F.exists(phones, lambda p: F.startswith(p, F.lit("+966"))) | body.rlike("saudi|ksa|السعود"), 1.0)
        .when(city.isin(low), 0.85).when(_any(body, low), 0.8).when(F.endswith(site_domain, F.lit(".sa")), 0.7).otherwise(0.0)
    )


def non_ksa(body: Column, ksa: Column, site_domain: Column) -> Column:
    return (ksa < 0.7) & (F.endswith(site_domain, F.lit(".ae")) | _any(body, terms.FOREIGN))


def texts(sites: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """url, domain, path, contacts, JSON-LD, normalized body and sections, and `strong`: the sections as often as they weigh, twice."""
    html, given = F.col("html"), F.col("text")
    has_html = F.coalesce(html != "", F.lit(False))
    body = F.when(F.coalesce(given != "", F.lit(False)), given).when(has_html, body_text(html)).otherwise("")
    held = sites.select("*", domain(F.col("url")).alias("domain"), path(F.col("url")).alias("path"), body.alias("body_text"), F.when(has_html, html).otherwise("").alias("page"))
    held = held.withColumns({"raw": decoded_html(F.col("page")), "sections": page.sections(F.col("page")), "ld": page.json_ld(F.col("page"))})
    held = held.withColumns({"contacts": contacts(F.col("body_text"), F.col("page"), F.col("raw"), F.col("domain")), "body": normalize(F.col("body_text")), **{s: normalize(F.col(f"sections.{s}")) for s in page.SECTIONS}})
    return held.drop("raw", "page", "sections", "body_text")


def counted(held: DataFrame, config: ScoringConfig) -> DataFrame:
    """The evidence counts of every list: each section is scanned once, and its matches stand as often as it weighs, twice."""
    lex, body = config.lexicon, F.col("body")
    lists = {
        "hp": lex.high_precision, "mp": lex.mid_precision, "biz": lex.business_intent, "neg": lex.negative, "kitchen_hits": lex.kitchen,
        "individual": lex.individual_markers, "business": lex.business_markers, "service_ev": terms.SERVICE_EVIDENCE, "developer_ev": terms.DEVELOPER_EVIDENCE,
        "b2b": terms.PROJECT_EVIDENCE, "c_showroom": lex.showroom, "c_fitout": lex.fitout, "c_architect": lex.architect, "c_developer": lex.developer,
        "c_designer": lex.designer, "proof": terms.SHOWROOM_PROOF,
    }
    guards = [*lex.hard_negative, *terms.OFF_VERTICAL]
    every = [t for words in lists.values() for t in words] + guards
    vocabulary = {"body": every, "title": every, "h1": every, "domain": guards, **{k: every for k in WEIGHTS}}
    out = held.withColumns({f"m_{k}": lexicon.matches(F.col(k), v) for k, v in vocabulary.items()})
    times = lambda **weights: F.flatten(F.array(*[F.flatten(F.array_repeat(F.col(f"m_{k}"), int(2 * w))) for k, w in weights.items()]))
    out = out.withColumns(
        {
            "m_all": times(**WEIGHTS, body=1.0), "m_head": times(title=3.0, h1=2.0, h2=1.5), "m_front": times(domain=3.0, title=2.5, h1=2.0, body=1.0),
            "m_hard": F.concat("m_title", "m_h1", "m_domain"),
        }
    )
    half = lambda found, words: (lexicon.tally(F.col(found), words) / 2).cast("double")
    out = out.withColumns(
        {
            **{name: half("m_all", words) for name, words in lists.items()},
            "neg_head": half("m_head", lex.negative), "hard_head": lexicon.tally(F.col("m_hard"), lex.hard_negative), "off_vertical": half("m_front", terms.OFF_VERTICAL),
            "kitchen": lexicon.some_of(body, lex.kitchen), "interior": lexicon.some_of(body, lex.interior), "fitout": lexicon.some_of(body, lex.fitout, 2),
            "architect": lexicon.some_of(body, lex.architect), "portfolio": lexicon.some_of(body, lex.portfolio, 2), "words": word_count(body),
        }
    )
    return out.drop(*[f"m_{k}" for k in (*vocabulary, "all", "head", "front", "hard")])


def categorized(lead_type: Column) -> Column:
    """The best bucket; of equals (to 1e-9) architect, fit-out, showroom, designer, developer in this order."""
    showroom = 1.05 * log_norm(F.col("c_showroom"), 10)
    showroom = F.when(F.col("proof") >= 2, F.least(F.lit(1.0), showroom + 0.10)).otherwise(showroom)
    scores = {"architect": 1.02 * log_norm(F.col("c_architect"), 14), "fit-out": log_norm(F.col("c_fitout"), 14), "showroom": showroom, "designer": log_norm(F.col("c_designer"), 10), "developer": 0.95 * log_norm(F.col("c_developer"), 10)}
    top = F.greatest(*scores.values())
    choice = F.when(lead_type == "B2C", "individual").when(top <= 0, "unknown")
    for name, score in scores.items():
        choice = choice.when(F.abs(score - top) < 1e-9, name)
    return choice.otherwise("unknown")


def confidence(score: Column, config: ScoringConfig) -> Column:
    sure = F.least(F.lit(0.95), 0.72 + (score - config.relevant) / 100)
    unsure = F.least(F.lit(0.90), 0.60 + (config.maybe_low - score) / 100)
    return F.when(score >= config.relevant, sure).when(score < config.maybe_low, unsure).otherwise(0.55)


def evaluate(sites: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """One row per site: url, domain, relevant, relevance_score, confidence, decision, lead_type, category, contacts, signals, reasons, source_type, company_name, country, city, empty_content.

    Further columns of `sites` are kept in front.
    """
    c, lex = F.col, config.lexicon
    kept = [x for x in sites.columns if x not in ("html", "text", "url")]
    held = texts(sites, config)
    strong_text = F.concat_ws(" ", "title", "h1", "contact", "footer")
    held = held.withColumns(
        {
            "source": source_type(c("domain"), c("path"), c("body")), "city": page.city(c("body"), strong_text, c("ld.city"), lex.cities),
            "country": page.country(c("body"), c("domain"), c("ld.country")), "company_name": page.company_name(c("domain"), c("title"), c("h1"), c("ld.name")),
        }
    )
    held = held.withColumn("ksa", ksa_signal(c("body"), c("contacts.phones"), c("domain"), c("city"), lex.cities))
    held = held.withColumn("foreign", non_ksa(c("body"), c("ksa"), c("domain")))
    held = counted(held, config)
    held = held.withColumns(
        {
            "email": F.size("contacts.emails") > 0, "phone": F.size("contacts.phones") > 0, "wa": F.size("contacts.whatsapp") > 0,
            "empty_content": (c("words") <= 30) | (F.length("body") < 200), "density": (c("hp") + 0.5 * c("mp")) / F.greatest(c("words"), F.lit(300)).cast("double"),
            "lead_type": F.when((c("source.type") == "marketplace") & (c("individual") >= 2) & (c("business") < 2), "B2C").otherwise("B2B"),
            "shop": c("source.type") == "ecommerce", "b2b_evidence": (c("portfolio") == 1) | (c("fitout") == 1) | (c("hp") >= 6) | (c("b2b") >= 1),
        }
    )
    held = held.withColumn("source_type", F.when(c("shop") & c("b2b_evidence"), "company_site").when(c("shop"), "retail_catalog").otherwise(c("source.type")))
    penalty = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("gov_edu", config.penalty_gov_edu), ("article", config.penalty_article), ("marketplace", config.penalty_marketplace), ("retail_catalog", config.penalty_retail_catalog), ("company_site", 0)) for x in p]), c("source_type")), F.lit(0))
    reach = c("email") | c("phone")
    held = held.withColumns(
        {
            "page_penalty": penalty.cast("double"),
            "contact_bonus": F.least(F.lit(10), c("email").cast("int") * config.has_email + c("phone").cast("int") * config.has_phone + c("wa").cast("int") * config.has_whatsapp).cast("double"),
            "geo_bonus": (F.when(c("ksa") >= 0.7, config.ksa_bonus).otherwise(0) + F.when(c("foreign"), config.non_ksa_penalty).otherwise(0)).cast("double"),
            "hard_hit": (c("neg_head") > 0) | (c("hard_head") > 0),
            "off_guard": (c("off_vertical") >= 2) & (c("hp") < 2) & (c("fitout") == 0) & (c("architect") == 0) & (c("interior") == 0),
            "ksa_gate": (c("ksa") >= 0.7) | F.endswith(c("domain"), F.lit(".sa")) | F.exists("contacts.phones", lambda p: F.startswith(p, F.lit("+966"))),
            "keyword_gate": (c("hp") >= 1) | ((c("mp") >= 20) & (c("kitchen_hits") >= 10)),
        }
    )
    held = held.withColumns(
        {
            "service_gate": c("ksa_gate") & reach & ((c("fitout") == 1) | (c("architect") == 1) | (c("interior") == 1) | (c("service_ev") >= 3)) & ((c("biz") >= 2) | (c("hp") >= 1)),
            "developer_gate": c("ksa_gate") & (c("developer_ev") >= 2) & ((c("biz") >= 2) | (c("mp") >= 20)),
            "fallback_gate": c("ksa_gate") & reach & (c("mp") >= 20) & ((c("hp") >= 2) | (c("fitout") == 1) | ((c("kitchen") == 1) & (c("portfolio") == 1))) & (c("neg") < 40),
            "capped": ((c("hp") >= 6) | ((c("fitout") == 1) & (c("mp") >= 20)) | ((c("kitchen") == 1) & (c("portfolio") == 1) & (c("mp") >= 20) & (c("neg") < 20))) & ~c("hard_hit"),
            "bucket": categorized(c("lead_type")),
        }
    )
    own_evidence = (c("hp") >= 2) | ((c("hp") >= 1) & (c("biz") >= 2) & (c("density") >= 0.015))
    held = held.withColumns(
        {
            "content_gate": (own_evidence | (c("keyword_gate") & c("ksa_gate")) | c("developer_gate") | c("fallback_gate") | c("service_gate")) & ~c("empty_content"),
            "showroom_bonus": F.when((c("source_type") == "company_site") & (c("lead_type") == "B2B") & (c("bucket") == "showroom") & (c("kitchen") == 1) & reach & (c("neg") <= 5), 10.0).otherwise(0.0),
            "sanity_penalty": F.when(c("off_guard"), -35.0).otherwise(0.0),
        }
    )
    negative = config.negative_max * log_norm(c("neg") + 1.5 * c("neg_head"), 8)
    negative = F.when(c("capped"), F.greatest(negative, F.lit(-15.0))).otherwise(negative)
    base = (
        config.hp_max * log_norm(c("hp"), 12) + config.mp_max * log_norm(c("mp"), 40) + config.biz_max * log_norm(c("biz"), 12) + config.density_max * F.least(F.lit(1.0), c("density") * 120.0)
        + c("geo_bonus") + c("contact_bonus") + c("page_penalty") + negative + c("sanity_penalty") + c("showroom_bonus")
    )
    gated = F.when(~c("ksa_gate") | ~c("content_gate"), F.least(base, F.lit(55.0))).otherwise(base)
    held = held.withColumn("score", half_even(gated))
    held = (_recall if config.mode == "recall" else _precision)(held, config)
    accepted = c("raw_decision") == "accept"
    held = held.withColumns({"decision": F.when(accepted, "accept").otherwise("reject"), "relevant": accepted, "confidence": F.when(accepted, c("raw_confidence")).otherwise(F.least(c("raw_confidence"), F.lit(0.60))), "category": F.when(accepted, c("raw_category")).otherwise("unknown")})
    held = held.withColumn("signals", signals(config.mode == "recall"))
    held = held.withColumn("reasons", recall_reasons() if config.mode == "recall" else precision_reasons())
    return held.select(*[x for x in kept], "url", "domain", "relevant", F.col("score").alias("relevance_score"), "confidence", "decision", "lead_type", "category", "contacts", "signals", "reasons", "source_type", "company_name", "country", "city", "empty_content")


def _precision(held: DataFrame, config: ScoringConfig) -> DataFrame:
    c = F.col
    decided = F.when(c("empty_content"), "review").when(c("score") >= config.relevant, "accept").when((c("score") >= config.maybe_low) | c("developer_gate"), "review").otherwise("reject")
    sure = confidence(c("score"), config)
    own = F.when((c("score") >= config.maybe_low) & (c("source_type") == "company_site"), c("bucket")).when((c("lead_type") == "B2C") & (c("source_type") == "marketplace"), "individual").otherwise("unknown")
    return held.withColumns({"raw_decision": decided, "raw_confidence": F.when(c("empty_content"), F.least(sure, F.lit(0.35))).otherwise(sure), "raw_category": own})


def _recall(held: DataFrame, config: ScoringConfig) -> DataFrame:
    """Rejects only on strong evidence; what has too little content is for review."""
    c = F.col
    soft = (c("ksa") >= 0.4) | F.endswith(c("domain"), F.lit(".sa")) | F.exists("contacts.phones", lambda p: F.startswith(p, F.lit("+966")))
    clear = (c("kitchen") == 1) | (c("kitchen_hits") >= 1) | (c("fitout") == 1) | (c("interior") == 1) | (c("architect") == 1)
    held = held.withColumns({"r_foreign": c("foreign") & ~soft, "r_source": c("source_type").isin("gov_edu", "marketplace"), "r_clear": clear, "r_hard": c("hard_hit") & ~clear})
    refuse = c("r_foreign") | c("r_source") | c("r_hard")
    pick = lambda a, b, d: F.when(refuse, a).when(c("empty_content"), b).otherwise(d)
    own = F.when(~refuse & c("source_type").isin("company_site", "retail_catalog"), c("bucket")).when((c("lead_type") == "B2C") & (c("source_type") == "marketplace"), "individual").otherwise("unknown")
    return held.withColumns({"raw_decision": pick("reject", "review", "accept"), "raw_confidence": pick(0.80, 0.35, 0.60), "raw_category": own, "score": pick(10, 50, 80)})


def signals(recall: bool) -> Column:
    c = F.col
    typed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_SIGNAL.items() for x in p]), c("source_type")), F.lit(0.3))
    values = {
        "ksa_signal": c("ksa"), "non_ksa": _flag(c("foreign")), "source_type": typed, "has_email": _flag(c("email")), "has_phone": _flag(c("phone")), "has_whatsapp": _flag(c("wa")),
        "kitchen_signal": c("kitchen"), "kitchen_hits": c("kitchen_hits"), "interior_signal": c("interior"), "fitout_signal": c("fitout"), "architect_signal": c("architect"),
        "portfolio_signal": c("portfolio"), "total_words": c("words"), "empty_content": _flag(c("empty_content")), "density": c("density"), "individual_intent": c("individual"),
        "business_markers_strength": c("business"), "service_evidence": c("service_ev"), "developer_evidence": c("developer_ev"), "ecommerce_overridden": _flag(c("shop") & c("b2b_evidence")),
        "retail_catalog": _flag(c("shop") & ~c("b2b_evidence")), "page_penalty": c("page_penalty"), "contact_bonus": c("contact_bonus"), "geo_bonus": c("geo_bonus"), "hp_count": c("hp"),
        "mp_count": c("mp"), "biz_count": c("biz"), "neg_count": c("neg"), "neg_title_h1": c("neg_head"), "hard_negative_hit": _flag(c("hard_hit")), "article_guard_blocked": _flag(c("source.guard")),
        "off_vertical_guard": _flag(c("off_guard")), "sanity_penalty": c("sanity_penalty"), "ksa_gate": _flag(c("ksa_gate")), "content_gate": _flag(c("content_gate")),
        "content_gate_fallback": _flag(c("fallback_gate")), "content_gate_service": _flag(c("service_gate")), "content_gate_keyword": _flag(c("keyword_gate")),
        "content_gate_developer": _flag(c("developer_gate")), "neg_capped": _flag(c("capped")), "showroom_bonus": c("showroom_bonus"),
    }
    if recall:
        values |= {"recall_mode": F.lit(1.0), "recall_non_ksa_reject": _flag(c("r_foreign")), "recall_source_reject": _flag(c("r_source")), "recall_hard_negative_reject": _flag(c("r_hard")), "recall_clear_kitchen": _flag(c("r_clear")), "recall_empty_review": _flag(c("empty_content"))}
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.cast("double") for v in values.values()]))


def _listed(label: str, values: Column) -> Column:
    """The first three values in the notation of a list."""
    shown = F.array_join(F.transform(F.slice(values, 1, 3), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    return F.when(F.size(values) > 0, F.concat(F.lit(f"Found {label}: ["), shown, F.lit("]")))


def _summary() -> list[Column]:
    pairs = [("source_type", "source_type"), ("category", "category"), ("lead_type", "lead_type"), ("name", "company_name"), ("city", "city"), ("country", "country")]
    return [F.concat_ws("; ", *[F.concat(F.lit(f"{label}="), F.col(col)) for label, col in pairs])]


def _found() -> list[Column]:
    return [_listed("emails", F.col("contacts.emails")), _listed("phones", F.col("contacts.phones")), F.when(F.col("wa"), "Found WhatsApp link/number")]


# The texts of reasons.
def precision_reasons() -> Column:
    c = F.col
    verdict = F.when(c("relevant"), "RELEVANT").otherwise("NOT SURE/NOT RELEVANT")
    numbers = F.format_string("Counts: hp=%.1f, mp=%.1f, biz=%.1f, neg=%.1f, density=%.4f, words=%d", c("hp"), c("mp"), c("biz"), c("neg"), c("density"), c("words"))
    notes = [
        (~c("ksa_gate"), "KSA gate not satisfied (weak KSA evidence) -> score capped"),
        (~c("content_gate"), "Content gate not satisfied (insufficient high-precision/service evidence) -> score capped"),
        (c("fallback_gate"), "Content gate passed via fallback (mp/biz/contacts/KSA)"),
        (c("service_gate"), "Content gate passed via service override (fit-out/contracting/engineering + KSA + contacts)"),
        (c("keyword_gate"), "Content gate passed via keyword frequency (hp/mp+kitchen)"),
        (c("developer_gate"), "Content gate passed via developer/contractor evidence"),
        (c("empty_content"), "Empty/blocked/JS-only content: insufficient text extracted"),
        (c("ksa") >= 0.7, "KSA signal detected (city/ksa/saudi/+966/.sa)"),
        (c("foreign"), "Strong non-KSA signal detected -> penalty applied"),
    ]
    typed = F.when(c("source_type").isin("gov_edu", "article", "marketplace", "ecommerce", "retail_catalog"), F.concat(F.lit("Page type classified as '"), c("source_type"), F.lit("' -> penalty/handling applied")))
    more = [
        (c("source.guard"), "Article classification blocked by homepage URL guard"),
        (c("shop") & c("b2b_evidence"), "Ecommerce classification overridden to company_site due to B2B/portfolio evidence"),
        (c("off_guard"), "Off-vertical business signals detected; applied sanity penalty (needs review)"),
    ]
    last = [
        (c("neg_head") > 0, "Negative keywords detected in title/H1 -> stronger penalty"),
        (c("capped"), "Negative penalty capped due to strong positive signals"),
        (c("showroom_bonus") > 0, "Showroom bonus applied (kitchen + contacts + low negatives)"),
    ]
    head = F.concat(F.lit("Score="), c("score").cast("string"), F.lit(" => "), verdict, F.lit("; "), *_summary())
    told = lambda pairs: [F.when(when, text) for when, text in pairs]
    return F.array_compact(F.array(head, *_found(), *told(notes), typed, *told(more), numbers, *told(last)))


def recall_reasons() -> Column:
    c = F.col
    head = F.concat(F.lit("Recall mode: decision="), c("decision"), F.lit("; "), *_summary())
    whole = [c(n).cast("int") for n in ("foreign", "empty_content", "hard_hit", "kitchen", "fitout", "interior", "architect")]
    seen = F.format_string("Signals: ksa_signal=%.2f, non_ksa=%d, empty_content=%d, hard_negative_hit=%d, kitchen=%d, fitout=%d, interior=%d, architect=%d", c("ksa"), *whole)
    notes = [
        (c("r_foreign"), "Rejected: strong non-KSA evidence."),
        (c("r_source"), "Rejected: gov/edu or marketplace source type."),
        (c("r_hard"), "Rejected: hard-negative terms without kitchen evidence."),
        (c("empty_content"), "Review: empty/insufficient content."),
    ]
    return F.array_compact(F.array(head, seen, *_found(), *[F.when(when, text) for when, text in notes]))
