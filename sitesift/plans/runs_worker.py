"""A run from its request to leads: discovery, site texts, evaluation, deduplication against known leads, results and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import evaluable_domain, with_http_prefix
from ..operators import candidates, crawl, leads
from ..operators.evaluate import evaluate
from ..sources import queries as query_sources
from ..sources import search
from ..sources.sinks import staged
from .config import RunRequest, ScoringConfig
from .runs import STAGES


class Cancelled(Exception):
    """A run that was asked to stop."""


@dataclass
class Connectors:
    """What reaches the network. fetch_search: request rows to cache rows (see sources.search.responses); fetch_pages: url rows to rows of sources.web.SCHEMA."""

    fetch_pages: Callable[[DataFrame], DataFrame]
    fetch_search: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Outcome:
    leads: DataFrame  # all evaluated leads of the run
    fresh: DataFrame  # those that the run stores
    master: DataFrame  # lead_id, lead_json, created_at, last_seen_at
    results: DataFrame
    cache: DataFrame  # search responses to append to the cache
    metrics: dict[str, int] = field(default_factory=dict)


def discover(spark: SparkSession, request: RunRequest, settings: search.SearchSettings, cache: DataFrame, connectors: Connectors) -> tuple[DataFrame, DataFrame]:
    """Candidates of a request's queries (or generated ones), and the responses that were fetched for them."""
    asked = search.requests(query_sources.for_run(spark, list(request.queries), list(request.cities) or None), settings)
    answered, fresh = search.responses(asked, cache, connectors.fetch_search)
    return candidates.fold(candidates.hits(answered)), fresh


def sites_of(found: DataFrame, connectors: Connectors, most: int = 5) -> DataFrame:
    """candidate columns, url, html and text of each candidate's site; homes are fetched first, then the pages that they lead to."""
    homes = found.select(with_http_prefix(F.coalesce(F.nullif(F.col("example_url"), F.lit("")), F.col("domain"))).alias("url"), *[F.col(c) for c in found.columns])
    homes = staged(homes)
    fetched = staged(connectors.fetch_pages(homes.select("url").distinct()))
    wanted = crawl.usable(fetched).filter("ok").select(F.col("final_url").alias("url"), F.col("text").alias("html"))
    others = staged(crawl.pages_to_read(wanted, most=most, include_home=False).select(F.explode("wanted").alias("url")).distinct())
    every = staged(fetched.unionByName(connectors.fetch_pages(others.join(fetched.select("url"), "url", "left_anti"))))
    site = crawl.collect_sites(homes.select("url").distinct(), every, most=most)
    return homes.join(site, "url").withColumnsRenamed({"home_html": "html", "aggregated_text": "text", "domain": "candidate"})


def run(spark: SparkSession, request: RunRequest, found: DataFrame, connectors: Connectors, master: DataFrame, results: DataFrame, run_id: str, now: str, *, last_id: int = 0,
        cache: DataFrame | None = None, progress: Callable[[str, float], None] = lambda stage, percent: None, cancelled: Callable[[], bool] = lambda: False) -> Outcome:
    """found: candidates. At most `max_leads` of them, by arrival, are evaluated (0: all). With `dedupe`, leads that master knows are counted, not stored again, and
    their last_seen_at moves on. A run that was asked to stop raises Cancelled between stages; a site that could not be read counts as an error and is still a lead.
    """

    def stage(name: str) -> None:
        if cancelled():
            raise Cancelled(run_id)
        progress(name, float(STAGES[name]))

    stage("scraping")
    picked = found.filter(evaluable_domain(F.col("domain")))
    picked = picked.orderBy("first_seen_at", "domain").limit(request.max_leads) if request.max_leads else picked
    sites = staged(sites_of(picked, connectors))
    made = staged(leads.service_leads(evaluate(sites, ScoringConfig(mode=request.evaluator_mode or "precision")), now))
    stage("saving")
    known = master.select("lead_id").distinct()
    fresh = leads.new_leads(made, known) if request.dedupe else made
    told = leads.metrics(made, known if request.dedupe else known.limit(0)).first()
    errors = sites.filter(F.size("failed_urls") > 0).count()
    seen = made.select("lead_id").distinct().withColumn("seen", F.lit(True))
    moved = master.join(seen, "lead_id", "left").withColumn("last_seen_at", F.when(F.col("seen"), F.lit(now)).otherwise(F.col("last_seen_at"))).drop("seen")
    added = fresh.join(known, "lead_id", "left_anti").select("lead_id", F.to_json(F.struct(*fresh.columns)).alias("lead_json"), F.lit(now).alias("created_at"), F.lit(now).alias("last_seen_at"))
    stored = leads.run_results(results, run_id, fresh, now, last_id)
    stage("done")
    numbers = {"leads_found_total": told["leads_new"], "leads_new": told["leads_new"], "leads_duplicates": told["leads_duplicates"], "errors": errors}
    return Outcome(made, fresh, moved.unionByName(added), stored, cache if cache is not None else spark.createDataFrame([], "cache_key string"), numbers)


def run_request(spark: SparkSession, request: RunRequest, connectors: Connectors, settings: search.SearchSettings, cache: DataFrame, master: DataFrame, results: DataFrame, run_id: str, now: str, **more) -> Outcome:
    """A whole run: queries, search with its cache, then `run`."""
    more.get("progress", lambda *_: None)("searching", float(STAGES["searching"]))
    found, fresh = discover(spark, request, settings, cache, connectors)
    return run(spark, request, found, connectors, master, results, run_id, now, cache=fresh, **more)


def run_exists(runs: DataFrame, run_id: str) -> bool:
    return not runs.filter(F.col("run_id") == run_id).isEmpty()


def failure(message: str, most: int = 1000) -> str:
    """The error text that a failed run keeps, capped."""
    import json

    return json.dumps({"message": message[:most]})
