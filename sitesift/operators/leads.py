"""Lead rows, their upsert, deduplication across runs, paging, and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.page import listed_city
from ..functions.text import normalize
from .candidates import source_text


def lead_id(domain_: Column) -> Column:
    return F.sha1(domain_)


def batch_leads(evaluated: DataFrame, body: str = "aggregated_text") -> DataFrame:
    """Leads of a batch run. evaluated: an evaluation with candidate columns (candidate, first_seen_at, hits) and the site's text.

    Country and city come from the text alone here: the first listed city it contains, and Saudi Arabia for a keyword or any listed city.
    """
    text = normalize(F.col(body))
    town = listed_city(text, terms.CITIES)
    here = text.rlike("saudi|ksa|السعود") | (town != "unknown")
    name = F.when(F.coalesce("company_name", F.lit("unknown")) != "unknown", F.col("company_name")).otherwise(F.col("candidate"))
    first = lambda kind: F.coalesce(F.get(F.col(f"contacts.{kind}"), F.lit(0)), F.lit(""))
    return evaluated.select(
        lead_id(F.col("candidate")).alias("lead_id"), "lead_type", "category", name.alias("name"), F.when(here, "Saudi Arabia").otherwise("unknown").alias("country"), town.alias("city"),
        first("emails").alias("email"), first("phones").alias("phone"), F.col("candidate").alias("website"), source_text(F.col("hits")).alias("source"), "relevance_score", "relevant", "decision",
        F.col("first_seen_at").alias("discovered_at"), F.col("candidate").alias("domain"), "confidence", "empty_content", "signals",
    )


def service_leads(evaluated: DataFrame, now: str) -> DataFrame:
    """Leads of a service run: all contacts, the evaluator's own place, the example URL as website."""
    return evaluated.select(
        lead_id(F.col("domain")).alias("lead_id"), F.when(F.col("company_name") != "unknown", F.col("company_name")).otherwise(F.col("domain")).alias("name"), "domain", F.col("example_url").alias("website"), "country", "city",
        F.col("contacts.emails").alias("emails"), F.col("contacts.phones").alias("phones"), "category", source_text(F.col("hits")).alias("source"), "relevance_score", "confidence",
        F.lit(now).alias("discovered_at"), "empty_content", "decision",
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "domain", seq: str | None = None) -> DataFrame:
    """Incoming rows win, but an existing discovered_at and lead_id stay, and so do email and phone where the new ones are empty.

    seq: orders several incoming rows of one key; they are applied in that order, which the last row and the last filled contacts give.
    """
    columns = [c for c in existing.columns if c != key]
    sticky, filled = {"discovered_at", "lead_id"}, {"email", "phone"}
    new = incoming
    if seq:
        when_filled = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq)))
        when_first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq)))
        picks = {c: when_first(c) if c in sticky else F.coalesce(when_filled(c), F.lit("")) if c in filled else F.max_by(c, seq) for c in columns}
        new = incoming.groupBy(key).agg(*[e.alias(c) for c, e in picks.items()])
    old = existing.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in columns])
    both = old.join(new.withColumn("arrives", F.lit(True)), old["old_key"] == new[key], "full_outer")
    arrives = F.coalesce("arrives", F.lit(False))

    def merged(c: str) -> Column:
        if c in sticky:
            return F.when(arrives, F.coalesce(F.nullif(F.col(f"old_{c}"), F.lit("")), F.col(c))).otherwise(F.col(f"old_{c}"))
        if c in filled:
            return F.when(arrives, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"old_{c}"), F.col(c))).otherwise(F.col(f"old_{c}"))
        return F.when(arrives, F.col(c)).otherwise(F.col(f"old_{c}"))

    return both.select(F.coalesce(F.col(key), "old_key").alias(key), *[merged(c).alias(c) for c in columns]).select(existing.columns)


def new_leads(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known.select("lead_id"), "lead_id", "left_anti")


def known_leads(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known.select("lead_id"), "lead_id", "left_semi")


def run_results(results: DataFrame, run_id: str, leads: DataFrame, at: str, last_id: int = 0) -> DataFrame:
    """results with the run's further leads, one row for each (run, lead); ids go on after `last_id`."""
    fresh = leads.dropDuplicates(["lead_id"]).select(F.lit(run_id).alias("run_id"), "lead_id", F.to_json(F.struct(*leads.columns)).alias("lead_json"), F.lit(at).alias("created_at"))
    fresh = fresh.join(results.select("run_id", "lead_id"), ["run_id", "lead_id"], "left_anti")
    numbered = fresh.withColumn("id", (F.row_number().over(Window.orderBy("lead_id")) + last_id).cast("long"))  # at most max_leads rows of one run
    return results.unionByName(numbered.select(results.columns))


def page_of(results: DataFrame, run_id: str, cursor: int | None = None, limit: int = 200) -> tuple[DataFrame, bool, int | None]:
    """The next `limit` results (at most 1000) after a cursor by id; whether there are more; and the next cursor, none on the last page."""
    n = max(1, min(limit, 1000))
    rows = results.filter((F.col("run_id") == run_id) & (F.col("id") > (cursor or 0))).orderBy("id").limit(n + 1)
    ids = [r[0] for r in rows.select("id").collect()]  # one page
    more = len(ids) > n
    return rows.limit(n), more, ids[n - 1] if more else None


def metrics(leads: DataFrame, known: DataFrame) -> DataFrame:
    """leads_found_total, leads_new, leads_duplicates of one run."""
    flagged = leads.select("lead_id").join(known.select("lead_id").distinct().withColumn("seen", F.lit(1)), "lead_id", "left")
    return flagged.agg(F.count("*").alias("leads_found_total"), F.count_if(F.col("seen").isNull()).alias("leads_new"), F.count_if(F.col("seen").isNotNull()).alias("leads_duplicates"))


def signal_keys(leads: DataFrame) -> DataFrame:
    return leads.select(F.explode(F.map_keys("signals")).alias("key")).distinct().orderBy("key")


def first_rows(rows: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n rows by arrival; 0 is no limit."""
    return rows if n == 0 else rows.orderBy(seq).limit(n)
