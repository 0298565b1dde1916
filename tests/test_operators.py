import random

import pytest
from pyspark.sql import functions as F

from sitesift.operators import candidates, crawl, leads
from sitesift.operators.evaluate import RECALL_SIGNALS, SIGNALS, evaluate
from sitesift.plans import runs
from sitesift.plans.config import RunRequest, ScoringConfig, load_env
from sitesift.sources import queries as query_sources
from sitesift.sources import search, sinks, web
from sitesift.streaming.leads import fold_stream, upsert_stream


def test_fold_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, f"d{rng.randint(0, 3)}.sa", f"q{rng.randint(0, 3)}", f"u{rng.randint(0, 4)}", f"t{i:03}") for i in range(200)]
    want = {}
    for _, d, q, u, at in rows:
        c = want.setdefault(d, {"first": at, "url": u, "hits": []})
        c["last"] = at
        if (q, u) not in c["hits"]:
            c["hits"] = [*c["hits"], (q, u)][-5:]
    df = spark.createDataFrame(rows, "seq long, domain string, query string, url string, discovered_at string").withColumns({"rank": F.lit(1), "title": F.lit(""), "snippet": F.lit("")})
    got = {r.domain: r for r in candidates.fold(df, most=5).collect()}
    assert {d: [(h.query, h.url) for h in r.hits] for d, r in got.items()} == {d: c["hits"] for d, c in want.items()}
    assert all((got[d].first_seen_at, got[d].last_seen_at, got[d].example_url) == (c["first"], c["last"], c["url"]) for d, c in want.items())
    half = candidates.fold(df.filter("seq < 100"), most=5)
    again = {r.domain: [(h.query, h.url) for h in r.hits] for r in candidates.fold(df.filter("seq >= 100"), most=5, known=half).collect()}
    assert again == {d: c["hits"] for d, c in want.items()}


def test_hits_rank_and_filter(spark):
    items = [("https://a.sa", "t" * 400, None), (" ", "x", "y"), ("https://facebook.com/x", "x", "y"), ("https://b.sa", None, None)]
    df = spark.createDataFrame([(0, "q", "now", items), (1, "q", "now", items[:1])], "seq long, query string, fetched_at string, items array<struct<link:string,title:string,snippet:string>>")
    got = [(r.domain, r.rank, len(r.title)) for r in candidates.hits(df).orderBy("seq").collect()]
    assert got == [("a.sa", 1, 300), ("b.sa", 4, 0), ("a.sa", 1, 300)]


def test_manual_urls(spark):
    df = spark.createDataFrame([(0, "a.sa/x"), (1, "b.sa"), (2, "https://a.sa/y"), (3, "b.sa"), (4, " ")], "seq long, url string")
    got = {r.domain: (r.example_url, r.hits[0].rank) for r in candidates.from_urls(df, "now").collect()}
    assert got == {"a.sa": ("https://a.sa/y", 3), "b.sa": ("https://b.sa", 2)}


def test_links_and_best(spark):
    html = '<a href="/contact-1">x</a><a href="/contact-2">y</a><a href="http://else.com/about">z</a><a href="/contact-1">again</a><a href="/p.pdf">f</a><a href="/about">us</a>'
    df = spark.createDataFrame([("https://a.sa/", html), ("https://b.sa/", "none")], "url string, html string")
    got = {r.url: r.wanted for r in crawl.pages_to_read(df).collect()}
    assert got["https://a.sa/"] == ["https://a.sa/", "https://a.sa/contact-1", "https://a.sa/about"]
    assert got["https://b.sa/"] == ["https://b.sa/", "https://b.sa/contact", "https://b.sa/contact-us", "https://b.sa/about", "https://b.sa/services"]


def test_collect_sites(spark):
    page = lambda u, s, t, k="text/html": (u, u, s, k, t, None)
    rows = [page("https://a.sa/", 200, '<p>Home</p><a href="/contact">c</a>'), page("https://a.sa/contact", 200, "Call"), page("https://b.sa/", 500, ""), page("https://c.sa/", 200, "x", "application/pdf")]
    fetched = spark.createDataFrame(rows, "url string, final_url string, status_code int, content_type string, text string, error string")
    got = {r.url: r for r in crawl.collect_sites(spark.createDataFrame([("https://a.sa/",), ("https://b.sa/",)], "url string"), fetched).collect()}
    assert got["https://a.sa/"].aggregated_text == "Home c\nCall" and len(got["https://a.sa/"].visited_urls) == 2
    assert got["https://b.sa/"].failed_urls[0].error == "HTTP 500"


def _site(spark, url, text, html=None):
    return spark.createDataFrame([(url, html, text)], "url string, html string, text string")


GOOD = "Riyadh villa finishing turnkey solutions kitchen cabinets joinery showroom projects portfolio services call +966501234567 " * 6


def test_evaluate_outcomes(spark):
    sites = [("https://a.sa/", GOOD), ("https://x.gov.sa/", GOOD), ("https://a.sa/blog", GOOD), ("https://a.sa/blog/x", GOOD), ("https://b.com/", "only a few words"), ("https://b.com/", "dubai " * 100), ("https://afternoon.com/", GOOD)]
    df = spark.createDataFrame([(i, u, None, t) for i, (u, t) in enumerate(sites)], "i int, url string, html string, text string")
    got = evaluate(df).orderBy("i").collect()
    assert [r.source_type for r in got] == ["company_site", "gov_edu", "company_site", "article", "company_site", "company_site", "marketplace"]
    assert got[0].decision == "accept" and got[0].relevant and got[0].category != "unknown" and set(got[0].signals) == set(SIGNALS)
    assert got[2].signals["article_guard_blocked"] == 1.0
    assert got[4].empty_content and got[4].decision == "reject" and got[4].confidence <= 0.35
    assert got[5].signals["non_ksa"] == 1.0 and got[5].relevance_score == 0
    assert all(r.decision in ("accept", "reject") and (r.decision == "accept" or r.confidence <= 0.60) for r in got)
    recall = evaluate(df, ScoringConfig(mode="recall")).orderBy("i").collect()
    assert [r.relevance_score for r in recall] == [80, 10, 80, 80, 50, 10, 10]
    assert set(recall[0].signals) == {*SIGNALS, *RECALL_SIGNALS} and recall[4].decision == "reject"
    assert any("Score=" in x for x in got[0].reasons) and recall[1].reasons[-1] == "Rejected: gov/edu or marketplace source type."


LEAD = "domain string, lead_id string, email string, phone string, discovered_at string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "e@x", "5", "d0"), ("b", "2", "", "", "d0")], LEAD)
    new = spark.createDataFrame([("a", "9", "", "6", "d1"), ("c", "3", "", "", "d1")], LEAD)
    once = leads.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "1", "e@x", "6", "d0"), ("b", "2", "", "", "d0"), ("c", "3", "", "", "d1")]
    assert sorted(map(tuple, leads.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize(("rows", "more"), [(4, False), (5, False), (6, True)])
def test_paging(spark, rows, more):
    df = spark.createDataFrame([("r", i + 1, "x") for i in range(rows)], "run_id string, id long, lead_id string")
    page, has_more, cursor = leads.page_of(df, "r", None, 5)
    assert (page.count(), has_more, cursor) == (min(rows, 5), more, 5 if more else None)


def test_run_results_are_distinct(spark):
    none = spark.createDataFrame([], "run_id string, lead_id string, lead_json string, created_at string, id long")
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b")], "lead_id string, domain string")
    one = leads.run_results(none, "r", rows, "t")
    assert [(r.lead_id, r.id) for r in leads.run_results(one, "r", rows, "t", 2).orderBy("id").collect()] == [("x", 1), ("y", 2)]


def test_query_sources(spark, tmp_path):
    made = [r.q for r in query_sources.generate(spark).orderBy("seq").collect()]
    assert len(made) == 162 and made[0] == "kitchen cabinets Riyadh" and made[-1].endswith("Madinah")
    (tmp_path / "q.txt").write_text("# no\n one \n\ntwo\n")
    assert [r.q for r in query_sources.query_file(spark, str(tmp_path / "q.txt")).orderBy("seq").collect()] == ["one", "two"]
    assert query_sources.query_file(spark, str(tmp_path / "none.txt")) is None
    assert query_sources.url_file(spark, str(tmp_path / "none.txt")).count() == 0


def test_search_cache(spark):
    asked = search.requests(query_sources.for_run(spark, ["a", "b", "a"]))
    cache = asked.filter("q = 'a'").limit(1).select("cache_key", F.lit(True).alias("ok"), F.lit(200).alias("status_code"), F.lit("t").alias("fetched_at"), F.lit(None).cast("string").alias("error"), F.from_json(F.lit('{"items":[{"link":"https://a.sa"}]}'), search.RESPONSE).alias("response"))
    hit, miss = search.hits_and_misses(asked, cache)
    assert (hit.count(), [r.q for r in miss.collect()]) == (2, ["b"])
    answered, _ = search.responses(asked, cache)
    assert answered.count() == 2
    quota = spark.createDataFrame([("Daily Limit Exceeded", None), ("no", '{"error":{"message":"x","status":"RESOURCE_EXHAUSTED"}}'), ("timeout", None)], "e string, j string")
    got = quota.select(search.quota_exhausted(F.col("e"), F.from_json("j", search.RESPONSE))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_api_connector_retries_and_stops_at_the_quota(spark, tmp_path):
    log = str(tmp_path / "asked")

    def opener(request, timeout):
        import io
        import urllib.error
        import urllib.parse

        q = urllib.parse.parse_qs(urllib.parse.urlparse(request.full_url).query)["q"][0]
        with open(log, "a+") as f:
            f.write(q + "\n")
            f.seek(0)
            times = f.read().split().count(q)
        if q == "c" and times == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "", {}, io.BytesIO(b"busy"))
        if q in "de":
            raise urllib.error.HTTPError(request.full_url, 429 if q == "e" else 400, "", {}, io.BytesIO(b"Quota exceeded" if q == "e" else b"bad"))
        return io.BytesIO(b'{"items": [{"link": "https://%s.sa", "title": "t"}]}' % q.encode())

    asked = search.requests(query_sources.for_run(spark, list("abcdef")), search.SearchSettings(cx="x"))
    cache = spark.createDataFrame([], f"cache_key string, ok boolean, status_code int, fetched_at string, error string, response {search.RESPONSE}")
    fetch = search.api_connector(search.ClientSettings("http://api", "k"), opener, lambda seconds: None)
    answered, fresh = search.responses(asked, cache, fetch)
    assert sorted(r["items"][0].link for r in answered.collect()) == ["https://a.sa", "https://b.sa", "https://c.sa"]
    told = {(r.ok, r.status_code, r.error) for r in fresh.collect()}
    assert told == {(True, 200, None), (False, 400, "bad"), (False, 429, "HTTP 429: Quota exceeded")}
    assert open(log).read().split() == list("abccde")  # f comes after the quota's end
    assert search.ask({"q": "x"}, search.ClientSettings("http://api", "k", retries=1), lambda *_, **__: (_ for _ in ()).throw(OSError("down")), lambda s: None)[:3] == (False, 0, "OSError('down')")


def test_page_cache_keeps_the_last_fetch(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert web.read_cache(spark, path).isEmpty()
    for at, text in ((1.0, "old"), (2.0, "new")):
        web.write_cache(spark.createDataFrame([("https://a.sa", "https://a.sa", True, 200, "text/html", text, None, at)], web.SCHEMA), path)
    assert [(r.text, r.cached_at) for r in web.read_cache(spark, path).collect()] == [("new", 2.0)]


def test_fetch_cache_and_retry(spark):
    urls = spark.createDataFrame([("a.sa",), ("https://a.sa",), ("b.sa",), ("",)], "url string")
    cache = spark.createDataFrame([("https://a.sa", "x", True, 200, "", "", None, 10.0)], web.SCHEMA)
    known, missing = web.cached_and_missing(urls, cache, now=20.0, ttl=15.0)
    assert (known.count(), [r.url for r in missing.collect()]) == (1, ["https://b.sa"])
    assert web.cached_and_missing(urls, cache, now=30.0, ttl=15.0)[1].count() == 2
    waits = []

    def refuse(*_, **__):
        raise TimeoutError("slow")

    row = web.fetch_one("https://a.sa", web.FetchSettings(retries=2), opener=refuse, sleep=waits.append)
    assert row[2] is False and row[6] == "slow" and len(waits) == 2 and waits[1] > waits[0]


def test_wide_csv(spark):
    df = spark.createDataFrame([("1", {"a": 1.0}), ("2", {"b": 2.0})], "lead_id string, signals map<string,double>")
    rows = {r.lead_id: r for r in sinks.wide_signals(df).collect()}
    assert rows["1"].signal_a == "1.0" and rows["1"].signal_b == "" and rows["2"].domain == ""


def test_runs(spark):
    none, keys = spark.createDataFrame([], runs.RUNS), spark.createDataFrame([], runs.KEYS)
    a, new, table, keys = runs.create(none, keys, RunRequest(run_name="x"), "t0", "key")
    assert new and runs.create(table, keys, RunRequest(run_name="x"), "t1")[:2] == (a, False)
    done = runs.update(table, a, "t2", status="finished")
    assert runs.create(done, keys, RunRequest(run_name="x"), "t3", "key")[:2] == (a, False)
    assert runs.cancel(table, a, "t2").first().status == "cancelled" and runs.recover(table, "t2").first().status == "failed"
    with pytest.raises(ValueError):
        RunRequest(max_leads=-1)
    with pytest.raises(ValueError):
        ScoringConfig(mode="other")
    assert RunRequest(evaluator_mode=" ").evaluator_mode is None


def test_load_env(tmp_path, monkeypatch):
    monkeypatch.setenv("SITESIFT_A", "old")
    (tmp_path / "env").write_text("# c\nSITESIFT_A=new\nSITESIFT_B='x'\nbad\n")
    assert load_env(str(tmp_path / "env")) == {"SITESIFT_B": "x"}


def test_streams(spark, tmp_path):
    for i, rows in enumerate(([("a", "1", "e", "", "d0", 1)], [("a", "1", "", "7", "d1", 2), ("b", "2", "", "", "d1", 3)])):
        spark.createDataFrame(rows, LEAD + ", seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    target = sinks.Snapshot(spark, f"{tmp_path}/leads", LEAD)
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(LEAD + ", seq long").parquet(f"{tmp_path}/in/*")
        upsert_stream(stream, target, f"{tmp_path}/check", "domain", "seq").awaitTermination(60)
        assert sorted(map(tuple, target.read().collect())) == [("a", "1", "e", "7", "d0"), ("b", "2", "", "", "d1")]
    spark.createDataFrame([("a", i, f"t{i}", "q", f"u{i % 30}") for i in range(40)], "domain string, seq long, discovered_at string, query string, url string").coalesce(1).write.parquet(f"{tmp_path}/hits")
    hits = spark.readStream.schema("domain string, seq long, discovered_at string, query string, url string").parquet(f"{tmp_path}/hits")
    fold_stream(hits, 20).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start().awaitTermination(60)
    got = spark.table("folded").first()
    assert (got.first_seen_at, got.last_seen_at, len(got.urls)) == ("t0", "t39", 20)


def test_snapshot_survives_a_stop_between_the_steps(spark, tmp_path):
    from sitesift.sources.sinks import Snapshot

    table = Snapshot(spark, f"{tmp_path}/t", "k string, n int", key="k", buckets=4)
    assert table.read().count() == 0
    table.replace(spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, n int"))
    table._write(spark.createDataFrame([("k0", 99)], "k string, n int"))  # written, but never pointed to
    assert {r.n for r in table.read().collect()} == set(range(20))
    before = table.current()
    new = spark.createDataFrame([("k3", 300)], "k string, n int")
    table.merge(new, lambda old, rows: old.join(rows.select("k"), "k", "left_anti").unionByName(rows))
    assert {r.n for r in table.read().collect()} == (set(range(20)) - {3}) | {300}
    assert sum(v != before[k] for k, v in table.current().items()) == 1 and table._numbers() == [0, 1]


def test_run_is_cancelled_and_capped(spark):
    from sitesift.plans import runs_worker
    from sitesift.plans.config import RunRequest

    found = spark.createDataFrame([], "domain string, first_seen_at string, example_url string, hits array<string>")
    with pytest.raises(runs_worker.Cancelled):
        runs_worker.run(spark, RunRequest(), found, None, found, found, "r", "now", cancelled=lambda: True)
    assert len(runs_worker.failure("x" * 5000)) < 1100
