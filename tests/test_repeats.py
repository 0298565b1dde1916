"""Queries against their SQL on pages whose URLs come back."""

from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries
from sitesift.operators import crawl


def same(spark, folder, name, pages):
    """The query's rows, which are those of its SQL over pages (url, html)."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    got = list(map(tuple, queries()[name](spark, str(folder)).collect()))
    assert Counter(got) == Counter(con.execute(oracle_sql()[name]).fetchall())
    return got


def test_dropped_hit_that_comes_back(spark, tmp_path):
    url = "https://a.sa/en/{}".format
    pages = [*map(url, range(23)), url(1), url(22), url(0), "https://b.sa/en/0", "https://b.sa/en/0"]
    got = {r[0]: r for r in same(spark, tmp_path, "q_candidate_fold", [(u, "") for u in pages])}
    assert [(r[3], r[4]) for r in (got["a.sa"], got["b.sa"])] == [(url(0), 20), ("https://b.sa/en/0", 1)]
    assert got["a.sa"][2] == "1970-01-01T00:00:25"


#: Some pages of one URL: two that differ, a good and a failed one (every seventh fails) either way round, two failed ones.
HTML = '<a href="/d">x</a><a href="/about">us</a><p>{}</p>'.format
TWICE = ["https://a.sa/0", "https://a.sa/1", "https://a.sa/1", "https://a.sa/3", "https://a.sa/4", "https://a.sa/4", "https://a.sa/0", "https://a.sa/7", "https://b.sa/", "https://b.sa/", "https://b.sa/", "https://a.sa/3", "https://c.sa/12", "https://c.sa/12", "https://a.sa/7"]
PAGES = [(u, HTML("x" * i) if i not in (5, 9) else "<p>no link</p>") for i, u in enumerate(TWICE)]


def test_linked_sites_of_one_url(spark, tmp_path):
    got = same(spark, tmp_path, "q_collect_linked", PAGES)
    assert len(got) == len(PAGES) and [r[1:] for r in got if r[0] == "https://a.sa/7"] == [(0, 0, 1)] * 2


def test_home_fetched_twice(spark):
    page = lambda u, final, s, t: (u, final, s, "text/html", t, None)
    rows = [page("https://a.sa/", "https://a.sa/x/", 200, '<a href="about">us</a>'), page("https://a.sa/", "https://a.sa/", 500, ""), page("https://a.sa/x/about", "https://a.sa/x/about", 200, "1"), page("https://a.sa/x/about", "https://a.sa/x/about", 200, "2")]
    fetched = spark.createDataFrame(rows, "url string, final_url string, status_code int, content_type string, text string, error string")
    (got,) = crawl.collect_sites(spark.createDataFrame([("https://a.sa/",)], "url string"), fetched).collect()
    assert (got.aggregated_text, got.home_html, got.visited_urls) == ("us\n1\n2", rows[0][4], ["https://a.sa/x/", *["https://a.sa/x/about"] * 2])
    assert [f.error for f in got.failed_urls] == ["HTTP 500"]


def test_sites_of_one_url(spark, tmp_path):
    got = same(spark, tmp_path, "q_collect_sites", PAGES)
    assert len(got) == len(PAGES) and [r[2:] for r in got if r[0] == "https://c.sa/12"] == [(2, 1)] * 2
