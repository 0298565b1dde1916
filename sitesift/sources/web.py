"""Page fetches: the cache as a table with an age limit, and an HTTP connector with delay, retry and size cap as a Python data source."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import with_scheme

SCHEMA = "url string, final_url string, ok boolean, status_code int, content_type string, text string, error string, cached_at double"
RETRIED = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class FetchSettings:
    timeout: float = 20.0
    retries: int = 3
    backoff: float = 1.0
    least_delay: float = 0.4
    most_delay: float = 1.6
    most_bytes: int = 3_000_000


def fetch_key(url):
    """Name of a cached fetch."""
    return F.sha2(with_scheme(url), 256)


def cached_and_missing(urls: DataFrame, cache: DataFrame, now: float | None = None, ttl: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct URLs with a cached fetch (failures count) that is not older than ttl seconds, and those without."""
    asked = urls.select(with_scheme(F.col("url")).alias("url")).filter("url <> ''").distinct()
    fresh = cache if ttl is None else cache.filter(F.lit(now) - F.col("cached_at") <= ttl)
    return asked.join(fresh, "url"), asked.join(fresh.select("url"), "url", "left_anti")


def write_cache(fetches: DataFrame, path: str) -> None:
    """Appends fetches (SCHEMA), failed ones too, to the cache."""
    fetches.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last fetch of each URL; empty without a cache."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "url"]), "cached_at").alias("r")).select("url", "r.*")


def fetch_one(url: str, settings: FetchSettings, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple:
    """A row of SCHEMA; tries again on 429, 5xx and timeouts, waiting longer each time."""
    error, status = "", 0
    for attempt in range(settings.retries + 1):
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=settings.timeout) as r:
                body = r.read(settings.most_bytes + 1)
                kind = r.headers.get("Content-Type") or ""
                if len(body) > settings.most_bytes:
                    return url, r.geturl(), False, r.status, kind, "", "response too large", time.time()
                return url, r.geturl(), 200 <= r.status < 400, r.status, kind, body.decode(r.headers.get_content_charset() or "utf-8", "replace"), None, time.time()
        except urllib.error.HTTPError as e:
            error, status = f"HTTP {e.code}", e.code
            if e.code not in RETRIED:
                break
        except (TimeoutError, OSError) as e:
            error, status = str(e) or type(e).__name__, 0
        if attempt < settings.retries:
            wait = settings.backoff * 2**attempt
            sleep(wait + random.uniform(0, 0.4 * wait))
    return url, url, False, status, None, "", error, time.time()


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = int(options.get("partitions", 6))

    def partitions(self):
        """URLs of one host stay together, so that the delay between its requests holds."""
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(u.split("/")[2] if "//" in u else u, []).append(u)
        parts: list[list[str]] = [[] for _ in range(max(1, min(self.parts, len(by))))]
        for i, group in enumerate(by.values()):
            parts[i % len(parts)] += group
        return [_Urls(p) for p in parts]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        settings, last = FetchSettings(), {}
        for url in partition.urls:
            host = url.split("/")[2] if "//" in url else url
            if host in last:
                time.sleep(max(0.0, random.uniform(settings.least_delay, settings.most_delay) - (time.time() - last[host])))
            yield fetch_one(url, settings)
            last[host] = time.time()


class PageSource(DataSource):
    """spark.read.format("sitesift_pages").option("urls", "a\\nb").load()"""

    @classmethod
    def name(cls) -> str:
        return "sitesift_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
