"""Search responses: requests by page, the response cache as a table, and quota errors.

A connector is any function from request rows to response rows (`fetch`): `api_connector` asks an API, offline files of responses stand in for it.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import staged

RESPONSE = "struct<items:array<struct<link:string,title:string,snippet:string>>,error:struct<status:string,message:string,details:array<struct<reason:string>>>>"
REQUEST = ("cr", "cx", "gl", "hl", "num", "q", "safe", "start")

# What an exhausted quota is told by.
QUOTA_WORDS = ["resource_exhausted", "quota", "daily limit", "rate limit exceeded", "quota exceeded", "billing"]


@dataclass(frozen=True)
class SearchSettings:
    cx: str = ""
    hl: str = "en"
    gl: str = "sa"
    cr: str = "countrySA"
    safe: str = "off"
    pages_per_query: int = 1
    per_page: int = 10
    max_queries: int | None = None


def requests(queries: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """A row for each query and page: start = 1 + page * per_page, with the cache key (sha1 of the request in canonical form, without any API key)."""
    taken = queries if settings.max_queries is None else queries.orderBy("seq").limit(settings.max_queries)
    if settings.pages_per_query < 1:
        taken = taken.limit(0)
    paged = taken.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max(settings.pages_per_query, 1) - 1))))
    filled = paged.select(
        "seq", "page", "q", (1 + F.col("page") * settings.per_page).alias("start"), F.lit(settings.per_page).alias("num"), F.lit(settings.cx).alias("cx"),
        F.lit(settings.hl).alias("hl"), F.lit(settings.gl).alias("gl"), F.lit(settings.cr).alias("cr"), F.lit(settings.safe).alias("safe"),
    )
    return filled.withColumn("cache_key", cache_key())


def cache_key() -> Column:
    return F.sha1(F.to_json(F.struct(*REQUEST)))


def hits_and_misses(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a cached response (failures count too), and the distinct ones without."""
    known = cache.dropDuplicates(["cache_key"])
    hit = asked.join(known.drop(*[c for c in known.columns if c in asked.columns and c != "cache_key"]), "cache_key")
    miss = asked.join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return hit, miss


def quota_exhausted(error: Column, response: Column) -> Column:
    """Whether an error text or a response's error fields tell of an exhausted quota."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    e = response["error"]
    fields = F.contains(low(e["status"]), F.lit("resource_exhausted")) | low(e["message"]).rlike("quota|daily|limit") | F.coalesce(F.exists(e["details"], lambda d: low(d["reason"]).rlike("quota|limit")), F.lit(False))
    return F.coalesce(fields, F.lit(False)) | low(error).rlike("|".join(QUOTA_WORDS))


def responses(asked: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses in request order, and the cache rows to append. Without `fetch` (or after a quota error) only cached requests answer.

    fetch: from request rows to cache_key, ok, status_code, fetched_at, error, response (RESPONSE).
    """
    hit, miss = hits_and_misses(asked, cache)
    fresh = fetch(miss) if fetch else cache.limit(0)
    every = cache.unionByName(fresh.select(cache.columns)).dropDuplicates(["cache_key"])
    answered = asked.join(every.select("cache_key", "ok", "fetched_at", "response"), "cache_key").filter("ok")
    return answered.select(F.struct("seq", "page").alias("seq"), F.col("q").alias("query"), "fetched_at", F.coalesce("response.items", F.array().cast("array<struct<link:string,title:string,snippet:string>>")).alias("items")), fresh


@dataclass(frozen=True)
class ClientSettings:
    """endpoint: the API's address. Waits grow from `backoff` seconds to `most_wait`; `parts` tasks ask at a time."""

    endpoint: str
    key: str
    timeout: float = 20.0
    retries: int = 4
    backoff: float = 0.6
    most_wait: float = 10.0
    parts: int = 1
    agent: str = "Mozilla/5.0"


RETRIED = (429, 500, 502, 503, 504)


def ask(request: dict, client: ClientSettings, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[bool, int, str | None, str | None, bool]:
    """ok, status, error, body, and whether the quota is exhausted. Tries again on 429, 5xx and lost connections, but not after an exhausted quota."""
    address = client.endpoint + "?" + urllib.parse.urlencode({"key": client.key, **request})
    error = "unknown error"
    for attempt in range(client.retries + 1):
        try:
            with opener(urllib.request.Request(address, headers={"User-Agent": client.agent}), timeout=client.timeout) as r:
                body = r.read().decode("utf-8", "replace")
            json.loads(body)
            return True, 200, None, body, False
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")[:1000]
            if e.code not in RETRIED:
                return False, e.code, text[:500], None, False
            error = f"HTTP {e.code}: {text[:200]}"
            if e.code == 429 and any(w in text.lower() for w in QUOTA_WORDS):
                return False, 429, error, None, True
        except (OSError, ValueError) as e:  # no connection, a timeout, or no JSON
            error = repr(e)
        sleep(min(client.most_wait, client.backoff * 2**attempt + random.uniform(0.0, 0.4)))
    return False, 0, error, None, False


def api_connector(client: ClientSettings, opener=urllib.request.urlopen, sleep=time.sleep) -> Callable[[DataFrame], DataFrame]:
    """A `fetch` for `responses`. Requests of one task are asked in order; after an exhausted quota that task asks no more and leaves the others without a row.

    The answers are staged, so that an answer that several steps read is asked for once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latched = False
        for batch in batches:
            for row in batch.to_pylist():
                if latched:
                    continue
                cache_key = row.pop("cache_key")
                ok, status, error, body, latched = ask(row, client, opener, sleep)
                now = datetime.now(UTC).isoformat()
                yield pa.RecordBatch.from_pylist([{"cache_key": cache_key, "ok": ok, "status_code": status, "fetched_at": now, "error": error, "body": body}], schema=entry)

    entry = pa.schema([("cache_key", pa.string()), ("ok", pa.bool_()), ("status_code", pa.int32()), ("fetched_at", pa.string()), ("error", pa.string()), ("body", pa.string())])

    def fetch(missing: DataFrame) -> DataFrame:
        dealt = missing.coalesce(1) if client.parts == 1 else missing.repartition(client.parts, "q")
        rows = dealt.sortWithinPartitions("seq", "page").select("cache_key", *REQUEST)
        told = staged(rows.mapInArrow(run, "cache_key string, ok boolean, status_code int, fetched_at string, error string, body string"))
        return told.select("cache_key", "ok", "status_code", "fetched_at", "error", F.from_json("body", RESPONSE).alias("response"))

    return fetch


def read_cache(spark, path: str) -> DataFrame:
    """A folder of JSON cache entries; malformed ones are dropped."""
    schema = f"cache_key string, ok boolean, fetched_at string, status_code int, error string, response {RESPONSE}"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
