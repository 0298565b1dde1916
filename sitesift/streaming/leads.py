"""Incremental leads and candidates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.leads import upsert
from ..sources.sinks import Snapshot


def upsert_stream(incoming: DataFrame, target: Snapshot, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Upserts each micro-batch into the snapshot's buckets that it touches; a batch that runs again changes nothing, as an upsert twice is an upsert once."""

    def apply(batch: DataFrame, _: int) -> None:
        target.merge(batch, lambda old, new: upsert(old, new, key=key, seq=seq))

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "first_seen_at string, example_url string, queries array<string>, urls array<string>"
OUTPUT = "domain string, first_seen_at string, last_seen_at string, example_url string, urls array<string>"


def fold_stream(hits: DataFrame, most: int = 20) -> DataFrame:
    """hits: domain, seq, discovered_at, query, url. The candidate of each domain after each batch; state is at most `most` hits a domain."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, example, queries, urls = state.get if state.exists else (None, None, [], [])
        queries, urls, last = list(queries), list(urls), None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            first, example, last = first or r.discovered_at, example or r.url, r.discovered_at
            if (r.query, r.url) not in set(zip(queries, urls, strict=True)):
                queries, urls = [*queries, r.query][-most:], [*urls, r.url][-most:]
        state.update((first, example, queries, urls))
        yield pd.DataFrame({"domain": [key[0]], "first_seen_at": [first], "last_seen_at": [last], "example_url": [example], "urls": [urls]})

    return hits.groupBy("domain").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
