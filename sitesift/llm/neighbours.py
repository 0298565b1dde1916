"""The next row in a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _bound_rows, materialise


def buckets(df: DataFrame, key: str, rows: int = 1500, most: int = 4096) -> list[int]:
    """Quantiles of an integer key: at most `most` numbers, so the driver holds no more however large df is."""
    count = df.count()
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(most, max(4 * shuffles, count // rows + 1))
    if count == 0 or n < 2:
        return []
    found = df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (2 * n))
    return sorted({int(x) for x in found})


def with_next(df: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], columns: list[str], order: str) -> DataFrame:
    """make(df) with columns next_<c> of the next row in descending order of `key` (nulls last), equal keys by `order`; the last row's next is the first.

    make keeps `key` and adds `columns` and `order`. Rows are dealt to ranges of the key and windows run inside a range; only each range's first
    row is moved to the range before, and only these few are made twice.
    """
    bounds = buckets(df.select(key), key)
    # ranges count down with the order; null keys have a range of their own at the end
    ranged = lambda d: d.withColumn("__range", F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - _bound_rows(F.col(key), bounds)))
    heads = materialise(ranged(df.select(key)).groupBy("__range").agg(F.max(key).alias("__key")))  # a row for each range
    first = make(df.join(F.broadcast(heads.select("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_semi"))
    first = ranged(first).groupBy("__range").agg(F.min(F.struct(order, *[c for c in columns if c != order])).alias("__first"))
    every = Window.orderBy("__range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    then = F.coalesce(F.lead("__first").over(every), F.first("__first").over(whole))
    edges = materialise(first.withColumn("__then", then).select("__range", "__then"))
    made = ranged(make(df))
    follow = F.lead(F.struct(order, *[c for c in columns if c != order])).over(Window.partitionBy("__range").orderBy(F.col(key).desc_nulls_last(), order))
    out = made.withColumn("__next", follow).join(F.broadcast(edges), "__range").withColumn("__next", F.coalesce("__next", "__then"))
    return out.select(*[c for c in made.columns if c != "__range"], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])
