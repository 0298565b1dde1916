"""Exact top-k search by inner product with pivot tables.

Distances from every vector to many pivots are computed once and kept in a table. For a query, the largest difference between its pivot
distances and a candidate's is a lower bound on their distance d, and since
2 <q, x> = |q|^2 + |x|^2 - d^2 it bounds the inner product from above. Candidates are evaluated in bound order until
the k-th best score exceeds every bound left, which is an exact stop. Each query starts with the k-th best score among a bounded sample of
the candidates, so a block whose range of pivot distances bounds it below that is skipped as a whole.

Candidates are dealt to blocks and queries to groups; every pair of a group and a block is one unit of work that keeps its own k
best, and the units' results are merged. Pivots are the same for all: a bounded number of vectors chosen by a hash, spread by farthest-first from their mean.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate; shorter vectors count as filled with
zeros; rows with a null id take no part; a repeated id is two candidates, and a query never meets rows of its own id; fewer candidates than k give
fewer rows; an empty table gives an empty result; further columns are not read. Scores are exact; a component or a sum that 64 bits can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null for a vector that takes no part."""
    wide = F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")
    x = F.transform(vector, lambda v: F.when(F.abs(v.cast("double")) * float(scale) < 2.0**63, F.floor(v.cast("double") * float(scale))).otherwise(wide))
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fit, x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list<long> array as rows of `width` (shorter lists filled with zeros)."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    inside = np.arange(width) < sizes[:, None]
    out[inside] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: the sampled vector farthest from the mean, then each time the one farthest from those already chosen."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def starting_scores(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some candidates, a lower bound of its k-th best of all; the least number without k of them."""
    out = np.full(len(q), np.iinfo(np.int64).min)
    for i in range(len(q)):
        scores = c[c_ids != q_ids[i]] @ q[i]
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_table: np.ndarray, k: int, first: int = 256, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block: query index, candidate id, score; and how many candidates each query evaluated.

    least: scores below which a query needs no candidate.
    """
    norms = (c.astype(float) ** 2).sum(axis=1)
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if top >= 2**63:
        raise OverflowError("an inner product may be beyond 64 bits")
    values, queries = (c.astype(float), q.astype(float)) if top < 2**53 else (c, q)  # float products are exact below
    table = np.ascontiguousarray(c_table.T)
    slack = 1e-9
    own = (q.astype(float) ** 2).sum(axis=1)
    least = np.full(len(q), np.iinfo(np.int64).min) if least is None else least
    # the nearest that any candidate of the block can be
    gap = np.maximum(np.maximum(table.min(axis=1, initial=np.inf) - q_table, q_table - table.max(axis=1, initial=-np.inf)), 0).max(axis=1, initial=0) * (1 - slack) if len(c) else np.zeros(len(q))
    highest = (own + norms.max(initial=0)) * (0.5 * (1 + slack)) - 0.5 * np.maximum(gap * gap - slack * (own + norms.max(initial=0)), 0) + 0.5
    out_q, out_id, out_score, evaluated = [], [], [], np.zeros(len(q), np.int64)
    for i in np.flatnonzero(highest >= least).tolist():
        lower = np.zeros(len(c))
        for p in range(len(table)):
            np.maximum(lower, np.abs(table[p] - q_table[i, p]), out=lower)
        lower *= 1 - slack
        bound = (own[i] + norms) * (0.5 * (1 + slack)) - 0.5 * np.maximum(lower * lower - slack * (own[i] + norms), 0) + 0.5
        left = np.flatnonzero(bound >= least[i])
        order, done, size = None, 0, min(len(left), max(first, 4 * k))
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while done < len(left):
            if order is None and size < len(left):
                head = left[np.argpartition(-bound[left], size - 1)[:size]]
                rest = bound.copy()
                rest[head] = -np.inf
            elif order is None:
                head, rest = left, None
            else:
                head = order[done : done + size]
            evaluated[i] += len(head)
            got = (values[head] @ queries[i]).astype(np.int64)
            other = (c_ids[head] != q_ids[i]) & (got >= least[i])
            ids, scores = np.concatenate((ids, c_ids[head][other])), np.concatenate((scores, got[other]))
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores, done = ids[keep], scores[keep], done + len(head)
            if done >= len(left):
                break
            if order is None:
                if len(ids) == k and scores[-1] > rest[left].max():
                    break
                order = np.concatenate((head, left[np.argsort(-rest[left], kind="stable")[: len(left) - len(head)]]))
                size = max(size, 1024)
            elif len(ids) == k and scores[-1] > bound[order[done]]:
                break
        out_q.append(np.full(len(ids), i))
        out_id.append(ids)
        out_score.append(scores)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_id), join(out_score), evaluated


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 64, sample: int = 1024, block: int = 4096, group: int = 4096, key: str = "vec_id", vector: str = "embedding", report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates, ties to the smaller id. report: also evaluated, the candidates whose product the query took.

    A block has about `block` candidates and a group about `group` queries; units are as many as groups times blocks. `sample` vectors, chosen by a
    hash, come to the driver to choose pivots from.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), scaled(F.col(vector), scale).alias("v"))
    rows = materialise(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.count_if("asks").alias("asking")).first()
    width, n, asking = facts["width"] or 0, facts["n"], facts["asking"] or 0
    blocks, groups = max(1, -(-n // block)), max(1, -(-asking // group))
    drawn = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("vec_id", "v").collect()
    points = np.array([list(r[1]) + [0] * (width - len(r[1])) for r in drawn], np.int64).reshape(len(drawn), width)
    held = spark.sparkContext.broadcast((np.array([r[0] for r in drawn], np.int64), points, choose_pivots(points, pivots)))

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as two binaries, the vector and its row of the pivot table, and a query's starting score."""
        ids, near, chosen = held.value
        for batch in batches:
            x = _matrix(batch.column(2), width)
            table = pivot_distances(x, chosen)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            least = np.zeros(len(x), np.int64)
            least[asks] = starting_scores(batch.column(0).to_numpy()[asks], x[asks], ids, near, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary()), pa.array(least)], names=["vec_id", "asks", "v", "t", "least"])

    tabled = materialise(rows.mapInArrow(tabulate, "vec_id long, asks boolean, v binary, t binary, least long"))
    pack = F.collect_list(F.struct("vec_id", "v", "t", "least")).alias("rows")
    part = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(parts)).cast("int")
    tasks = min(blocks, 4096)
    # blocks and groups have bounded sizes; a block is sent once for each group
    candidates = tabled.withColumn("block", part(41, blocks)).repartition(tasks, "block").groupBy("block").agg(pack)
    asked = tabled.filter("asks").withColumn("group", part(42, groups)).groupBy("group").agg(pack.alias("asked"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "block")
    units = asked.join(candidates, "block").select("asked", "rows")

    def unpack(rows_of) -> tuple[np.ndarray, ...]:
        ids = rows_of.field("vec_id").to_numpy(zero_copy_only=False)
        wide = np.frombuffer(b"".join(rows_of.field("v").to_pylist()), np.int64).reshape(len(ids), width)
        return ids, wide, np.frombuffer(b"".join(rows_of.field("t").to_pylist()), np.float64).reshape(len(ids), -1), rows_of.field("least").to_numpy(zero_copy_only=False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q, qt, least = unpack(batch.column(0)[i].values)
                c_ids, c, ct, _ = unpack(batch.column(1)[i].values)
                who, found, score, evaluated = search_block(ids, q, qt, c_ids, c, ct, k, least=least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])
                if report:  # a row without a candidate counts
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(evaluated)], names=["query_id", "vec_id", "score"])

    local = units.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if report:
        counted = F.sum(F.when(F.col("vec_id").isNull(), F.col("score"))).over(Window.partitionBy("query_id"))
        local = local.withColumn("evaluated", counted).filter("vec_id is not null")
    out = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", *(["evaluated"] if report else []))


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """What top_k must give, for tests."""
    out = []
    for i in np.flatnonzero(queries):
        other = np.flatnonzero(ids != ids[i])
        score = x[other] @ x[i]
        best = np.lexsort((ids[other], -score))[:k]
        out += [(int(ids[i]), r + 1, int(ids[other][b]), int(score[b])) for r, b in enumerate(best)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
