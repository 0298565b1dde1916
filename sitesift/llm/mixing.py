"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words stand in a seeded order, dealt to shards of about `shard_words` words, and each shard is cut into blocks of `block_words` words. Targets
share `share` times all words by weight and stop at `cap` times a source's size. The blocks that all targets make together go to sources, then to a source's
groups of shards, then to shards, each time by highest quotients v / (2 s + 1); each division has at most `FAN` parts, or the number of parts above it. A
shard whose quota is q takes all of its n blocks q // n times, and q % n of them once more: those with the least hashes of shard and block number.

A document is taken at most `cap` times (rounded up).

Defined results: null text counts 0 words; a null source is a source of its own, last in order; rows with null ids and repeated rows each
count; ties in the seeded order are broken by id and size; an empty table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fits, materialise

#: Children of a node when seats are dealt.
FAN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague: integer seats by the highest quotients votes / (2 s + 1), ties to the lower index.

    most: seats that each may get at most; what is over goes to the next quotients.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), max(int(seats), 0)) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum() if (votes > 0).any() else 0))
    got = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return got
    # a divisor whose rounding gives a few seats too few, then single seats by quotient
    low, high = 0.0, 2 * votes.max() + 1
    for _ in range(200):
        mid = (low + high) / 2
        if np.minimum(np.floor(votes / mid + 0.5), most)[votes > 0].sum() > seats:
            low = mid
        else:
            high = mid
    got = np.minimum(np.floor(votes / high + 0.5), most).astype(np.int64) * (votes > 0)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1.0)
        order = np.lexsort((np.arange(len(votes)), -quotient))[:left]
        order = order[quotient[order] >= quotient[order[0]] * (1 - 1e-12)]  # only equals at once
        got[order] += 1
    return got


def _placed(rows: DataFrame, order: Column) -> DataFrame:
    """rows (materialised) with `nth`, their place from 0 in a global order: sorted by ranges, and only the ranges' sizes come to the driver."""
    ranged = materialise(rows.orderBy(order).withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before, map_ = 0, []
    for part, n in sorted(ranged.groupBy("range").count().collect()):  # a row for each shuffle partition
        map_ += [F.lit(part), F.lit(before)]
        before += n
    offset = F.try_element_at(F.create_map(*map_), F.col("range")) if map_ else F.lit(0)
    return ranged.withColumn("nth", F.col("at") - F.shiftleft(F.col("range").cast("long"), 33) + offset).drop("range", "at")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds target: the reshared targets are min(cap * size, level * weight) at one common level.

    The level is found by a few aggregations over a row for each source; only sums come to the driver.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    placed = _placed(sizes, F.col("source").asc_nulls_last())
    weighed = materialise(placed.withColumn("weight", F.get(table, F.pmod("nth", F.lit(len(weights))).cast("int"))).drop("nth"))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    for _ in range(10_000):
        full = F.col("source_size") * cap <= F.col("weight") * level
        s = weighed.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not s["rest"]:
            break
        new = (total - (s["full"] or 0.0)) / s["rest"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    else:
        raise RuntimeError("the level of the targets was not found")
    return weighed.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * level))


def _dealt(children: DataFrame, seats: DataFrame, parent: str, child: str) -> DataFrame:
    """children: parent, child, votes, most; seats: parent, seats. child, seats: each parent's seats by highest quotients."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(child)
        return pd.DataFrame({child: rows[child], "seats": apportion(rows["votes"].to_numpy(float), int(rows["seats"].iloc[0]), rows["most"].to_numpy(np.int64))})

    return children.join(seats, parent).groupBy(parent).applyInPandas(deal, f"{child} string, seats long")


def _quotas(cells: DataFrame, block_words: int, cap: float) -> DataFrame:
    """cells: cell, rack, name, target, cell_size. cell, blocks, quota, down the tree of buckets of sources, sources, racks of shards, shards."""
    leaves = cells.withColumn("blocks", F.ceil(F.col("cell_size") / block_words)).withColumn("most", F.col("blocks") * int(np.ceil(cap)))
    leaves = materialise(leaves.withColumn("votes", F.col("cell_size")))
    racks = leaves.groupBy("name", "rack").agg(F.sum("votes").alias("votes"), F.sum("most").alias("most"))
    sources = leaves.groupBy("name").agg(F.first("target").alias("votes"), F.sum("most").alias("most"))
    parts = F.lit(max(1, -(-sources.count() // FAN)))
    sources = materialise(sources.withColumn("bucket", F.pmod(F.xxhash64("name"), parts).cast("string")).withColumn("all", F.lit("")))
    buckets = sources.groupBy("all", "bucket").agg(F.sum("votes").alias("votes"), F.sum("most").alias("most"))
    whole = sources.groupBy("all").agg(F.floor(F.sum("votes") / block_words + 0.5).alias("seats"))
    seats = _dealt(buckets, whole, "all", "bucket")
    seats = _dealt(sources.drop("all"), seats, "bucket", "name")
    seats = _dealt(racks, seats, "name", "rack")
    seats = _dealt(leaves.select("rack", "cell", "votes", "most"), seats, "rack", "cell")
    out = materialise(leaves.select("cell", "blocks").join(seats.withColumnRenamed("seats", "quota"), "cell"))
    discard(leaves, sources)
    return out


#: Block hashes are (a i + b)^5 modulo this prime, which is different for each i below it, as 5 does not divide PRIME - 1.
PRIME = (1 << 31) - 1


def block_hash(mark: int, block):
    """The hash of a block number (or of an array of them) in the shard with this mark; no step is beyond 62 bits."""
    x = ((mark % (PRIME - 1) + 1) * block + (mark >> 20) % PRIME) % PRIME
    y = x * x % PRIME
    return y * y % PRIME * x % PRIME


def last_picked(mark: int, blocks: int, rest: int) -> int:
    """The hash of the last of the `rest` blocks with the least hashes, which are taken once more; -1 for none."""
    return int(np.partition(block_hash(mark, np.arange(blocks, dtype=np.int64)), rest - 1)[rest - 1]) if rest else -1


def _picks(frames):
    for f in frames:
        yield f.assign(last_hash=[last_picked(m, n, q % max(n, 1)) for m, n, q in zip(f["mark"], f["blocks"], f["quota"], strict=True)])


def mix(docs: DataFrame, block_words: int = 8, shard_words: int = 250_000, seed: int = 7, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and its place: start, blocks, quota, mark, last_hash.

    The places tell which words are taken (`mixed_texts`). carry: keep the whole input row in a struct column `row`.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = materialise(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("place"), *row))
    # null-safe, by a name that is never null
    named = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = _small(materialise(targets.select(named.alias("name"), "source_size", "target")))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    placed = sized.withColumn("name", named).drop("source").join(targets, "name")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "place"), shards)
    placed = placed.withColumn("rack", F.concat_ws(":", F.floor(shard / FAN).cast("string"), "name")).withColumn("cell", F.concat_ws(":", shard.cast("string"), "name"))
    cells = placed.groupBy("cell", "rack", "name", "target").agg(F.sum("size").alias("cell_size"))
    quotas = _quotas(cells, block_words, cap).withColumn("mark", F.xxhash64(F.lit(seed + 2), "cell"))
    quotas = _small(materialise(quotas.mapInPandas(_picks, "cell string, blocks long, quota long, mark long, last_hash long")))
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, "cell")
    before = before.withColumn("factor", F.pmod("mark", F.lit(PRIME - 1)) + 1).withColumn("shift", F.pmod(F.shiftright("mark", 20), F.lit(PRIME)))
    times = F.expr("quota div greatest(blocks, 1)")
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("size") * times + _picked_count(block_words))
    return before.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "blocks", "quota", "mark", "last_hash", *(["row"] if carry else []))


def _small(df: DataFrame) -> DataFrame:
    """A materialised table of a row per source or shard: broadcast while it fits, else left to the planner."""
    return F.broadcast(df) if fits(df) else df


def _picked_count(block_words: int) -> Column:
    """How many of a document's words lie in blocks that are taken once more."""
    start, size = F.col("start"), F.col("size")

    def words(acc: Column, i: Column) -> Column:
        x = (F.col("factor") * i + F.col("shift")) % PRIME
        y = x * x % PRIME
        inside = F.least(start + size, (i + 1) * block_words) - F.greatest(start, i * block_words)
        return acc + F.when(y * y % PRIME * x % PRIME <= F.col("last_hash"), inside).otherwise(F.lit(0))

    blocks = F.sequence(F.floor(start / block_words), F.floor((start + size - 1) / block_words))
    return F.when(F.col("last_hash") < 0, F.lit(0)).otherwise(F.aggregate(blocks, F.lit(0).cast("long"), words))


def mixed_texts(docs: DataFrame, block_words: int = 8, **options) -> DataFrame:
    """The mix itself, with docs' columns: a document's words in blocks that pass whole once or twice give whole rows, and those taken
    once more give a further row of just these words, white space after them included. n_chars, if there, is counted anew."""
    out = mix(docs, block_words=block_words, carry=True, **options).filter(F.col("taken") > 0)
    text = docs.columns.index(options.get("text", "text"))
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    schema = docs.schema

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("start", "blocks", "quota", "mark", "last_hash")}
            rows, take, texts = batch.column("row"), [], []
            whole = rows.field(text).to_pylist()
            for i, t in enumerate(whole):
                n, q = cols["blocks"][i], cols["quota"][i]
                for _ in range(q // n):
                    take.append(i)
                    texts.append(t)
                if part := picked_words(t or "", cols["start"][i], cols["mark"][i], cols["last_hash"][i], block_words):
                    take.append(i)
                    texts.append(part)
            index = pa.array(take, pa.int64())
            arrays = [rows.field(k).take(index) for k in range(len(schema))]
            arrays[text] = pa.array(texts, pa.string())
            if size >= 0:
                arrays[size] = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return out.select("row", "start", "blocks", "quota", "mark", "last_hash").mapInArrow(cut, schema)


def picked_words(text: str, start: int, mark: int, last: int, block_words: int) -> str:
    """The words of one text whose block is taken once more, with the white space behind each."""
    if last < 0:
        return ""
    data = np.frombuffer(text.encode(), np.uint8)
    word = (data != 32) & ((data < 9) | (data > 13))
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(first):
        return ""
    block = (start + np.arange(len(first))) // block_words
    taken = block_hash(mark, block.astype(np.int64)) <= last
    if taken.all():
        return text
    bounds = np.append(first, len(data))
    return data[np.concatenate((np.zeros(first[0], bool), np.repeat(taken, np.diff(bounds))))].tobytes().decode().rstrip(" \t\n\x0b\x0c\r")
