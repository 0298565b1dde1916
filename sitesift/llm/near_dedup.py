"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of `WORDS` words. Each shingle's hash falls into one of `REGISTERS` buckets, which keeps the
least value as leading-zero count and mantissa bits (16 bits). Empty registers borrow from others by a fixed sequence of places. Bands of registers find
candidates; a collision-corrected estimate of the Jaccard similarity drops those far below the threshold; full sets confirm the rest.

Equal sets are one node from the start. All members of a band's bucket, whatever its size, meet its least member first: that is one pair each. Links
found so join nodes to components, and only members that are not in the least member's component are compared further, with members of other
components: they are dealt to blocks, and two blocks meet in a task, which estimates, then counts common shingles, and emits a spanning forest of
what it links. So no bucket is written out as pairs, and groups of copies cost a pair a member.

Defined results: null text and text without words have an empty set and link with nothing; texts with fewer than WORDS words have their word sequence as one shingle; rows with a
null id link with nothing; rows that share an id and a text are one, and rows that share an id but no text may be linked through it; the smallest id
represents a component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, discard, fits, flat, join_hot, materialise, mixed, release, slices
from .components import components

WORDS, REGISTERS, ROWS = 5, 160, 5
#: Similarity that links, unless a caller gives another.
PER_CENT = 85
#: Members of a block, and pairs of one least member in a task.
BLOCK, SHARE = 512, 256
_MANTISSA = 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(11, 267, dtype=np.uint64) * np.uint64(_BASE))
_PLACE = mixed(np.arange(1001, 1001 + WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Chance that registers of different minima agree, from the mantissa bits.
COLLISION = 0.169919487159739 / 2**_MANTISSA


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    count, n = len(offsets) - 1, len(data)
    if n == 0:
        return [np.zeros(0, np.uint64)] * count
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    starts = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64))), dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    full = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mixed(full)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        size = hi - lo
        if size >= WORDS:
            out.append(np.unique(full[lo : hi - WORDS + 1]))
        elif size:
            out.append(mixed((words[lo:hi] * _PLACE[:size]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS:] * np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed minima, sets x REGISTERS as uint16; rows of empty sets are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    rows = [i for i, s in enumerate(sets) if len(s)]
    if not rows:
        return out
    h = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    bucket = ((h >> np.uint64(40)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
    least = np.full((len(rows), REGISTERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least.reshape(-1), owner * REGISTERS + bucket, mixed(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1))
    filled = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    # leading zeros of 63 bits and the bits that follow the leading one: smaller minima, smaller numbers
    bits = np.frexp(least.astype(np.float64))[1]  # rounding up to the next power only moves a value to its edge
    shift = np.maximum(bits - 1 - _MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << _MANTISSA) - 1)
    packed = (np.clip(bits, 0, 63).astype(np.uint64) << np.uint64(_MANTISSA) | mantissa).astype(np.uint16)
    row, empty = np.nonzero(~filled)
    t = 0
    while len(row):
        t += 1
        place = (mixed(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(t)) % np.uint64(REGISTERS)).astype(np.int64)
        got = filled[row, place]
        packed[row[got], empty[got]] = packed[row[got], place[got]]
        row, empty = row[~got], empty[~got]
    out[rows] = packed
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """Keys of all bands, as int64."""
    parts = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    places = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed(mixed((parts * places).sum(axis=2, dtype=np.uint64)) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for lo, hi in slices(offsets, 1 << 20):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            regs = registers(sets)
            keys = bands(regs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([r.tobytes() for r in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))],
                names=["doc_id", "n", "digest", "regs", "bands"],
            )
    release()


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for lo, hi in slices(offsets, 1 << 20):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "set"])


def worth_checking(size_a: np.ndarray, size_b: np.ndarray, agree: np.ndarray, deviations: float = 5.0, per_cent: int = PER_CENT) -> np.ndarray:
    """Whether sizes allow the threshold and the corrected estimate is within some standard deviations of it.

    Small sets fill few registers, so their estimates deviate more.
    """
    t = per_cent / 100
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    estimate = (agree / REGISTERS - COLLISION) / (1 - COLLISION)
    independent = REGISTERS * (1 - (1 - 1 / REGISTERS) ** small)
    return (100 * small >= per_cent * large) & (estimate >= t - deviations * np.sqrt(t * (1 - t) / np.maximum(independent, 1)))


def _estimate(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, part, size_a, size_b = (batch.column(k).to_numpy() for k in range(5))
        left, right = (flat(batch.column(k))[0].view(np.uint16).reshape(-1, REGISTERS) for k in (5, 6))
        good = worth_checking(size_a, size_b, (left == right).sum(axis=1), per_cent=per_cent)
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (a, b, part)], names=["a", "b", "part"])


def _confirm(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            good[i] = 100 * common >= per_cent * (len(x) + len(y) - common)
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    release()


def common_counts(sets: list[np.ndarray], dense: int = 48) -> np.ndarray:
    """How many elements each two sets share. Elements in many sets are counted by matrix products, the others by their pairs of sets."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if not n:
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1]))) if len(elements) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(elements)))
    often = np.flatnonzero(size >= dense)
    for lo in range(0, len(often), 1024):
        part = often[lo : lo + 1024]
        x = np.zeros((n, len(part)), np.float32)
        for j, k in enumerate(part.tolist()):
            x[owner[begin[k] : begin[k] + size[k]], j] = 1
        out += x @ x.T
    flat_out = out.reshape(-1)
    for p in np.unique(size[(size > 1) & (size < dense)]).tolist():
        who = owner[begin[size == p][:, None] + np.arange(p)]
        i, j = np.triu_indices(p, 1)
        for lo in range(0, len(who), step := max(1, 4_000_000 // len(i))):
            a, b = who[lo : lo + step][:, i].reshape(-1), who[lo : lo + step][:, j].reshape(-1)
            flat_out += np.bincount(np.minimum(a, b) * n + np.maximum(a, b), minlength=n * n).astype(np.float32)
    return np.maximum(out, out.T)


def _agreements(left: np.ndarray, right: np.ndarray, step: int = 32) -> np.ndarray:
    """In how many registers each row of left and each of right agree."""
    out = np.empty((len(left), len(right)), np.int64)
    for lo in range(0, len(left), step):
        out[lo : lo + step] = (left[lo : lo + step, None] == right[None]).sum(axis=2)
    return out


def joining_links(label: np.ndarray, sizes: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_cent: int = PER_CENT) -> list[tuple[int, int]]:
    """Pairs of labels that similar sets link, as a spanning forest. left, right: places of the sets to compare across."""
    if not len(left) or not len(right):
        return []
    likely = worth_checking(sizes[left][:, None], sizes[right][None], _agreements(regs[left], regs[right]), per_cent=per_cent) & (label[left][:, None] != label[right][None])
    if not likely.any():
        return []
    rows, columns = left[likely.any(axis=1)], right[likely.any(axis=0)]
    likely = likely[likely.any(axis=1)][:, likely.any(axis=0)]
    every, place = np.unique(np.concatenate((rows, columns)), return_inverse=True)
    common = common_counts([sets[k] for k in every.tolist()])[place[: len(rows)]][:, place[len(rows) :]]
    i, j = np.nonzero(likely & (100 * common >= per_cent * (sizes[rows][:, None] + sizes[columns][None] - common)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in np.unique(np.column_stack((label[rows[i]], label[columns[j]])), axis=0).tolist():
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b))
    return out


def _compare_blocks(table: pa.Table, per_cent: int) -> pa.Table:
    """Rows of two blocks (label, n, regs, set, asks): those that ask meet the others."""
    label, sizes, asks = (table.column(c).to_numpy() for c in ("label", "n", "asks"))
    regs = flat(table.column("regs"))[0].view(np.uint16).reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    pairs = joining_links(label, sizes, regs, sets, np.flatnonzero(asks == 1), np.flatnonzero(asks == 0), per_cent)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _sets(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, set of the wanted nodes (doc_id)."""
    held = materialise(wanted.distinct())
    out = materialise(among(plain, held, "doc_id").mapInArrow(full_sets, "rid long, set binary"))
    if out.count() > held.count():  # ids that repeat
        once = materialise(out.distinct())
        discard(out)
        out = once
    discard(held)
    return out


def _star_links(shared: DataFrame, nodes: DataFrame, plain: DataFrame, per_cent: int) -> DataFrame:
    """a, b: bucket members (rid) that are similar to the bucket's least (hub). The pairs of a hub are dealt to tasks, with its set in each."""
    pairs = materialise(shared.filter("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct())
    hubs = materialise(pairs.groupBy("a").agg(F.count("*").alias("times")).withColumn("parts", F.ceil(F.col("times") / SHARE).cast("int")))
    dealt = join_hot(pairs, hubs, "a", "times", pairs.count()).withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")

    def at_hubs(rows: DataFrame) -> DataFrame:
        return rows.join(hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "a")

    left, right = (nodes.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    near = dealt.join(right, "b").join(at_hubs(left), ["a", "part"]).select("a", "b", "part", "n_a", "n_b", "regs_a", "regs_b")
    likely = materialise(near.mapInArrow(lambda batches: _estimate(batches, per_cent), "a long, b long, part int"))
    sets = _sets(plain, likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))))
    close = likely.join(sets.toDF("b", "set_b"), "b").join(at_hubs(sets.toDF("a", "set_a")), ["a", "part"]).select("a", "b", "set_a", "set_b")
    links = materialise(close.mapInArrow(lambda batches: _confirm(batches, per_cent), "a long, b long"))
    discard(pairs, hubs, likely, sets)
    return links


def _further_links(shared: DataFrame, labels: DataFrame, nodes: DataFrame, plain: DataFrame, per_cent: int) -> DataFrame:
    """a, b: labels that similar members of one bucket link, among those which the least members left in different components."""
    named = labels.select(F.col("node").alias("rid"), "label")
    labelled = shared.join(F.broadcast(named) if fits(named) else named, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    labelled = materialise(labelled.select("band", "rid", "label"))
    of = labelled.groupBy("band").agg(
        F.count("*").alias("k"), F.min_by("label", "rid").alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(7))).alias("y"),
    )
    # a bucket of two is done; equal buckets are taken once
    left = of.filter("lo <> hi and k > 2").groupBy("k", "x", "y").agg(F.min_by(F.struct("band", "first"), "band").alias("b"))
    left = materialise(left.select("b.band", "b.first", "k"))
    if left.isEmpty():
        discard(labelled, left)
        return materialise(labels.limit(0).toDF("a", "b"))
    members = materialise(labelled.join(F.broadcast(left) if fits(left) else left, "band").withColumn("asks", F.col("label") != F.col("first")))
    asking = members.groupBy("band").agg(F.count_if("asks").alias("r"))
    parts = left.join(asking, "band").select("band", F.ceil(F.col("r") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("k") / BLOCK).cast("int").alias("columns"))
    parts = materialise(parts)
    dealt = members.join(F.broadcast(parts) if fits(parts) else parts, "band")
    place = lambda n: F.pmod(F.xxhash64("rid", F.lit(5)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = dealt.filter("asks").select("rid", "label", "band", place("rows").alias("i"), each("columns").alias("j"), F.lit(1).alias("asks"))
    told = dealt.select("rid", "label", "band", place("columns").alias("j"), each("rows").alias("i"), F.lit(0).alias("asks"))
    sets = _sets(plain, members.select(F.col("rid").alias("doc_id")))
    full = sets.join(nodes.select("rid", "n", "regs"), "rid")
    units = ask.unionByName(told).join(full, "rid").groupBy("band", "i", "j").applyInArrow(lambda rows: _compare_blocks(rows, per_cent), "a long, b long")
    links = materialise(units)
    discard(labelled, left, members, parts, sets)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row. Sets with a Jaccard similarity of per_cent or more are linked."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = materialise(plain.mapInArrow(sketch, "doc_id long, n long, digest binary, regs binary, bands array<long>"))
    known = sketches.filter("digest is not null and doc_id is not null")
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("rid"), F.count("*").alias("times"), F.min_by(F.struct("n", "regs", "bands"), "doc_id").alias("s"))
    nodes = materialise(nodes.select("digest", "rid", "times", "s.*"))
    total, different = nodes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()

    at = nodes.select("rid", F.explode("bands").alias("band"))
    buckets = materialise(at.groupBy("band").agg(F.count("*").alias("times"), F.min("rid").alias("hub")).filter("times > 1"))
    shared = materialise(join_hot(at, buckets, "band", "times", different * (REGISTERS // ROWS)))
    links = _star_links(shared, nodes, plain, per_cent)
    labels = materialise(components(links))
    more = _further_links(shared, labels, nodes, plain, per_cent)
    discard(buckets, shared, links)
    labelled = nodes.select("digest", "rid", "times").join(labels.toDF("rid", "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    if not more.isEmpty():
        again = components(more)
        labelled = labelled.join(again.toDF("label", "then"), "label", "left").withColumn("label", F.coalesce("then", "label"))
    labelled = materialise(labelled.select("digest", "times", "label"))
    discard(nodes, labels, more)

    members = join_hot(known.select("doc_id", "n", "digest"), labelled, "digest", "times", total).select("doc_id", "n", "label")
    alone = sketches.filter("digest is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("label"))
    out = members.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("label").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", per_cent: int = PER_CENT) -> DataFrame:
    """docs' rows that represent their component: one of each group, rows of one id being one group; rows with a null id stay.

    Only the ids of rows that go are joined to the texts.
    """
    decided = materialise(near_duplicates(docs, text, key, per_cent).filter("doc_id is not null"))
    gone = decided.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    twice = decided.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key))
    twice = materialise(twice.join(gone, key, "left_anti"))
    out = among(docs, materialise(gone.unionByName(twice)), key, how="left_anti").select(*docs.columns)
    return out if twice.isEmpty() else out.unionByName(among(docs, twice, key).dropDuplicates([key]).select(*docs.columns))
