"""Exact removal of repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of `length` symbols that starts at two places anywhere is repeated, and every symbol under it goes. Symbols are bytes, or words (runs of what is no
ASCII white space). Each window of `length` symbols has a key, the least hash of its grams (substrings of a fixed size), so equal windows meet under one key, and
a text falls into runs of window starts with one key. The segments under runs of a key are put end to end, their Burrows-Wheeler transform is
built, and intervals are extended backwards, breadth first, which gives common prefixes by increasing length and stops at length - 1: what is
then still open is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fits, flat, materialise, mixed, release, slices


@dataclass(frozen=True)
class Unit:
    """What is compared: strings of `length` symbols, with keys from grams of `gram` symbols."""

    length: int
    gram: int
    words: bool = False


LENGTH = 400
BYTES = Unit(LENGTH, 32)
#: Passages of over 50 words.
PASSAGE = Unit(51, 8, words=True)
#: A run of window starts is cut after so many.
LONGEST_RUN = 512
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(501, 757, dtype=np.uint64) * np.uint64(_BASE))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def symbol_hashes(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every symbol, and where each text's symbols begin and end."""
    if not words:
        return _BYTE[data], offsets
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[:-1], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]), np.searchsorted(starts, offsets)


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` symbols in a row, from the symbols' own."""
    n = len(symbols)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * _powers(_BASE, n)[:n], dtype=np.uint64)))
    h = sums[gram:] - sums[: n - gram + 1]
    h *= _powers(_INVERSE, max(n - gram, 0))[: len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, from running minima of blocks in both directions."""
    n = len(h)
    padded = np.full(-(-n // width) * width, _TOP)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(symbols: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = BYTES.gram) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one key, the least gram hash of the window: text, key (int64), first and last start in the text, weight.

    Equal windows have equal keys, so they meet wherever they are. Equal windows inside one run make it periodic, so the key's gram stands at a start
    before its last; such a run weighs 2, others 1, and a key of total weight 1 has no repeated window.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none, none, none, none
    grams = gram_hashes(symbols, gram)
    key = sliding_minimum(grams, length - gram + 1)
    here = grams[: len(key)] == key
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    begin = offsets[:-1]
    total = np.cumsum(starts)
    if not total[-1]:
        return none, none, none, none, none
    valid = np.repeat(begin - (total - starts), starts) + np.arange(total[-1])
    key = key[valid]
    stands = np.concatenate(([0], np.cumsum(here[valid])))
    change = np.concatenate(([True], key[1:] != key[:-1]))
    change[(total - starts)[starts > 0]] = True
    at = np.flatnonzero(change)
    span = np.diff(np.append(at, len(key)))
    pieces = -(-span // LONGEST_RUN)
    if (pieces > 1).any():
        at = np.repeat(at, pieces) + LONGEST_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        span = np.diff(np.append(at, len(key)))
    owner = np.searchsorted(total, at, "right")
    first = at - (total - starts)[owner]
    weight = 1 + (stands[at + span - 1] > stands[at])
    return owner, key[at].view(np.int64), first, first + span - 1, weight


def _edges(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; true at both ends, so one longer than `values`."""
    out = np.ones(len(values) + 1, bool)
    np.not_equal(values[1:], values[:-1], out=out[1:-1])
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols (0 separates), by doubling; those that are equal so far in any order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    used = np.zeros(int(text.max()) + 1, bool)
    used[0] = used[text] = True
    bits = max(1, int(used.sum() - 1).bit_length())
    dense = (np.cumsum(used) - 1)[text]
    known = 63 // bits  # symbols that one number holds
    packed = np.zeros(n, np.int64)
    for k in range(known):
        packed <<= bits
        packed[: max(n - k, 0)] |= dense[k:]
    order = np.argsort(packed)
    edge = _edges(packed[order])
    # a rank is one more than the place of its group's first suffix; 0 stands behind the end
    group = np.maximum.accumulate(np.where(edge[:-1], np.arange(n, dtype=np.int32), 0), dtype=np.int32)
    rank = np.zeros(n + 2 * max(depth, known), np.int32)
    rank[order] = group + 1
    place = np.flatnonzero(~(edge[:-1] & edge[1:]))
    group, who = group[place], order[place]
    while known < depth and len(place):
        # only suffixes that still have an equal are sorted again
        key = group.astype(np.int64) << 32
        key |= rank[who + known]
        by = np.argsort(key)
        who = who[by]
        order[place] = who
        edge = _edges(key[by])
        group = np.maximum.accumulate(np.where(edge[:-1], place, 0)).astype(np.int32)
        rank[who] = group + 1
        still = np.flatnonzero(~(edge[:-1] & edge[1:]))
        place, group, who = place[still], group[still], who[still]
        known *= 2
    return order


def repeated(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of `text` (symbols from 1, 0 between segments), whether its `length` symbols stand elsewhere too.

    Intervals [low, high) of the Burrows-Wheeler transform are extended backwards, breadth first: the strings of one length at a time, and only those
    whose interval ends where no shorter string's did. That end is a common prefix of just this length less one; places left after
    length - 1 rounds have common prefixes of at least `length`. An interval whose members have one symbol before them moves as a whole; the members of
    others are looked at one by one.
    """
    n = len(text)
    if n <= length:
        return np.zeros(n, bool)
    order = suffix_order(text, length + 1)
    before = text[order - 1]
    before[order == 0] = 0
    by = np.argsort(before, kind="stable")
    places = np.arange(n, dtype=np.int32)
    step = np.empty(n, np.int32)  # where the suffix one symbol longer stands
    step[by] = places
    sorted_before = before[by]
    same = np.flatnonzero(sorted_before[1:] == sorted_before[:-1])
    ended = before == 0
    earlier = np.full(n, -1, np.int32)  # the member before and after with the same symbol; an ended one is neither first nor last
    earlier[by[same + 1]] = by[same]
    earlier[ended] = n
    later = np.full(n, n, np.int32)
    later[by[same]] = by[same + 1]
    later[ended] = -1
    onward = np.zeros(n + 1, np.int32)  # where an interval that ends behind a member ends then; 0 is never open
    onward[1:] = np.where(ended, 0, step + 1)
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    edges = np.flatnonzero(_edges(text[order])).astype(np.int32)
    low, high = edges[:-1], edges[1:]
    open_[high] = False
    for _ in range(1, length):
        if not len(low):
            break
        size, moved, end = high - low, step[low], onward[high]
        whole = (end - moved == size) & (before[low] == before[high - 1])
        split = np.flatnonzero(~whole & (size > 1))
        kept = np.flatnonzero(whole & open_[end])
        if len(split):
            low, high, size = low[split], high[split], size[split]
            total = np.cumsum(size, dtype=np.int32)
            at = np.repeat(low - total + size, size) + places[: total[-1]]
            lows = np.sort(step[at[earlier[at] < np.repeat(low, size)]])
            high = onward[at[later[at] >= np.repeat(high, size)] + 1]
            high = high[open_[high]]
            low = np.concatenate((moved[kept], lows[np.searchsorted(lows, high) - 1]))
            high = np.concatenate((end[kept], high))
        else:
            low, high = moved[kept], end[kept]
        open_[high] = False
    out = np.zeros(n, bool)
    out[order] = open_[:-1] | open_[1:]
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH, words: bool = False) -> list[np.ndarray]:
    """For each of different segments, the starts whose `length` symbols stand elsewhere too."""
    if words:
        number: dict[bytes, int] = {}
        symbols = [[number.setdefault(w, len(number) + 1) for w in s.split()] for s in segments]
        sizes = np.array([len(s) for s in symbols], np.int64)
        data = np.fromiter((x for s in symbols for x in s), np.int64, int(sizes.sum()))
    else:
        sizes = np.array([len(s) for s in segments], np.int64)
        data = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), data.dtype)
    text[np.arange(len(data)) + np.repeat(np.arange(len(segments)), sizes)] = data
    found = repeated(text, length)
    return [np.flatnonzero(found[b : b + max(s - length + 1, 0)]) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


# ---- the distributed part


def _key_runs(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """(id, hash, text) -> a row for each run."""
    for batch in batches:
        data, offsets = flat(batch.column(2))
        for lo, hi in slices(offsets, 1 << 20):
            symbols, own = symbol_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], unit.words)
            owner, key, first, last, weight = runs(symbols, own, unit.length, unit.gram)
            rows = pa.array(owner + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(weight.astype(np.int32))], names=["id", "hash", "key", "first", "more", "weight"])
    release()


def _cut(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """(id, hash, text, runs, times) -> each run's symbols with a digest of them. Equal rows in a row are cut once."""
    last = None
    for batch in batches:
        data, offsets = flat(batch.column(2))
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for row, (found, times) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if keys[row] == last:
                continue
            last = keys[row]
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            if unit.words:
                listed = text.split()
                pieces = [b" ".join(listed[r["first"] : r["first"] + r["more"] + unit.length]) for r in found]
            else:
                pieces = [text[r["first"] : r["first"] + r["more"] + unit.length] for r in found]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"] for r in found], pa.int64()), pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in pieces], pa.binary()), pa.array(pieces, pa.binary()),
                 pa.array([last[0]] * n, pa.int64()), pa.array([last[1]] * n, pa.int64()), pa.array([r["first"] for r in found], pa.int32()), pa.array([r["more"] for r in found], pa.int32()), pa.array([times] * n, pa.int64())],
                names=["key", "digest", "segment", "id", "hash", "first", "more", "times"],
            )


def _ranges(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as first, last of runs without a gap."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    gap = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack((starts[np.concatenate(([0], gap + 1))], starts[np.concatenate((gap, [len(starts) - 1]))])).astype(np.int32)


Segment = tuple[bytes, bytes, int, int]  # digest, symbols, copies, starts - 1


def _solve(rows: list[Segment], whole: list[Segment], unit: Unit) -> pa.RecordBatch:
    """Different segments of whole keys, and segments that are known to stand elsewhere: the ranges of repeated starts of each."""
    alone = repeated_starts([r[1] for r in rows], unit.length, unit.words)
    found = [(r[0], np.array([[0, r[3]]], np.int32) if r[2] > 1 else _ranges(starts)) for r, starts in zip(rows, alone, strict=True)]
    found += [(r[0], np.array([[0, r[3]]], np.int32)) for r in whole]
    found = [(digest, ranges) for digest, ranges in found if len(ranges)]
    sizes = np.array([len(r) * 2 for _, r in found], np.int64)
    flat_ranges = np.concatenate([r for _, r in found]).reshape(-1) if found else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat_ranges))
    return pa.RecordBatch.from_arrays([pa.array([digest for digest, _ in found], pa.binary()), lists], names=["digest", "ranges"])


def _expand(batches: Iterator[pa.RecordBatch], unit: Unit, limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit of work: whole units are gathered up to about `limit` bytes, and one transform serves them all.

    Segments that all have copies are repeated as a whole; their unit needs no transform.
    """
    held: dict[bytes, Segment] = {}  # a segment that stands in several units is taken once
    whole: list[Segment] = []
    mine: list[Segment] = []
    size, now = 0, None

    def close() -> int:
        if all(copies > 1 for _, _, copies, _ in mine):
            whole.extend(mine)
            return 64 * len(mine)
        held.update((r[0], r) for r in mine)
        return sum(len(r[1]) for r in mine)

    for batch in batches:
        for at, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if at != now:
                size += close()
                mine, now = [], at
                if size > limit:
                    yield _solve(list(held.values()), whole, unit)
                    held, whole, size = {}, [], 0
            mine.append(tuple(row))
    close()
    if held or whole:
        yield _solve(list(held.values()), whole, unit)
    release()


def repeated_spans(docs: DataFrame, block: int = 3000, *, unit: Unit = BYTES) -> DataFrame:
    """docs: id (not null), hash, text, where rows with one id and hash have one text. id, hash, spans: arrays of [first, last] repeated starts, in symbols. Materialised.

    Keys of runs are counted first; only texts with a key that occurs twice are shuffled, to cut their segments. Equal segments become one with a count
    before they meet others. The segments of a key are a unit of work; those of a key with more than `block` different segments are dealt to blocks,
    and each two blocks are a unit, so no unit grows with the data. Equal rows share one entry, whose runs count as often as there are rows.
    """
    found = materialise(docs.mapInArrow(lambda batches: _key_runs(batches, unit), "id long, hash long, key long, first int, more int, weight int"))
    again = found.groupBy("key").agg(F.sum("weight").alias("all")).filter("all > 1").select("key")
    mine = found.join(again, "key").groupBy("id", "hash").agg(F.collect_set(F.struct("key", "first", "more")).alias("runs"), F.count("*").alias("n"))
    mine = materialise(mine.select("id", "hash", "runs", F.expr("n div size(runs)").alias("times")))
    discard(found)
    cut = _with_rows(docs, mine).select("id", "hash", "text", "runs", "times")
    cut = materialise(cut.mapInArrow(lambda batches: _cut(batches, unit), "key long, digest binary, segment binary, id long, hash long, first int, more int, times long"))
    discard(mine)
    # at most one key for each `block` segments; the others are a unit as they are
    hot = materialise(cut.groupBy("key").agg((F.ceil(F.approx_count_distinct("digest") * 1.2 / block)).cast("int").alias("parts")).filter("parts > 1"))
    different = cut.groupBy("key", "digest", "segment", "more").agg(F.sum("times").alias("copies"))
    if hot.isEmpty():
        dealt = different.withColumn("unit", F.xxhash64("key"))
    else:
        dealt = different.join(F.broadcast(hot) if fits(hot) else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("digest"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumn("unit", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select("unit", "digest", "segment", "copies", "more").repartition("unit").sortWithinPartitions("unit")
    solved = dealt.mapInArrow(lambda batches: _expand(batches, unit), "digest binary, ranges array<int>")
    hits = cut.select("digest", "id", "hash", "first").join(solved, "digest")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2 - 1).cast("int")), lambda i: F.struct((F.col("first") + F.get("ranges", (i * 2).cast("int"))).alias("a"), (F.col("first") + F.get("ranges", (i * 2 + 1).cast("int"))).alias("b")))
    out = materialise(hits.select("id", "hash", pairs.alias("p")).groupBy("id", "hash").agg(F.flatten(F.collect_set("p")).alias("spans")))
    discard(cut, hot)
    return out


def _with_rows(docs: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """docs joined to a materialised table of rows by id and hash. Texts without a row aren't shuffled while the ids fit a broadcast."""
    keys = few.select("id", "hash")
    if how != "inner":
        return docs.join(F.broadcast(keys) if fits(keys) else keys, ["id", "hash"], how)
    if fits(keys):
        docs = docs.join(F.broadcast(keys), ["id", "hash"], "left_semi")
    return docs.join(few, ["id", "hash"])


def merged(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Merged [begin, end) of symbols under repeated starts [first, last]."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def removal(raw: bytes, spans: list[tuple[int, int]], unit: Unit) -> list[tuple[int, int]]:
    """Merged [begin, end) of removed bytes; words go with the white space behind them."""
    gone = merged(spans, unit.length)
    if not unit.words or not gone:
        return gone
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.append(np.flatnonzero(~space & np.concatenate(([True], space[:-1]))), len(raw))
    return [(int(starts[a]), int(starts[b])) for a, b in gone]


def _keyed(docs: DataFrame, text: str, key: str, *more) -> DataFrame:
    """id, hash, text: id and hash only tell texts apart, so a null id is 0 here."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("hash"), F.col(text).alias("text"), *more)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", *, passages: Unit | None = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row's text without repeated strings of LENGTH bytes; and n_passages: how many
    passages of over 50 words (`passages`) in it are repeated, which may be shorter than LENGTH.

    Defined results: null text is empty; texts under LENGTH bytes keep all; a string that overlaps itself is repeated; repeated rows, and rows with null ids,
    each count as texts of their own; bytes of a character may be removed apart, as strings are of bytes; docs' further columns are not read.
    """
    plain = _keyed(docs, text, key)
    spans = repeated_spans(plain)
    if passages is not None:
        words = repeated_spans(plain, unit=passages).withColumnRenamed("spans", "passages")
        spans = materialise(spans.join(words, ["id", "hash"], "full"))
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<a:int,b:int>>"))
    length = passages.length if passages else 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, offsets = flat(batch.column(1))
            for k, (doc, found, long) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                gone = removal(raw, [(s["a"], s["b"]) for s in found or []], BYTES)
                edges = [0, *(x for g in gone for x in g), len(raw)]
                kept = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    kept.update(raw[a:b])
                rows.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), len(merged([(s["a"], s["b"]) for s in long or []], length))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(6)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    plain = _keyed(docs, text, key, F.col(key).cast("long").alias("doc_id"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
    hit = _with_rows(plain, spans).select("doc_id", "text", "spans", "passages").mapInArrow(apply, schema)
    text_, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    rest = _with_rows(plain, spans, "left_anti").select("doc_id", F.octet_length(text_).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text_, 256).alias("kept_sha256"), none.alias("n_passages"))
    return hit.unionByName(rest)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: Unit = BYTES) -> DataFrame:
    """docs with repeated strings cut from their texts, n_chars counted anew; a text that loses all is dropped.

    Characters that lose some of their bytes go whole. White space between words is of no matter where symbols are words. Columns are docs' own, in
    order, whatever their names; null and empty texts stay, and repeated rows and rows with null ids count as texts of their own.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    spans = repeated_spans(_keyed(docs, text, key), unit=unit)
    plain = _keyed(docs, text, key, row)
    schema, at = docs.schema, columns.index(text)
    size = columns.index("n_chars") if "n_chars" in columns else -1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0), []
            data, offsets = flat(rows.field(at))
            for k, found in enumerate(batch.column(1).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                gone = removal(raw, [(s["a"], s["b"]) for s in found], unit)
                edges = [0, *(x for g in gone for x in g), len(raw)]
                texts.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True)))
            arrays = [rows.field(k) for k in range(len(schema))]
            arrays[at] = pa.array(texts, pa.string())
            if size >= 0:
                arrays[size] = pa.array([len(t) for t in texts], pa.int64())
            keep = pa.array([bool(t) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], names=schema.names)

    hit = _with_rows(plain, spans).select("row", "spans").mapInArrow(apply, schema)
    return hit.union(_with_rows(plain, spans, "left_anti").select("row.*"))
