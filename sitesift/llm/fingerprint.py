"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last `ROLL` bytes rolls over a text; where it is -1 modulo the block size, a piece ends, and each piece
adds a character of a hash of its bytes to the signature. The block size follows from the length, halving while
the signature is short. A fingerprint is "block:signature:signature at twice the block". Two are compared by the edit
distance of signatures at equal block sizes: 1 - distance / longer length, the best where several sizes agree.

All hashes are polynomials modulo 2^64 taken from running sums over a whole batch of texts, and distances of
many pairs advance together, one bit-vector of a signature for each pair.

Defined results: null and empty texts have the fingerprint "4::"; two such are alike (1), one such and another text are not (0); equal texts have equal
fingerprints and likeness 1. Texts are hashed whole: the last piece of a full signature takes all that is left. A single row is its own next row. Repeated rows each get their
own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mixed, slices
from .neighbours import with_next

ROLL, FIRST_BLOCK, LENGTH = 7, 4, 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)
            self.up, self.down = grow(_BASE), grow(_INVERSE)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def signatures(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprints of a slice of texts that lie end to end in `data`."""
    n, count = len(data), len(offsets) - 1
    sizes = np.diff(offsets)
    if n == 0:
        return [f"{FIRST_BLOCK}::"] * count
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    # the hash of the last ROLL bytes; near a text's beginning, of those there are
    rolled = np.empty(n, np.uint64)
    if n >= ROLL:
        np.subtract(sums[ROLL:], sums[: n + 1 - ROLL], out=rolled[ROLL - 1 :])
        rolled[ROLL - 1 :] *= down[: n + 1 - ROLL]
    begins = np.repeat(offsets[:-1], np.minimum(sizes, ROLL - 1))
    early = begins + np.arange(len(begins)) - np.searchsorted(begins, begins)
    rolled[early] = (sums[early + 1] - sums[begins]) * down[begins]
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled >>= np.uint64(24)

    block = np.full(count, FIRST_BLOCK, np.int64)
    while (grow := block * LENGTH < sizes).any():
        block[grow] *= 2
    levels = np.log2(block // FIRST_BLOCK).astype(np.int64)
    # a hash is -1 modulo 4 * 2^k if its lowest k + 2 bits are ones: counting them serves all block sizes
    triggers = np.flatnonzero((rolled & np.uint64(FIRST_BLOCK - 1)) == FIRST_BLOCK - 1)
    high = (rolled[triggers] >> np.uint64(2)) + np.uint64(1)
    most = np.bitwise_count((high & (~high + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    of = np.repeat(np.arange(count), np.diff(np.searchsorted(triggers, offsets)))
    # pieces at each text's level; halve while there are too few
    chosen = levels.copy()
    while True:
        pieces = np.bincount(of[most >= chosen[of]], minlength=count)
        few = (pieces < LENGTH // 2 - 1) & (chosen > 0)
        if not few.any():
            break
        chosen[few] -= 1

    def pieced(level: np.ndarray) -> list[bytes]:
        enough = most >= level[of]
        ends, mine = triggers[enough] + 1, of[enough]
        nth = np.arange(len(ends)) - np.searchsorted(mine, mine)
        ends, mine = ends[nth < LENGTH - 1], mine[nth < LENGTH - 1]
        # the rest of a text is its last piece
        last = np.full(count, -1, np.int64)
        last[mine] = ends  # the last assignment stands
        rest = np.flatnonzero((sizes > 0) & (last < offsets[1:]))
        ends = np.concatenate((ends, offsets[1:][rest]))
        mine = np.concatenate((mine, rest))
        order = np.lexsort((ends, mine))
        ends, mine = ends[order], mine[order]
        starts = np.concatenate(([0], ends[:-1]))
        starts = np.maximum(starts, offsets[:-1][mine])
        digits = _CODE[(mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(58)).astype(np.int64)].tobytes()
        bounds = np.searchsorted(mine, np.arange(count + 1))
        return [digits[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    one, two = pieced(chosen), pieced(chosen + 1)
    return [f"{FIRST_BLOCK << c}:{a.decode()}:{b.decode()}" for c, a, b in zip(chosen.tolist(), one, two, strict=True)]


def fingerprints(column: pa.Array, chunk: int = 1 << 20) -> list[str]:
    data, offsets = flat(column)
    out: list[str] = []
    for lo, hi in slices(offsets, chunk):
        out += signatures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    return out


def distances(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """Edit distances of rows of characters (at most 64 each): all rows advance by one character of `right` at a time, `left` being bits of a word."""
    one = np.uint64(1)
    plus = np.full(len(left), 0xFFFFFFFFFFFFFFFF, np.uint64)
    minus = np.zeros(len(left), np.uint64)
    score = left_size.astype(np.int64).copy()
    top = one << np.maximum(left_size - 1, 0).astype(np.uint64)
    inside = np.arange(left.shape[1]) < left_size[:, None]
    for j in range(right.shape[1]):
        same = np.packbits((left == right[:, j : j + 1]) & inside, axis=1, bitorder="little")
        match = np.zeros((len(left), 8), np.uint8)
        match[:, : same.shape[1]] = same
        match = match.view(np.uint64)[:, 0]
        vertical = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        rise, fall = minus | ~(across | plus), plus & across
        live = j < right_size
        score += live * (((rise & top) != 0).astype(np.int64) - ((fall & top) != 0))
        rise, fall = (rise << one) | one, fall << one
        plus = np.where(live, fall | ~(vertical | rise), plus)
        minus = np.where(live, rise & vertical, minus)
    return np.where(left_size == 0, right_size, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of each pair of fingerprints, from 0 to 1."""
    out, pairs = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []:
            if s and t:
                pairs.append((i, s, t))
    for lo in range(0, len(pairs), 4096):
        part = pairs[lo : lo + 4096]
        rows = [np.zeros((len(part), LENGTH), np.uint8) for _ in range(2)]
        for k in (0, 1):
            for r, p in enumerate(part):
                rows[k][r, : len(p[k + 1])] = np.frombuffer(p[k + 1].encode(), np.uint8)
        sizes = [np.array([len(p[k]) for p in part]) for k in (1, 2)]
        alike = 1 - distances(rows[0], sizes[0], rows[1], sizes[1]) / np.maximum(sizes[0], sizes[1])
        np.maximum.at(out, [p[0] for p in part], alike)
    return out


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints, and texts compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)), pa.string()), pa.array([pack((t or "").encode()) for t in texts], pa.binary())], names=["doc_id", "fingerprint", "packed"])


def _edited(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        sizes = flat(whole.column(2))[1]
        for lo, hi in slices(sizes, chunk):
            batch = whole.slice(lo, hi - lo)
            own = batch.column(1).to_pylist()
            texts, chars = [], []
            for mine, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                mine, after = unpack(mine).decode(), unpack(after).decode()
                half = len(mine) // 2
                chars.append(len(mine))
                texts.append(mine[: len(mine) - half] + after[:half])
            edited = fingerprints(pa.array(texts, pa.string()))
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            near = likeness(own, edited), likeness(own, batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(hashes, pa.string()), batch.column(1), pa.array(edited, pa.string()), pa.array(near[0]), pa.array(near[1])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every text's fingerprint, that of its edited text (its last half replaced by as much of the next text's beginning), and likenesses.

    The next document is the next in descending order of the id, of equal ids by fingerprint. Texts are shuffled once, compressed, to be beside the next text.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    make = lambda d: d.mapInArrow(_marked, "doc_id long, fingerprint string, packed binary")
    beside = with_next(plain, "doc_id", make, ["packed", "fingerprint"], "fingerprint")
    ready = beside.select("doc_id", "fingerprint", "packed", "next_packed", "next_fingerprint")
    return ready.mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
