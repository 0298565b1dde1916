"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is split at spaces (each a leading mark of a word) and line ends, which no piece crosses. Distinct words are encoded once; words of
equal length advance together, one character at a time. At each place every substring that ends there is hashed and probed in the sorted keys of the
pieces. The state of a place is the last piece of the best path to it.

The vocabulary is a BPE one, whose segmentation is not the path of the largest sum of scores. A path's score here is 1 while
every two pieces in a row are what merging would leave apart, else 0; then exactly one path to each place scores 1, the maximum finds it, and the
result is the library's. Whether merging leaves a pair apart is found by undoing merges at their seam, latest first, for all new
pairs at once (`_apart`), and remembered.

Defined results: null is encoded as null by `encode` and decoded to null; the empty text has no pieces; characters without a piece become byte pieces; texts are
encoded whole, whatever their length; U+2581 in a text is taken as a space, as the library does. Equal texts have equal ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, flat, mixed, release

MODEL = os.environ.get("SITESIFT_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1 << 40)


_NO_PAIRS = (np.zeros(0, np.int64), np.zeros(0, bool))
#: Longer words are cut where no piece has the two characters in a row.
LONG_WORD = 48


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate((a[0], b[0]))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate((a[1], b[1]))[order]


def _char_codes(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(np.uint64) + np.uint64(1))


class Pieces:
    """One model's vocabulary, with the tables that encoding needs."""

    def __init__(self, path: str, remember_words: int = 150_000, remember_pairs: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = np.array([byte.get(b, self.unknown) for b in range(256)], np.int32)
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.text = {i: t for i, t, _ in normal}
        self.ids = {t: i for i, t in self.text.items()}
        self.longest = max(len(t) for t in self.ids)
        # decoding: each id's bytes, marks as spaces
        raw = [self.text[i].replace(MARK, " ").encode() if i in self.text else (bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"") for i, p in enumerate(model.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.cumsum([0, *map(len, raw)])
        # rank: the order of merges; single characters come before all
        self.size = len(model.pieces)
        self.rank = np.full(self.size + 1, -1, np.int64)
        merges = sorted((t for t in normal if len(t[1]) > 1), key=lambda t: (-t[2], t[0]))
        for r, (i, _, _) in enumerate(merges):
            self.rank[i] = r
        self.length = np.ones(self.size + 1, np.int64)
        self.hash = np.zeros(self.size + 1, np.uint64)
        self.powers = np.ones(self.longest + 1, np.uint64)
        self.powers[1:] = np.cumprod(np.full(self.longest, _BASE), dtype=np.uint64)
        order = np.array(list(self.text), np.int64)
        for i in order:
            t = self.text[int(i)]
            codes = _char_codes(np.array(list(map(ord, t)), np.int64))
            self.hash[i], self.length[i] = (codes * self.powers[len(t) - 1 :: -1][: len(t)]).sum(dtype=np.uint64), len(t)
        by = order[np.argsort(self.hash[order])]
        self.keys, self.key_ids = self.hash[by], by.astype(np.int64)
        self.bucket = np.searchsorted((self.keys >> np.uint64(48)).astype(np.int64), np.arange((1 << 16) + 1))
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self._split()
        self.pairs = self.new_pairs = _NO_PAIRS
        self.bigrams = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_words, self.most_pairs = remember_words, remember_pairs

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; -1 for none. The first 16 bits of a hash give its short range of the sorted keys."""
        bucket = (h >> np.uint64(48)).astype(np.int64)
        at = self.bucket[bucket]
        out = np.full(len(h), -1, np.int64)
        who = np.flatnonzero(at < self.bucket[bucket + 1])
        at, end, h = at[who], self.bucket[bucket[who] + 1], h[who]
        while len(who):
            found = self.keys[at] == h
            out[who[found]] = self.key_ids[at[found]]
            at = at + 1
            more = ~found & (at < end)
            who, at, end, h = who[more], at[more], end[more], h[more]
        return out

    def _split(self) -> None:
        """The two pieces whose merge forms each piece last, by merging its characters."""
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        for i, t in self.text.items():
            parts = list(t)
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    j = self.ids.get(parts[k] + parts[k + 1])
                    if j is not None and j != i and (best is None or self.rank[j] < best):
                        best, at = self.rank[j], k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids:
                self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a + b leaves just a and b.

        The later formed of the two pieces at the seam is undone again and again. A piece across the seam would have formed if it ranks before the piece that
        took one of its parts away; on equal ranks merging goes from left to right.
        """
        a, b = a.copy(), b.copy()
        apart, limit = np.ones(len(a), bool), np.full(len(a), _NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            total = self.length[x] + self.length[y]
            across = np.full(len(live), -1, np.int64)
            short = total <= self.longest
            across[short] = self.probe(self.hash[x[short]] * self.powers[self.length[y[short]]] + self.hash[y[short]])
            crossed = (across >= 0) & (self.rank[across] < limit[live])
            apart[live[crossed]] = False
            live = live[~crossed]
            x, y = a[live], b[live]
            take_left = self.rank[x] > self.rank[y]
            undo = np.where(take_left, x, y)
            limit[live] = self.rank[undo] + ~take_left
            a[live] = np.where(take_left, self.right[x], x)
            b[live] = np.where(take_left, y, self.left[y])
            live = live[(self.rank[undo] >= 0) & (a[live] >= 0) & (b[live] >= 0)]
        return apart

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same from memory, where it is known; a piece < 0 stands for a character without a piece and merges with none."""
        out = np.ones(len(a), bool)
        real = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[real] * self.size + b[real]
        for keys, found in (self.pairs, self.new_pairs):
            if len(keys) and len(key):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[at] == key
                out[real[known]] = found[at[known]]
                real, key = real[~known], key[~known]
        if len(key):
            fresh, back = np.unique(key, return_inverse=True)
            found = self._apart(fresh // self.size, fresh % self.size)
            out[real] = found[back]
            self.new_pairs = _merged(self.new_pairs, (fresh, found))
            if len(self.new_pairs[0]) > max(20_000, len(self.pairs[0]) // 4):
                full = len(self.pairs[0]) > self.most_pairs
                self.pairs, self.new_pairs = self.new_pairs if full else _merged(self.pairs, self.new_pairs), _NO_PAIRS
        return out

    def viterbi(self, points: np.ndarray) -> list[bytes]:
        """points: words x characters, all of one length. Each word's ids, as the bytes of int32."""
        words, n = points.shape
        codes = _char_codes(points)
        # hashes of all substrings that end at a place come from those that end one before
        last = np.full((words, n + 1), -1, np.int64)  # the last piece of the best path; -1 also for a character without a piece
        step = np.zeros((words, n + 1), np.int8)
        ending: list[np.ndarray] = []
        for i in range(1, n + 1):
            ending = [np.zeros(words, np.uint64), *ending][: self.longest]
            ending = [h * _BASE + codes[:, i - 1] for h in ending]
            score = np.zeros(words, np.int8)
            best, width = np.full(words, -1, np.int64), np.ones(words, np.int8)
            found = self.probe(np.concatenate(ending)).reshape(len(ending), words)
            size, who = np.nonzero(found >= 0)
            piece = found[size, who]
            before = i - 1 - size
            good = (before == 0) | self.apart(np.where(before > 0, last[who, before], -1), piece)
            # the maximum over path scores of 0 or 1; the longest wins, should several have 1
            for k in np.unique(size[good]):
                of = who[good & (size == k)]
                score[of], best[of], width[of] = 1, found[k, of], k + 1
            last[:, i], step[:, i] = best, width
        at, live = np.full(words, n), np.arange(words)
        whose, which, ends = [], [], []
        while len(live):
            here = at[live]
            whose.append(live)
            which.append(last[live, here])
            ends.append(here)
            at[live] -= step[live, here]
            live = live[at[live] > 0]
        whose, which, ends = map(np.concatenate, (whose, which, ends))
        order = np.argsort(whose * (n + 1) + ends)
        whose, which, ends = whose[order], which[order], ends[order]
        bounds = np.searchsorted(whose, np.arange(words + 1)).tolist()
        plain = which.astype(np.int32).tobytes()
        out = [plain[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for w in np.unique(whose[which < 0]).tolist():  # characters without a piece become bytes
            a, b = bounds[w], bounds[w + 1]
            ids = [j for p, end in zip(which[a:b].tolist(), ends[a:b].tolist(), strict=True) for j in ([p] if p >= 0 else self.byte[list(chr(points[w, end - 1]).encode())].tolist())]
            out[w] = np.array(ids, np.int32).tobytes()
        return out

    def _run(self, count: int) -> list[int]:
        """A run of marks: the longest pieces first, from the left."""
        whole, rest = divmod(count, self.longest)
        return [self.ids[MARK * self.longest]] * whole + ([self.ids[MARK * rest]] if rest else [])

    def _cut(self, word: str) -> list[str]:
        """A word as parts that no piece joins."""
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.bigrams), len(word)]
        return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not remembered."""
        plain: dict[str, str] = {}
        for w in words:
            body = w.lstrip(MARK)
            plain[w] = (MARK if len(body) < len(w) and body else "") + body
        todo = {p for p in plain.values() if p and p not in self.words}
        cut = {p: self._cut(p) for p in todo if len(p) > LONG_WORD}
        todo = {p for p in chain(todo - cut.keys(), *cut.values()) if p not in self.words}
        by: dict[int, list[str]] = {}
        for p in todo:
            by.setdefault(len(p), []).append(p)
        for n, group in by.items():
            for lo in range(0, len(group), size := max(1, 200_000 // n)):
                part = group[lo : lo + size]
                points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.int64)
                self.words.update(zip(part, self.viterbi(points), strict=True))
        for p, parts in cut.items():
            if len(parts) > 1:
                self.words[p] = b"".join(self.words[x] for x in parts)
        mark = self.ids.get(MARK, -1)
        for w, p in plain.items():
            if w != p:  # further marks in front
                extra = len(w) - len(p)
                ids = np.frombuffer(self.words[p] if p else b"", np.int32)
                alone = len(ids) > 0 and ids[0] == mark and len(p) > 1
                self.words[w] = np.array([*self._run(extra + alone), *ids[int(alone) :]], np.int32).tobytes()

    def units(self, text: str) -> list[str]:
        """The words of a text, each with the marks before it; a line end is a word of its own."""
        out: list[str] = []
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
            if k:
                out.append("\n")
            parts = line.split(MARK)
            if parts[0]:
                out.append(parts[0])
            if "" not in parts[1:]:
                out += [MARK + p for p in parts[1:]]
                continue
            marks = 0
            for p in parts[1:]:
                marks += 1
                if p:
                    out.append(MARK * marks + p)
                    marks = 0
            if marks:
                out.append(MARK * marks)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.units(t) if t else [] for t in texts]
        if len(self.words) > self.most_words:  # words not met again while as many others were learned are forgotten
            self.words, self.older = {}, self.words
        missing = set(chain.from_iterable(split)) - self.words.keys()
        again = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self.learn(list(missing - again))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, u)), np.int32) for u in split]

    def forget(self) -> None:
        """Drops the older words, between tasks."""
        self.older = {}

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text's ids, without the mark put in front."""
        sizes = self.raw_start[ids + 1] - self.raw_start[ids]
        at = np.repeat(self.raw_start[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = self.raw[at].tobytes()
        return out[1:] if out[:1] == b" " else out


_LOADED: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    """Loaded once a process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = 1 << 20) -> DataFrame:
    """docs with ids (array<int>) in place of the text column, then n_tokens and round_trip: whether decoding gives the text again. Own columns of these
    names are replaced."""
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "round_trip")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("t"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for whole in batches:
            sizes = flat(whole.column(whole.num_columns - 1))[1]
            lo = 0
            while lo < whole.num_rows:
                hi = min(whole.num_rows, max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + chunk, "right")) - 1))
                batch = whole.slice(lo, hi - lo)
                lo = hi
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = held.encode(texts)
                same = [None if t is None else held.decode(i) == t.replace(MARK, " ").encode() for t, i in zip(texts, found, strict=True)]
                counts = np.array([len(i) for i in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                none = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)), mask=none)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(counts, mask=np.array([t is None for t in texts])), pa.array(same, pa.bool_())], names=schema.names)
        held.forget()
        release()

    return inner.mapInArrow(run, schema).toDF(*rest, "ids", "n_tokens", "round_trip")


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with text after its own columns (an own one of this name is replaced); bytes that are no UTF-8 become U+FFFD."""
    docs = docs.drop("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if r is None else held.decode(np.array(r, np.int64)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
