"""Language ID by a byte convolutional network, trained in numpy.

A text's bytes (A-Z and accented capitals lower-cased, other ASCII that is no letter taken as a space) are cut into
windows of a fixed length that overlap by the widest filter less one byte. Filters of several widths slide over a window; ReLU, max pooling and
softmax give a distribution for each window, and a text's is the mean of its windows' weighted by their letters.
A filter's response to a byte is a row of a 256-row table, so a convolution is a sum of table look-ups.

Defined results: null text and text without a letter are `und` with score 0; a text of any length is read whole, in chunks
of bounded memory; with no labelled row every text is `und`; ties go to the language that sorts first; repeated rows and
rows with null ids each get their own row; an empty table gives an empty result; columns named lang_pred or score are replaced, others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat, release, slices

UNKNOWN = "und"


def _folding() -> np.ndarray:
    """ASCII letters to lower case, the rest of ASCII to a space; other bytes stay."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    return fold


_FOLD = _folding()


def folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE in UTF-8
    capital = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[capital] += 0x20
    return out


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters)
    biases: list[np.ndarray]
    weights: np.ndarray  # (filters in all, languages)
    offset: np.ndarray
    window: int

    @property
    def overlap(self) -> int:
        return max(len(t) for t in self.tables) - 1

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: windows x bytes -> windows x filters in all, after ReLU and max pooling."""
        across = np.ascontiguousarray(x.T, np.intp)
        return np.concatenate([np.maximum(_responses(across, t).max(axis=0) + b, 0) for t, b in zip(self.tables, self.biases, strict=True)], axis=1)

    def probabilities(self, x: np.ndarray, tile: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)))
        for lo in range(0, len(x), tile):
            out[lo : lo + tile] = _softmax(self.pooled(x[lo : lo + tile]) @ self.weights + self.offset)
        return out


def _responses(across: np.ndarray, table: np.ndarray) -> np.ndarray:
    """across: bytes x windows -> places x windows x filters; places come first so that pooling runs along memory."""
    n = len(across) - len(table) + 1
    out = np.take(table[0], across[:n], axis=0, mode="clip")
    more = np.empty_like(out)
    for k in range(1, len(table)):
        np.take(table[k], across[k : k + n], axis=0, out=more, mode="clip")
        out += more
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, length: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts cut into windows, short ones filled with spaces; and each window's text."""
    step, sizes = length - overlap, np.diff(offsets)
    count = np.maximum(-(-(sizes - overlap) // step), (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][owner] + nth * step)[:, None] + np.arange(length)
    inside = at < offsets[1:][owner][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], np.uint8(32)) if len(data) else np.zeros((0, length), np.uint8), owner


def train(texts: list[str], labels: list[str], widths: tuple[int, ...] = (2, 3, 5), filters: int = 16, window: int = 256, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 1, most: int = 4000) -> Model | None:
    """Adam on windows of labelled texts, at most `most` of them; None without any."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return None
    model = Model(languages, [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths], [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), window)
    data, offsets = flat(pa.array(texts, pa.large_string()))
    x, owner = windows(folded(data), offsets, window, model.overlap)
    y = np.array([languages.index(v) for v in labels])[owner] if len(owner) else np.zeros(0, int)
    pick = rng.permutation(len(x))[:most]
    x, y = x[pick], y[pick]
    params = [*model.tables, *model.biases, model.weights, model.offset]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            b, target = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
            # a window may be short at prediction: blank a random tail of some
            cut = rng.integers(16, window * 2, len(b))
            b = np.where(np.arange(window) < cut[:, None], b, np.uint8(32))
            best, pooled = [], []
            across = np.ascontiguousarray(b.T, np.intp)
            for table, bias in zip(model.tables, model.biases, strict=True):
                r = _responses(across, table)
                best.append(r.argmax(axis=0))
                pooled.append(np.take_along_axis(r, best[-1][None], 0)[0] + bias)
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            g = _softmax(h @ model.weights + model.offset).astype(np.float32)
            g[np.arange(len(b)), target] -= 1
            g /= len(b)
            gh = (g @ model.weights.T) * (raw > 0)
            grads = []
            for k, table in enumerate(model.tables):
                part, grad = gh[:, k * filters : (k + 1) * filters], np.zeros_like(table)
                for j in range(len(table)):
                    np.add.at(grad[j], (np.take_along_axis(b, best[k] + j, 1), np.arange(filters)[None, :]), part)
                grads.append(grad)
            grads += [gh[:, k * filters : (k + 1) * filters].sum(axis=0) for k in range(len(widths))]
            grads += [h.T @ g + 1e-4 * model.weights, g.sum(axis=0)]
            t += 1
            for p, a, c, grad in zip(params, m, v, grads, strict=True):
                a += 0.1 * (grad - a)
                c += 0.001 * (grad * grad - c)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, allowed: Column, per_language: int = 600, piece: int = 512, text: str = "text", lang: str = "lang", key: str = "doc_id", **options) -> Model | None:
    """Trains on a bounded sample of the rows where `allowed` holds: about `per_language` texts of each language by a hash of the id,
    of each a piece of at most `piece` characters at a place given by the hash.

    Only the sample comes to the driver: languages x per_language x piece characters, about.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000)) < F.try_element_at(share, F.col(lang)) * 1_000_000
    room = F.greatest(F.length(text) - piece, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64(F.lit(12), key), room) + 1).cast("int")
    sample = rows.filter(draw).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).substr(start, F.lit(piece)).alias("piece")).collect()
    sample.sort(key=lambda r: (r["id"] is None, r["id"], r["piece"]))
    return train([r["piece"] for r in sample], [r["lang"] for r in sample], **options)


def predict(model: Model | None, column: pa.Array, letters: np.ndarray, chunk: int = 1 << 19) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; letters: whether it has any."""
    n = len(column)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    data, offsets = flat(column)
    total = np.zeros((n, len(model.languages)))
    for lo, hi in slices(offsets, chunk):
        own = offsets[lo : hi + 1]
        if own[-1] == own[0]:
            continue
        # a very long text goes on in parts that overlap like windows
        for start in range(int(own[0]), int(own[-1]), max(chunk, 1)) if hi - lo == 1 else [int(own[0])]:
            end = min(int(own[-1]), start + chunk + model.overlap) if hi - lo == 1 else int(own[-1])
            part = np.clip(own, start, end) - start
            x, owner = windows(folded(data[start:end]), part, model.window, model.overlap)
            weight = (x != 32).sum(axis=1) + 1e-3
            np.add.at(total, owner + lo, model.probabilities(x) * weight[:, None])
    mass = total.sum(axis=1)
    known = letters & (mass > 0)
    share = total / np.where(mass > 0, mass, 1)[:, None]
    best = share.argmax(axis=1)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score after its own columns; own ones of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = rest.index(text)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = inner.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB whatever the data
    marked = inner.withColumn("letters", F.coalesce(F.col(f"c{place}").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = predict(held.value, batch.column(place), letters)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return marked.mapInArrow(run, schema).toDF(*rest, "lang_pred", "score")


def kept_languages(docs: DataFrame, model: Model | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """docs whose text has a language with a score of at least `least`; docs' own columns, whatever their names."""
    schema = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    marked = inner.withColumn("letters", F.coalesce(F.col(f"c{place}").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = predict(held.value, batch.column(place), letters)
            keep = pa.array((np.array(lang, object) != UNKNOWN) & (score >= least))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:-1]], names=schema.names)
        release()

    return marked.mapInArrow(run, schema)
