"""Toxicity by a weighted finite-state pattern grammar.

Each transducer is a table: from a state and a token's class to a state, and what the state does to a weight there.

- threat: after an announcing token, a harming one within `REACH` tokens adds a weight;
- negation: within `NEAR` tokens after one, weights are divided;
- reported speech: after a verb of saying, or inside quotation marks, weights are divided;
- target: within `REACH` tokens after a person named or addressed, and (by the same table, read from the right) before one, weights are multiplied;
- insult: the weight of a token itself, learned for the stem it begins with.

The tables are composed to one by their product, which runs over a clause's classes. A clause scores the sum of its tokens' weights. A text's features are its
strongest clause, the sum over its clauses, and how many match; a logistic function fitted to labelled rows turns them into a score. Insult
stems and their weights are learned from labelled rows: beginnings of words that toxic texts have and clean ones have not. The function words of the other
transducers are fixed.

An Aho-Corasick automaton finds clauses that hold a trigger; only these are tokenised.

Defined results: null, empty and unmatched texts get the score of no match; texts of any length are read whole, in linear time; without labelled rows of both
labels nothing is learned, only the fixed grammar scores; repeated rows and rows with null ids each get their own row; an empty table gives an empty
result; columns named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of the grammar, in English, French, German and Spanish.
TARGETS = "you your yours u ur he she him her they them these those tu toi te vous il elle ils elles du dich dir ihr euch er sie tú usted ustedes él ella ellos".split()
NEGATIONS = "not never isn't aren't wasn't don't nobody kein keine nicht niemals pas jamais nunca jamás".split()
REPORTS = "said says say called calls wrote writes quoted reported sagte sagt nannte schrieb dit écrit appelé dijo dice llamó escribió".split()
ANNOUNCERS = "will gonna going shall werde werden vais allons voy vamos".split()
HARMS = "kill hurt beat destroy murder stab shoot töten umbringen verletzen tuer frapper matar golpear".split()

#: Tokens between an emission and a target or a negation that bears on it.
REACH, NEAR = 4, 2
TARGETED, NEGATED, REPORTED, THREAT = 1.5, 0.4, 0.6, 3.0
LEAST_STEM, MOST_STEM = 4, 10

_OTHER = re.compile(r"[\W\d_]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_TOKEN = re.compile(r"[^\W\d_]*[nN]'[tT](?![^\W\d_])|[^\W\d_]+|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")


#: Classes of tokens.
OTHER, TARGET, NEGATION, REPORT, ANNOUNCER, HARM, QUOTE = range(7)


@dataclass(frozen=True)
class Transducer:
    """step[state][class]: the next state; of states: what they add to a harming token's weight, what a token's weight is multiplied by, and the factor of a
    target near. State 0 begins."""

    step: list[list[int]]
    adds: list[float]
    factor: list[float]
    aim: list[float]

    def run(self, classes: list[int]) -> list[int]:
        out, state = [], 0
        for c in classes:
            state = self.step[state][c]
            out.append(state)
        return out


def distance(kind: int, reach: int, adds: float = 0.0, factor: float = 1.0, aim: float = 1.0) -> Transducer:
    """Counts the tokens since one of a class: states 1 to reach + 1 have it at a distance of 0 to reach, state 0 has none."""
    step = [[1 if c == kind else s + 1 if 0 < s <= reach else 0 for c in range(7)] for s in range(reach + 2)]
    near = [s > 0 for s in range(reach + 2)]
    return Transducer(step, [adds * n for n in near], [factor if n else 1.0 for n in near], [aim if n else 1.0 for n in near])


def speech(factor: float) -> Transducer:
    """States: bit 0 after a verb of saying, bit 1 inside quotation marks."""
    step = [[s | 1 if c == REPORT else s ^ 2 if c == QUOTE else s for c in range(7)] for s in range(4)]
    return Transducer(step, [0.0] * 4, [factor if s else 1.0 for s in range(4)], [1.0] * 4)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The product: state i * |b| + j stands for state i of a and j of b."""
    m, pairs = len(b.step), [(i, j) for i in range(len(a.step)) for j in range(len(b.step))]
    return Transducer(
        [[a.step[i][c] * m + b.step[j][c] for c in range(7)] for i, j in pairs], [a.adds[i] + b.adds[j] for i, j in pairs],
        [a.factor[i] * b.factor[j] for i, j in pairs], [max(a.aim[i], b.aim[j]) for i, j in pairs],
    )


PARTS = (distance(ANNOUNCER, REACH, adds=THREAT), distance(NEGATION, NEAR, factor=NEGATED), speech(REPORTED), distance(TARGET, REACH, aim=TARGETED))
COMPOSED = reduce(compose, PARTS)
#: Read from the right; a token's own class is no target before itself.
AHEAD = distance(TARGET, REACH, aim=TARGETED)


@dataclass
class Grammar:
    stems: dict[str, float]
    slope: tuple[float, float, float]
    offset: float

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        """Finds " stem" and " harm" in a text in lower case whose non-letters are spaces."""
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for word in (*self.stems, *HARMS):
                key = " " + word
                a.add_word(key, len(key) - 1)
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weight(self, token: str) -> float:
        return max((self.stems.get(token[:n], 0.0) for n in range(LEAST_STEM, min(len(token), MOST_STEM) + 1)), default=0.0)

    def clause(self, text: str) -> float:
        """Runs the composed table over one clause."""
        tokens = [t.lower() for t in _TOKEN.findall(text)]
        classes = [_CLASSES.get(t, OTHER) for t in tokens]
        behind = COMPOSED.run(classes)
        ahead = AHEAD.run(classes[::-1])[::-1]
        emitted = 0.0
        for token, kind, state, then in zip(tokens, classes, behind, ahead, strict=True):
            weight = 0.0 if kind == QUOTE else self.weight(token) + (COMPOSED.adds[state] if kind == HARM else 0.0)
            if weight:
                emitted += weight * COMPOSED.factor[state] * max(COMPOSED.aim[state], AHEAD.aim[then])
        return emitted

    def features(self, text: str) -> tuple[float, float, float] | None:
        plain = " " + _OTHER.sub(" ", text).lower()
        hits = [end for end, _ in self.automaton().iter(plain)]
        if not hits:
            return None
        if len(plain) != len(text) + 1:  # letters that are longer in lower case
            place = [0, *(i for i, c in enumerate(text, 1) for _ in (c.lower() if c.isalpha() else " "))]
            hits = [place[end] for end in hits]
        ends = [m.start() for m in _CLAUSE_END.finditer(text)]
        scores, done = [], -1
        for end in hits:
            if end - 1 < done:
                continue
            k = bisect_left(ends, end - 1)
            done = ends[k] if k < len(ends) else len(text)
            scores.append(self.clause(text[ends[k - 1] + 1 if k else 0 : done]))
        scores = [s for s in scores if s > 0]
        return (max(scores), math.log1p(sum(scores)), math.log1p(len(scores))) if scores else None

    def score(self, text: str | None) -> float:
        f = self.features(text) if text else None
        z = self.offset + (sum(a * b for a, b in zip(self.slope, f, strict=True)) if f else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_ROLES = {w: role for role, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (ANNOUNCER, ANNOUNCERS)) for w in words}
_CLASSES = {**dict.fromkeys(HARMS, HARM), **dict.fromkeys(_QUOTES, QUOTE), **_ROLES}


def stems_of(text: str) -> set[str]:
    """The beginnings of a text's words that may be learned."""
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", text)}
    return {w[:n] for w in words for n in range(LEAST_STEM, min(len(w), MOST_STEM) + 1)} - _ROLES.keys()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(stems_of(text or ""))
    stems = list({*seen[0], *seen[1]})
    yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([seen[1][s] for s in stems], pa.int64()), pa.array([seen[0][s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_label: int = 3000, most_stems: int = 3000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Learns from a bounded sample of labelled rows where `allowed` (of labels) holds: about `per_label` of each label by a hash of the id, whole texts.

    Stems are counted where the texts are; at most `most_stems` of the heaviest, and three numbers for each sampled text, come to the driver.
    """
    rows = labels.filter(allowed & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("toxic")).dropDuplicates([key])
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Grammar({}, (1.0, 0.5, 0.0), -3.0)
    rate = F.when(F.col("toxic") == 1, per_label / totals[1]).otherwise(per_label / totals[0])
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(31), key), F.lit(1_000_000)) < rate * 1_000_000)  # about 2 * per_label rows: small enough to broadcast
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(drawn), key).select("text", "toxic")
    counts = sample.mapInArrow(_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = {y: max(1, min(per_label, totals[y])) for y in (0, 1)}
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("clean") + 0.5) / (size[0] + 1))
    worth = F.col("toxic") >= max(4, size[1] // 100)
    pure = F.col("clean") / size[0] <= 0.02 * F.col("toxic") / size[1]
    best = counts.filter(worth & pure).select("stem", odds.alias("weight")).filter("weight >= 2").orderBy(F.desc("weight"), "stem").limit(most_stems).collect()
    grammar = Grammar({r[0]: float(r[1]) for r in best}, (1.0, 0.5, 0.0), -3.0)
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [held.value.features(t or "") or (0.0, 0.0, 0.0) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in f], pa.float64()) for k in range(3)] + [batch.column(1).cast(pa.int32())], names=["a", "b", "c", "toxic"])

    points = sorted(tuple(r) for r in sample.mapInArrow(measure, "a double, b double, c double, toxic int").collect())
    grammar.slope, grammar.offset = logistic(np.array([p[:3] for p in points]).reshape(-1, 3), np.array([p[3] for p in points], float))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[tuple[float, float, float], float]:
    """Newton's method, both labels weighing as much; slopes are kept from falling below 0."""
    if not len(y) or y.min() == y.max():
        return (1.0, 0.5, 0.0), -3.0
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(4), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # more matches never lower a score
    return tuple(float(max(v, 0.0)) for v in w[:3]), float(w[3])


def score_texts(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted after its own columns; own ones of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    at = rest.index(text)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = inner.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    held = docs.sparkSession.sparkContext.broadcast(grammar)  # at most `most_stems` stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([held.value.score(t) for t in batch.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*rest, "score", "predicted")
