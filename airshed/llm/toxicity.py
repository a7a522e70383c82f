"""Toxicity: a counterfactual-regularised logistic classifier.

A document's features are the words it contains and their letter sequences (word edges
included), those that the training sample links with a label by more than chance.  In
labelled sentences that name a group, the group's name is swapped for the others of its
kind, and the squared change of the sentence's score is penalised, so that a neutral
mention of a group moves no score.

Trained on a bounded sample (``PER_CLASS`` rows of each label, ``MAX_BYTES`` of text, whole
texts) on the driver; scoring runs in the tasks.

Cases: null and empty texts have no features and get the score of the bias alone.  Without
labelled rows of both classes, every score is the share of label 1 (0 without any).  Extra
columns are ignored; rows that repeat are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from airshed.llm.common import labelled_sample, read, scored, with_columns

PER_CLASS, MAX_BYTES = 1200, 8 << 20
FOLD = (5, 0)
#: Least log-likelihood ratio of a feature: beyond chance among a million candidates.
LEAST_LLR, LEAST_DOCS = 25.0, 5
LENGTHS = (4, 5, 6)
DECAY, PENALTY, STEPS, RATE = 1e-3, 1.0, 400, 0.1
#: Words held in a task's feature cache.
CACHE = 200_000

#: Names of groups; those of one line are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"),
)
SWAPS = {term: [other for other in line if other != term] for line in IDENTITY for term in line}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def grams(word: str) -> set[str]:
    """The whole word and its sequences of LENGTHS letters, with ^ and $ at its edges."""
    edged = f"^{word}$"
    return {edged, *(edged[i : i + n] for n in LENGTHS for i in range(len(edged) - n + 1))}


class _Known(dict):
    """word -> the model's features in it; filled as words are met and emptied when full."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(self.index[g] for g in grams(word) if g in self.index)
        return found


class Toxicity:
    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = index, weights, bias
        self._known = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def features(self, text: str) -> set[int]:
        if self._known is None:
            self._known = _Known(self.index)
        return set().union(*map(self._known.__getitem__, words(text)))

    def logit(self, text: str) -> float:
        return self.bias + math.fsum(self.weights[i] for i in sorted(self.features(text)))

    def score(self, column: pa.Array) -> list[float]:
        return [1 / (1 + math.exp(-min(max(self.logit(x or ""), -500), 500))) for x in column.to_pylist()]


def _llr(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of a feature in a of na and b of nb documents."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0.0)

    p = (a + b) / (na + nb)
    return 0.0 if p in (0.0, 1.0) else 2 * (part(a, na, p) + part(b, nb, p))


def swapped(text: str) -> list[tuple[str, str]]:
    """(sentence, sentence with one group's name swapped) for every sentence that names a group and every other name."""
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        for term in sorted(set(_WORD.findall(sentence)) & SWAPS.keys()):
            out += [(sentence, re.sub(rf"\b{term}\b", other, sentence)) for other in SWAPS[term]]
    return out


def fit(rows: list[tuple[str, int]], penalty: float = PENALTY) -> Toxicity:
    y = np.array([label for _, label in rows], np.float64)
    if len(set(y)) < 2:
        p = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Toxicity({}, np.zeros(0), math.log(p / (1 - p)))
    found = [words(text) for text, _ in rows]
    toxic = [f for f, label in zip(found, y, strict=True) if label == 1]
    # A table of hashed counts first, so that only sequences of several documents are held by name.
    rough = np.zeros(1 << 22, np.int32)
    for f in toxic:
        rough[list({hash(g) & 0x3FFFFF for w in f for g in grams(w)})] += 1
    counts = [Counter(), Counter()]
    for f in toxic:
        counts[1].update({g for w in f for g in grams(w) if rough[hash(g) & 0x3FFFFF] >= LEAST_DOCS})
    counts[1] = Counter({g: c for g, c in counts[1].items() if c >= LEAST_DOCS})
    for f, label in zip(found, y, strict=True):
        if label == 0:
            counts[0].update({g for w in f for g in grams(w) if g in counts[1]})
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    chosen = [g for g, c in counts[1].items() if _llr(c, counts[0][g], n1, n0) >= LEAST_LLR]
    named = {f"^{w}$" for f in found for w in f & SWAPS.keys()}
    named |= {f"^{other}$" for w in named for other in SWAPS[w[1:-1]]}
    index = {g: i for i, g in enumerate(sorted(named | set(chosen)))}
    del counts, rough

    model = Toxicity(index, np.zeros(len(index)), 0.0)
    sets = [sorted(model.features(text)) for text, _ in rows]
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([i for s in sets for i in s], np.int64)
    pairs = [(model.features(a), model.features(b)) for text, _ in rows for a, b in swapped(text)]
    diff = [(k, i, sign) for k, (a, b) in enumerate(pairs) for sign, only in ((1.0, a - b), (-1.0, b - a)) for i in sorted(only)]
    drow, dcol, dval = (np.array([d[k] for d in diff], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    theta = np.zeros(len(index) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(row, theta[col], len(sets))
        g = (1 / (1 + np.exp(-z)) - y) * share
        grad = np.append(np.bincount(col, g[row], len(index)) + DECAY * theta[:-1] / max(1, len(index)) ** 0.5, g.sum())
        if len(pairs):
            change = np.bincount(drow, theta[dcol] * dval, len(pairs))
            grad[:-1] += 2 * penalty / len(pairs) * np.bincount(dcol, dval * change[drow], len(index))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Toxicity(index, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Toxicity:
    with_columns(docs, "doc_id", "text")
    return fit(labelled_sample(docs, labels, "toxic", FOLD, per_class, max_bytes))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, FOLD, train(docs, read(spark, sf_dir, "labels")).score)
