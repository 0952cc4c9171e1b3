"""A hashed linear model over the words of a text and their beginnings.

Features are selected by grouped counts over a bounded labelled sample, weights are fitted on the driver over those
features alone (both bounds are parameters), and every whole text is scored where it lies.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

MASK = (1 << 24) - 1
#: ASCII letters go to lower case, other ASCII signs but digits become spaces; bytes of other scripts stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
CACHE = 150_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def word_features(word: bytes) -> tuple[int, ...]:
    """The word, and its first four and five bytes, hashed."""
    found = [zlib.crc32(word) & MASK]
    if len(word) >= 4:
        found.append(zlib.crc32(b"^" + word[:4]) & MASK)
    if len(word) >= 5:
        found.append(zlib.crc32(b"~" + word[:5]) & MASK)
    return tuple(found)


class Features:
    """Features of texts among ``chosen`` (all, if None). What words give is remembered, up to a bound.
    ``more(text, words)`` adds hashed features of the text as a whole."""

    def __init__(self, chosen=None, more=None):
        self.chosen, self.more, self.memory = chosen, more, {}

    def __call__(self, text: str | None) -> set[int]:
        return self.of(text, words(text))

    def of(self, text: str | None, parts: list[bytes]) -> set[int]:
        """The features of a text whose words are known."""
        memory, chosen, found = self.memory, self.chosen, set()
        for word in set(parts):
            got = memory.get(word)
            if got is None:
                got = word_features(word)
                got = got if chosen is None else tuple(x for x in got if x in chosen)
                if len(memory) < CACHE:
                    memory[word] = got
            if got:
                found.update(got)
        if self.more:
            found.update(x for x in self.more(text, parts) if chosen is None or x in chosen)
        return found


def select_features(sample: DataFrame, classes: int, most: int, least: int = 3, more=None, z: float = 0.0, support: float = 0.0) -> list[int]:
    """The ``most`` features whose presence differs most between classes (largest z of one class against the rest, at
    least ``z``), of those in ``least`` rows and in ``support`` of all rows at least. ``sample``: text, target (class number, null: unlabelled, left out)."""

    def make():
        features = Features(more=more)

        def f(texts, targets):
            counts: Counter = Counter()
            for text, target in zip(texts, targets, strict=True):
                if target is not None:
                    counts.update((x, target) for x in features(text))
                    counts[-1, target] += 1
            return {"feature": [k[0] for k in counts], "target": [k[1] for k in counts], "n": list(counts.values())}

        return f

    part = map_columns(sample, ["text", "target"], [("feature", "int"), ("target", "int"), ("n", "long")], make)
    table = part.groupBy("feature").agg(*(F.sum(F.when(F.col("target") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)))
    table = table.persist()
    try:
        total = table.filter("feature = -1").collect()
        if not total:
            return []
        whole = [max(1, total[0][f"n{k}"]) for k in range(classes)]
        everything, n = sum(whole), sum((F.col(f"n{k}") for k in range(classes)), F.lit(0))
        p = n / everything
        scores = []
        for k in range(classes):
            rest = max(1, everything - whole[k])
            spread = F.sqrt(p * (1 - p) * (1 / whole[k] + 1 / rest) + 1e-12)
            scores.append(F.abs(F.col(f"n{k}") / whole[k] - (n - F.col(f"n{k}")) / rest) / spread)
        best = table.filter("feature >= 0").filter(n >= max(least, support * everything)).withColumn("z", F.greatest(*scores) if classes > 1 else scores[0]).filter(F.col("z") >= z)
        return [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(most).collect()]
    finally:
        table.unpersist()


def fit_softmax(hits: list[list[int]], targets: np.ndarray, chosen: list[int], l2: float = 3e-4, steps: int = 250) -> dict:
    """Softmax regression on presence of ``chosen`` against soft targets (rows sum to 1), by Adam over all rows."""
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(hits), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for i, row in enumerate(hits):
        x[i, [at[f] for f in row]] = 1
    w = np.zeros((x.shape[1], targets.shape[1]), np.float32)
    m, v, rate = np.zeros_like(w), np.zeros_like(w), 0.1
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - targets) / max(1, len(x)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        rate *= 0.995
    return {"bias": w[-1].astype(float), "weights": {f: w[i].astype(float) for f, i in at.items()}}


class Scorer:
    """Posteriors of feature sets under a model; sums go in one order, so that they are the same everywhere."""

    def __init__(self, model: dict):
        self.at = {f: i for i, f in enumerate(sorted(model["weights"]))}
        self.bias = np.asarray(model["bias"], float)
        self.table = np.array([model["weights"][f] for f in sorted(model["weights"])], float).reshape(len(self.at), len(self.bias))

    def __call__(self, found: set[int]) -> np.ndarray:
        z = self.bias + self.table[sorted(map(self.at.__getitem__, found))].sum(0) if found else self.bias
        z = np.exp(z - z.max())
        return z / z.sum()
