"""Mixing sources to target weights with soft membership.

A classifier trained on a labelled table gives every document a posterior over domains. Document rates, not negative,
start at one and are then moved by projected gradient descent on least squares: expected tokens by domain against their targets. A
step is a gradient in the metric of the second moments of the documents that aren't cut off (slightly damped); the sum of all steps
is projected to rates that aren't negative. It needs one grouped sum over the documents and is shortened until it betters the fit;
the end is reached when the targets are met, or no step betters it by a tenth. The driver sees a few numbers per step, never the
documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import add_columns, held_out, map_columns, one_each, packed, stored

#: Domains of the labels table, and the share of tokens that each is to have.
TARGETS = {"prose": 0.85, "junk": 0.10, "toxic": 0.05}
#: Labelled rows at most, chosen by hash; features at most; damping.
ROWS, FEATURES, PULL = 8_192, 512, 1e-3
#: First length of a step, and the one at which the rates count as settled; gap (in shares of all tokens) that counts as none.
STEP, LEAST, CLOSE = 0.8, 0.02, 1e-6


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain from a labels table: toxic, else junk where quality is 0, else prose. Rows without marks are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "prose")
    return labels.select("doc_id", domain.alias("domain")).filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))


def shape(text: str | None, found: list[bytes]) -> list[int]:
    """Hashed features of a text as a whole: shares of signs, upper case and repeated words, in eight steps each."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = n - len(raw.translate(None, b"|#$%&*!=<>~^_{}[]"))
    repeats = sum(a == b for a, b in zip(found, found[1:], strict=False))
    shares = (upper / n, signs / n, repeats / max(1, len(found)), 1 - len(set(found)) / max(1, len(found)))
    return [linear.MASK + 1 + 16 * i + min(8, int(24 * s)) for i, s in enumerate(shares)]


def train(documents: DataFrame, marks: DataFrame, domains: list[str], rows: int = ROWS, features: int = FEATURES) -> dict:
    """The classifier of domains, from at most ``rows`` labelled documents that aren't held out."""
    number = F.coalesce(*(F.when(F.col("domain") == d, F.lit(k)) for k, d in enumerate(domains)))
    known = marks.filter(F.col("domain").isin(domains) & ~held_out(F.col("doc_id"))).select("doc_id", number.alias("target"))
    few = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = stored(one_each(documents.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "doc_id", "text"))  # at most `rows` pairs of integers
    chosen = linear.select_features(sample, len(domains), features, more=shape)

    def make():
        found = linear.Features(frozenset(chosen), shape)
        return lambda texts, targets: {"hits": [sorted(found(t)) for t in texts], "target": targets}

    got = map_columns(sample, ["text", "target"], [("hits", "array<int>"), ("target", "int")], make).toPandas()
    if not len(got):
        return {"bias": np.zeros(len(domains)), "weights": {}}
    return linear.fit_softmax([list(map(int, h)) for h in got["hits"]], np.eye(len(domains), dtype=np.float32)[got["target"].to_numpy(int)], chosen)


def posteriors(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with n_tokens (words of the whole text) and posterior (by domain)."""

    def make():
        features, scorer = linear.Features(frozenset(model["weights"]), shape), linear.Scorer(model)

        def f(texts):
            parts = [linear.words(t) for t in texts]
            return {"n_tokens": [len(p) for p in parts], "posterior": [scorer(features.of(t, p)).tolist() for t, p in zip(texts, parts, strict=True)]}

        return f

    return add_columns(documents, ["text"], [("n_tokens", "long"), ("posterior", "array<double>")], make)


def rates(members: DataFrame, targets: dict[str, float], anchor: str | None = None, pull: float = PULL) -> tuple[DataFrame, dict]:
    """``members`` (n_tokens, posterior) with rate >= 0, such that the expected tokens of each domain come to its share of
    all tokens (with ``anchor``: of so many that this domain keeps its tokens) as nearly as can be, and what came out by domain. Documents without tokens keep rate 1."""
    k, want = len(targets), np.array(list(targets.values()), float)
    want = want / want.sum()
    size = members.agg(F.sum("n_tokens").alias("n")).head()
    tokens = float(size["n"] or 0)
    if tokens == 0:
        return members.withColumn("rate", F.lit(1.0)), {}
    # in units of all tokens: a document weighs n / tokens; its step is scaled by its own weight, so long and short ones move alike
    share, moved = F.col("n_tokens") / tokens, np.zeros(k)

    def rate() -> F.Column:
        """One, less all gradients so far, cut off at zero."""
        return F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("posterior")[d] * float(moved[d]) for d in range(k)), F.lit(0.0)))).otherwise(F.lit(1.0))

    def totals() -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain, and the second moments of the documents that aren't cut off: one pass."""
        open_ = F.when(F.col("r") > 0, F.col("s")).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.sum(F.col("r") * F.col("s") * F.col("posterior")[d]) for d in range(k)] + [F.sum(open_ * F.col("posterior")[i] * F.col("posterior")[j]) for i, j in pairs]
        got = np.array([float(x or 0) for x in members.select(rate().alias("r"), share.alias("s"), "posterior").agg(*sums).head()])
        moments = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            moments[i, j] = moments[j, i] = x
        return got[:k], moments

    have, moments = totals()
    goal = want * (have[list(targets).index(anchor)] / want[list(targets).index(anchor)] if anchor else 1.0)
    gap, step = have - goal, STEP
    while np.abs(gap).max() > CLOSE and step > LEAST:
        before = moved
        moved = before + step * np.linalg.solve(moments + max(pull, 1e-9) * np.eye(k), gap)  # a gradient in the metric of the domains' moments
        have, trial = totals()
        if np.linalg.norm(have - goal) > 0.9 * np.linalg.norm(gap):  # too long a step where rates are cut off, or as near as they can come
            step /= 2
        if np.linalg.norm(have - goal) < np.linalg.norm(gap):
            gap, moments = have - goal, trial
        else:
            moved = before
    made, reached = members.withColumn("rate", rate()), gap + goal
    return made, dict(zip(targets, (reached / max(1e-12, reached.sum())).tolist(), strict=True))


def mix(documents: DataFrame, marks: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = None, texts: bool = False) -> DataFrame:
    """``documents`` (with their ``texts``, or without) with n_tokens, posterior and rate, which replace columns of these names. ``marks``:
    doc_id, domain. Null, empty and wordless texts have no tokens and keep rate 1; repeated rows are rated each on its own, equal texts equally;
    without marks all domains are equally likely; an empty table stays empty."""
    names = list(targets)
    model = train(documents, marks, names)
    members = posteriors(documents, model)
    members = stored(members if texts else members.drop("text"))
    return rates(members, targets, anchor)[0]


def copies(rate: F.Column, key: F.Column) -> F.Column:
    """How many copies a document of that rate gets: the whole part, and one more with the chance of the rest, by hash of the key."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(documents: DataFrame, marks: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = None) -> DataFrame:
    """Rows of ``documents``, each as often as its rate says, with the columns of ``documents`` as they are, whatever their names. Odd
    rows are as in ``mix``."""
    names = list(targets)
    members = posteriors(packed(documents, doc_id=F.col("doc_id"), text=F.col("text")), train(documents, marks, names))
    rated = rates(stored(members.drop("text")), targets, anchor)[0]
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), copies(F.col("rate"), F.col("doc_id"))))).select("row.*")
