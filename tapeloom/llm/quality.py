"""Quality by a weak-label model: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelmodel, linear
from .common import add_columns, bounded_ids, held_out, map_columns, one_each, stored
from .mixing import shape

#: Frequent words of the four languages.
STOPWORDS = frozenset(
    x.encode()
    for x in (
        "the of and to in is that for it was with as on be by an are this from or a der die das und ist nicht mit den von zu ein eine für auf im dem des sich als "
        "le la les de et un une des en du que est pour dans par sur au avec pas el los las y se con por una del para al lo como su".split()
    )
)
#: Documents at most that the scorer learns from, chosen by hash; features at most; score from which a document counts as good.
ROWS, FEATURES, THRESHOLD = 16_384, 1_024, 0.5


def votes(text: str | None) -> list[int]:
    """Heuristic labellers of one text: 1 good, -1 bad, 0 abstains. Very short texts get a vote of length alone."""
    raw = (text or "").encode("utf-8", "replace")
    found = linear.words(text)
    n, size = len(found), max(1, len(raw))
    if n < 3:
        return [-1] + [0] * 9
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = len(raw) - len(raw.translate(None, b"|#$%&*!=<>~^_{}[]"))
    ends = len(raw) - len(raw.translate(None, b".?"))
    letters = sum(map(len, found))
    repeats = sum(a == b for a, b in zip(found, found[1:], strict=False)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stop = sum(w in STOPWORDS for w in found) / n
    return [
        1 if n >= 20 else 0,
        -1 if upper > 0.25 * size else 1 if upper < 0.1 * size else 0,
        -1 if signs > 0.03 * size else 1 if signs < 0.01 * size else 0,
        -1 if repeats > 0.2 else 1 if repeats < 0.05 else 0,
        -1 if n > 50 and len(set(found)) < 0.25 * n else 0,
        1 if stop > 0.12 else -1 if stop < 0.03 and n >= 10 else 0,
        1 if 3 <= letters / n <= 10 else -1,
        1 if ends >= n / 40 else -1 if n >= 40 else 0,
        -1 if len(lines) > 5 and len(set(lines)) < 0.5 * len(lines) else 0,
        -1 if letters < 0.6 * size else 1 if letters > 0.75 * size else 0,
    ]


def train(documents: DataFrame, rows: int = ROWS, features: int = FEATURES) -> dict:
    """The scorer. The labellers' votes are counted over all documents (at most 3 ** 10 patterns reach the driver) and the label model is fitted
    to those counts; it sees no marks. The scorer learns the posteriors of at most ``rows`` documents chosen by hash, one text for each id."""

    def make_votes():
        return lambda texts: {"votes": [votes(t) for t in texts]}

    cast = map_columns(documents, ["text"], [("votes", "array<int>")], make_votes).groupBy("votes").count().collect()
    if not cast:
        return {"bias": np.zeros(2), "weights": {}}
    of, _ = labelmodel.of_patterns([list(r["votes"]) for r in cast], [r["count"] for r in cast], 0.8)
    few = stored(bounded_ids(documents, "doc_id", rows))
    sample = one_each(documents.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "doc_id", "text")  # at most `rows` integers

    def make_target():
        return lambda texts: {"text": texts, "p": [of.get(tuple(votes(t)), 0.5) for t in texts]}

    soft = stored(map_columns(sample, ["text"], [("text", "string"), ("p", "double")], make_target))
    chosen = linear.select_features(soft.select("text", (F.col("p") >= 0.5).cast("int").alias("target")), 2, features, more=shape)

    def make_hits():
        found = linear.Features(frozenset(chosen), shape)
        return lambda texts, p: {"hits": [sorted(found(t)) for t in texts], "p": p}

    got = map_columns(soft, ["text", "p"], [("hits", "array<int>"), ("p", "double")], make_hits).toPandas()
    p = got["p"].to_numpy()
    return linear.fit_softmax([list(map(int, h)) for h in got["hits"]], np.stack([1 - p, p], 1).astype(np.float32), chosen)


def score(documents: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``documents`` with ``name``: how likely the document is good, from the whole text. A null text counts as empty."""

    def make():
        features, scorer = linear.Features(frozenset(model["weights"]), shape), linear.Scorer(model)
        return lambda texts: {name: [float(scorer(features(t))[1]) for t in texts]}

    return add_columns(documents, ["text"], [(name, "double")], make)


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) for every document, from its whole text alone. A null text counts as empty; empty and
    long texts, null ids and repeated rows are scored like others (equal texts equally); an empty table gives no rows; other columns of
    ``documents`` are left aside, whatever their names."""
    rows = documents.select("doc_id", "text")
    scored = score(rows, train(rows)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
