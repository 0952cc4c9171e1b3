"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, a linear classifier.

Voters are fixed lists of insults, patterns, and lexicons gathered from annotated rows that aren't held out: terms (words and word
beginnings) of toxic documents that hardly occur in others. No mark is a vote. The votes of all documents, annotated or not, are
counted by pattern; the label model estimates accuracies and correlations of the voters from those counts alone, and its posteriors
train the classifier. At last two numbers, a slope and a shift, are fitted to the annotated rows, so that scores are probabilities.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelmodel, linear
from .common import add_columns, bounded_ids, held_out, map_columns, one_each, packed, stored

#: Words of insult, by language; each list votes on its own.
LEXICONS = {
    "en mind": "idiot idiots moron morons stupid dumb imbecile fool fools clown clowns cretin dimwit dunce halfwit lunatic nitwit numbskull simpleton dolt",
    "en worth": "trash scum loser losers worthless pathetic garbage vermin lowlife degenerate parasite filth leech nobody failure subhuman",
    "en scorn": "disgusting hate shut ugly filthy vile repulsive revolting despicable loathsome nasty hideous coward bastard bitch crap damn hell asshole",
    "de": "idiot idioten dumm dumme dummkopf trottel abschaum versager widerlich arschloch blödmann depp drecksau hurensohn mistkerl penner schlampe schwachkopf vollidiot",
    "fr": "idiot idiote imbécile débile ordure connard connasse minable dégoûtant abruti crétin salaud salope enfoiré raclure pourriture bâtard",
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso cabrón gilipollas imbéciles pendejo mierda cretino tarado payaso",
}
TERMS = {name: frozenset(x.encode() for x in text.split()) for name, text in LEXICONS.items()}
ADDRESS = re.compile(rb"\b(?:you|your|du|ihr|vous|eres)\b")
#: Rows at most, chosen by hash: annotated ones for lexicons, others for training; features at most; lexicons gathered.
ROWS, FEATURES, MINED = 16_384, 1_024, 6
#: How far beyond chance a term must differ between classes, its least share of rows; how strongly weights are drawn to zero.
BEYOND, SUPPORT, L2 = 4.0, 0.001, 3e-5
#: Share of toxic documents among those with a term from which it may speak for toxicity: copies of one document lift others.
SURE = 0.9
THRESHOLD = 0.3


def fixed_votes(text: str | None, have: set[bytes]) -> list[int]:
    """One vote per lexicon, then per pattern (shouting, pile-up of exclamation marks, insult with direct address)."""
    votes = [int(not terms.isdisjoint(have)) for terms in TERMS.values()]
    if not any(votes):
        return votes + [0, 0, 0]
    raw = (text or "").encode("utf-8", "replace")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return votes + [int(upper > 0.4 * len(raw) > 8), int(b"!!!" in raw), int(ADDRESS.search(raw) is not None)]


class Voters:
    """All votes on a text: fixed ones, one per gathered lexicon, one of whether two gathered terms meet, and one against, where all are
    silent. At most 2 ** 16 patterns can occur."""

    def __init__(self, groups: dict[int, int]):
        self.groups, self.features = groups, linear.Features(frozenset(groups))

    def __call__(self, text: str | None) -> tuple[int, ...]:
        parts = linear.words(text)
        votes, terms = fixed_votes(text, set(parts)), [0] * MINED
        words_with = self.features.of(text, parts)
        for x in words_with:
            terms[self.groups[x]] = 1
        found = [*votes, *terms, int(sum(terms) > 1)]
        return (*found, 0 if any(found) else -1)


def gathered(sample: DataFrame, features: int) -> tuple[dict[int, int], list[int]]:
    """Terms of the lexicons that annotated rows (text, target) give, each with the lexicon it is dealt to, and all terms that differ
    between the classes beyond chance."""
    differ = linear.select_features(sample, 2, features, z=BEYOND, support=SUPPORT)

    def make():
        found = linear.Features(frozenset(differ))

        def f(texts, targets):
            counts: Counter = Counter()
            for text, target in zip(texts, targets, strict=True):
                counts.update((x, target) for x in found(text))
            return {"term": [k[0] for k in counts], "target": [k[1] for k in counts], "n": list(counts.values())}

        return f

    part = map_columns(sample, ["text", "target"], [("term", "int"), ("target", "int"), ("n", "long")], make)
    table = part.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    rows = table.filter((F.col("toxic") >= 3) & (F.col("toxic") >= SURE * F.col("n"))).orderBy(F.desc("toxic"), "term").collect()  # at most `features`
    return {r["term"]: i % MINED for i, r in enumerate(rows)}, differ


def train(documents: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES) -> dict:
    """The classifier. Lexicons and the final slope come from at most ``rows`` annotated documents that aren't held out; the label model from the
    votes of all documents; the classifier from the posteriors of at most ``rows`` documents chosen by hash, as many of those that a
    voter speaks for, and the annotated ones. Without annotated rows, or where they hold one class only, the fixed voters do it alone."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("target")).filter(F.col("target").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("target").alias("target"))
    few = stored(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = documents.select("doc_id", "text")
    sample = stored(one_each(texts.join(F.broadcast(few), "doc_id"), "doc_id", "text"))  # at most `rows` pairs of integers
    groups, differ = gathered(sample, features)
    lexicon = {linear.word_features(x)[0] for terms in TERMS.values() for x in terms}

    def make_votes():
        voters = Voters(groups)
        return lambda ids, texts: {"doc_id": ids, "votes": [voters(t) for t in texts]}

    voted = stored(map_columns(texts, ["doc_id", "text"], [("doc_id", "long"), ("votes", "array<int>")], make_votes))
    cast = voted.groupBy("votes").count().collect()  # at most 2 ** 16 patterns
    if not cast:
        return {"bias": np.array([0.0, -3.0]), "weights": {}}
    of, _ = labelmodel.of_patterns([list(r["votes"]) for r in cast], [r["count"] for r in cast], 0.1)
    spoken = bounded_ids(voted.filter(F.exists("votes", lambda v: v > 0)), "doc_id", rows)
    ids = stored(bounded_ids(voted, "doc_id", rows).unionByName(spoken).unionByName(few.select("doc_id")).distinct())
    learn = one_each(texts.join(F.broadcast(ids), "doc_id"), "doc_id", "text").join(F.broadcast(few), "doc_id", "left")  # at most 3 * `rows` integers
    chosen = sorted({*differ, *lexicon})

    def make():
        found, voters = linear.Features(frozenset(chosen)), Voters(groups)
        return lambda texts, targets: {"hits": [sorted(found(t)) for t in texts], "p": [of.get(voters(t), 0.0) for t in texts], "target": targets}

    got = map_columns(learn, ["text", "target"], [("hits", "array<int>"), ("p", "double"), ("target", "int")], make).toPandas()
    if not len(got):
        return {"bias": np.array([0.0, -3.0]), "weights": {}}
    hits, p = [list(map(int, x)) for x in got["hits"]], got["p"].to_numpy(float)
    with_term, toxic = Counter(x for row in hits for x in row), Counter()
    for row, q in zip(hits, p, strict=True):
        for x in row:
            toxic[x] += q
    sure = {x for x in with_term if toxic[x] >= SURE * with_term[x]}
    chosen, hits = [x for x in chosen if x in sure], [[x for x in row if x in sure] for row in hits]
    model = linear.fit_softmax(hits, np.stack([1 - p, p], 1).astype(np.float32), chosen, L2, 400)
    marked = got["target"].notna().to_numpy()
    return calibrated(model, [h for h, m in zip(hits, marked, strict=True) if m], got["target"][marked].to_numpy(int))


def calibrated(model: dict, hits: list[list[int]], marks: np.ndarray) -> dict:
    """``model`` with its logits scaled and shifted to fit ``marks`` (0 or 1) by logistic regression on the logit alone; as it is, where
    there are fewer than eight of a class."""
    if min((marks == 1).sum(), (marks == 0).sum()) < 8:
        return model
    scorer = linear.Scorer(model)
    z = np.array([np.log(q[1] + 1e-12) - np.log(q[0] + 1e-12) for q in (scorer(set(h)) for h in hits)])
    at = np.array([1.0, 0.0])  # slope and shift, drawn a little to one and zero

    def loss(at: np.ndarray) -> float:
        t = at[0] * z + at[1]
        return float((np.logaddexp(0, t) - marks * t).sum() + ((at - [1, 0]) ** 2).sum() / 2)

    for _ in range(50):  # Newton steps, halved until they gain: whole ones overshoot where all rows are far from the boundary
        q = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -500, 500)))
        w = q * (1 - q)
        g = np.array([((q - marks) * z).sum(), (q - marks).sum()]) + at - [1, 0]
        step = np.linalg.solve(np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]]), g)
        shorter = next((s for s in 0.5 ** np.arange(40) if loss(at - s * step) < loss(at)), None)
        if shorter is None:
            break
        at = at - shorter * step
    a, b = at
    if a <= 0:
        return model
    return {"bias": a * np.asarray(model["bias"]) + np.array([0.0, b]), "weights": {x: a * np.asarray(w) for x, w in model["weights"].items()}}


def score(documents: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``documents`` with ``name``: how likely label 1 is, from the whole text alone. A null text counts as empty."""

    def make():
        features, scorer = linear.Features(frozenset(model["weights"])), linear.Scorer(model)
        return lambda texts: {name: [float(scorer(features(t))[1]) for t in texts]}

    return add_columns(documents, ["text"], [(name, "double")], make)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose score is under the threshold, with all their columns as they are, whatever their names. Odd rows are
    as in ``toxicity``."""
    model = train(documents, labels)
    return score(packed(documents, text=F.col("text")), model).filter(F.col("score") < THRESHOLD).select("row.*")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null text counts as empty; empty and long texts, null ids and repeated rows
    are scored like others (equal texts equally); an id that is marked more than once counts as toxic if it is in one mark; an empty
    table gives no rows; other columns are left aside, whatever their names."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
