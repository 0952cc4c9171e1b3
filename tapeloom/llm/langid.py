"""Language identification by fusing evidence: text, declared markup language, address suffix, host.

Text likelihoods come from hashed features of a bounded labelled sample. How the declared language and the suffix go with the language
is counted over all rows; so are the languages of hosts, whose shares are smoothed towards those of their domain, and
these towards the whole (a row's own share is taken out of its prior). The posterior is the product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import add_columns, bounded_ids, held_out, join_hot, map_columns, one_each, stored
from .html import host, main_text

#: Labelled rows at most, chosen by hash; features at most; features that count in full; weight of a coarser prior.
ROWS, FEATURES, FULL, WEIGHT = 8_192, 2_048, 24, 8.0


def train(documents: DataFrame, rows: int = ROWS, features: int = FEATURES) -> tuple[list[str], dict]:
    """The languages of the labelled rows, and log likelihoods of features in each."""
    known = documents.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    few = stored(bounded_ids(known, "doc_id", rows))
    sample = stored(one_each(known.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id"), "doc_id", "text"))  # at most `rows` integers
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not names:
        return [], {}
    number = F.coalesce(*(F.when(F.col("lang") == x, F.lit(k)) for k, x in enumerate(names)))
    rows_ = sample.select("text", number.alias("target")).filter("target IS NOT NULL")
    chosen = linear.select_features(rows_, len(names), features)

    def make():
        found = linear.Features(frozenset(chosen))
        return lambda texts, targets: {"hits": [sorted(found(t)) for t in texts], "target": targets}

    got = map_columns(rows_, ["text", "target"], [("hits", "array<int>"), ("target", "int")], make).toPandas()
    size = np.bincount(got["target"].to_numpy(int), minlength=len(names)) + 1.0
    counts = {f: np.full(len(names), 0.5) for f in chosen}
    for hits, k in zip(got["hits"], got["target"], strict=True):
        for f in hits:
            counts[int(f)][k] += 1
    return names, {f: np.log(c / size) for f, c in counts.items()}


def text_evidence(rows: DataFrame, model: dict, languages: int) -> DataFrame:
    """``rows`` (text) with evidence: log likelihoods by language, tempered so that long texts don't drown all else; text goes."""

    def make():
        features = linear.Features(frozenset(model))

        def one(text):
            found = sorted(features(text))
            if not found:
                return [0.0] * languages
            total = np.sum([model[f] for f in found], axis=0) * min(1.0, FULL / len(found))
            return (total - total.max()).tolist()

        return lambda texts: {"evidence": [one(t) for t in texts]}

    return add_columns(rows, ["text"], [("evidence", "array<double>")], make).drop("text")


def suffix(url) -> F.Column:
    """A two-letter code in the address: the first part of its path, or else the end of its host."""
    path = F.lower(F.regexp_extract(url, "^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    end = F.regexp_extract(host(url), "\\.([a-z]{2})$", 1)
    return F.nullif(F.when(path != "", path).otherwise(end), F.lit(""))


def declared(html) -> F.Column:
    """The two or three letters of the language (the whole primary subtag) that the page's html element declares, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(html, "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})(?=[-_\"'\\s/>]|$)", 1)), F.lit(""))


def softmax(logits: F.Column, languages: int) -> F.Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def plus(a: F.Column, b: F.Column) -> F.Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (evidence, declared, suffix, host) with lang and probability. Null evidence says nothing. With declared or suffix null,
    that evidence is left out; a null host has the prior of all rows. Ties go to the language first in order."""
    k = len(names)
    rows = stored(rows.withColumn("own", softmax(F.col("evidence"), k)))
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)]
    world = np.array([float(x or 0) for x in rows.agg(*sums).head()])
    world = (world + 1) / (world.sum() + k)

    def with_likelihood(rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with how often their code goes with each language, as logarithms. Codes are two or three letters, so the table that is
        broadcast has at most 18,252 rows."""
        known = stored(rows.filter(F.col(column).rlike("^[a-z]{2,3}$")).groupBy(column).agg(*sums))
        whole = known.agg(*(F.sum(f"s{i}") for i in range(k))).head()
        if whole[0] is None:
            return rows.withColumn(f"of_{column}", nothing)
        logs = F.array(*(F.log((F.col(f"s{i}") + 0.5) / F.lit(whole[i] + 1.0)) for i in range(k)))
        return rows.join(F.broadcast(known.select(column, logs.alias(f"of_{column}"))), column, "left").withColumn(f"of_{column}", F.coalesce(f"of_{column}", nothing))

    nothing = F.array(*(F.lit(0.0) for _ in range(k)))
    for column in ("declared", "suffix"):
        rows = with_likelihood(rows, column)
    logits = plus(plus(F.col("evidence"), F.col("of_declared")), F.col("of_suffix"))
    rows = rows.withColumn("domain", F.coalesce(F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1), F.lit("")))
    hosts = rows.groupBy("domain", "host").agg(*sums)
    hosts = stored(hosts)
    domains = hosts.groupBy("domain").agg(*(F.sum(f"s{i}").alias(f"d{i}") for i in range(k)))
    table = stored(join_hot(hosts.filter("host IS NOT NULL"), stored(domains), "domain").select("host", F.array(*(F.col(f"s{i}") for i in range(k))).alias("at_host"), F.array(*(F.col(f"d{i}") for i in range(k))).alias("at_domain")))
    rows = join_hot(rows, table, "host", "left")
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    at_host, at_domain = F.coalesce("at_host", F.col("own")), F.coalesce("at_domain", F.col("own"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    other = less(at_domain, F.when(F.col("at_host").isNull(), at_domain).otherwise(F.col("own")))
    base = F.array(*(F.lit(float(WEIGHT * w)) for w in world))
    by_domain = F.transform(plus(other, base), lambda x: x / (total(other) + WEIGHT))
    same = F.when(F.col("at_host").isNull(), zero).otherwise(less(at_host, F.col("own")))
    prior = F.zip_with(same, by_domain, lambda x, p: (x + WEIGHT * p) / (total(same) + WEIGHT))
    fused = rows.withColumn("prior", prior).withColumn("posterior", softmax(plus(logits, F.transform("prior", lambda x: F.log(x + 1e-9))), k))
    best = F.array_max("posterior")
    lang = F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position("posterior", best).cast("int"))
    return fused.withColumn("probability", best).withColumn("lang", lang)


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id (the other is null), lang, probability, held_out for every document and page. Documents bring text
    and, as their host, their source; pages bring the main text, declared language, suffix and host. Without labelled
    documents, lang is null. Null and empty texts, html, urls and sources say nothing, so what is left decides; texts of any length are read
    whole; repeated rows stay (equal rows equally); ties go to the language first in order; an empty table adds no rows; other columns are left
    aside, whatever their names."""
    none = F.lit(None).cast("string")
    of_docs = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.concat(F.lit("source "), "source").alias("host"))

    def make():
        return lambda ids, htmls, *rest: {"page_id": ids, "text": [main_text(h) for h in htmls], "declared": rest[0], "suffix": rest[1], "host": rest[2]}

    seen = pages.select("page_id", "html", declared(F.col("html")).alias("declared"), suffix(F.col("url")).alias("suffix"), host(F.col("url")).alias("host"))
    texts = map_columns(seen, seen.columns, [("page_id", "long"), ("text", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string")], make)
    of_pages = texts.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host")
    names, model = train(documents)
    if not names:
        return of_docs.unionByName(of_pages).select("doc_id", "page_id", none.alias("lang"), F.lit(0.0).alias("probability"), held_out(F.col("doc_id")).alias("held_out"))
    rows = text_evidence(of_docs, model, len(names)).unionByName(text_evidence(of_pages, model, len(names)))
    return fuse(rows, names).select("doc_id", "page_id", "lang", "probability", held_out(F.col("doc_id")).alias("held_out"))
