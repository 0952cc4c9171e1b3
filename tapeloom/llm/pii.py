"""Personal data: exact base patterns, and terms that disclose protected entities, found from corpus co-occurrence.

A base span's value is a protected entity. Over the whole corpus, Spark counts each term and each term's occurrences
near each entity, by document. A term discloses an entity if, given the term, the entity is likely; if chance alone (terms strewn over
the corpus whatever is near) would hardly let the two meet so often, even once among all pairs that were counted; and if documents that
are no near-copies of each other hold both, so that copies of one passage count once. Such terms are generalised wherever they occur.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, join_hot, map_columns, packed, stored
from .linear import words

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns. A match of e-mail is found from its domain, leftwards over the local part.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words on each side of an entity, documents unlike each other and share that make a term disclosing, chance that any pair passes by accident.
NEAR, CONTEXTS, SHARE, CHANCE = 6, 3, 0.5, 0.01
#: Minima by which documents are told apart.
SKETCH = 8
#: Disclosing terms up to which each task holds all of them; beyond, they are joined to the documents by term.
HELD = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in code points, sorted. Matches are leftmost and don't overlap within a kind."""
    found, past = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > past and text[start - 1] in LETTERS:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                past = m.end()
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with a space for each character of a span."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at : max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join([*parts, text[at:]])


def entity(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else "".join(DIGIT.findall(text[start:end]))
    return f"{KINDS[kind]} {value}"


def is_term(word: bytes) -> bool:
    return len(word) >= 4 and not 48 <= word[0] <= 57


def sketch(text: str, digest) -> bytes:
    """SKETCH minima of hashed shingles of three words, four bytes each: near-copies agree in most, unlike texts in none."""
    parts = text.lower().split()
    line = {" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))}
    hashes = np.fromiter((digest(x) for x in line), np.uint64, len(line))
    odd = np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((hashes[:, None] * odd[None, :]).min(0) >> np.uint64(32)).astype("<u4").tobytes()


def gather(documents: DataFrame) -> DataFrame:
    """term, entity, sketch, n: how often each term occurs (entity and sketch null), and how many of its occurrences are near each entity, by the sketch of the document."""

    def make():
        from xxhash import xxh64_intdigest as digest

        def f(texts):
            totals: Counter = Counter()
            for text in texts:
                if not text:
                    continue
                spans = base_spans(text)
                plain = masked(text, spans) if spans else text
                totals.update((w, None, None) for w in words(plain) if is_term(w))
                if not spans:
                    continue
                at, known = [], []
                for m in TERM.finditer(plain):
                    if w := words(m[0]):
                        at.append(m.start())
                        known.append(w[0])
                mark = sketch(text, digest)
                near: dict[str, set[int]] = {}  # by entity, the occurrences beside any of its spans, each once
                for span in spans:
                    i, j = bisect_left(at, span[0]), bisect_left(at, span[2])
                    near.setdefault(entity(text, span), set()).update(range(max(0, i - NEAR), i), range(j, min(len(at), j + NEAR)))
                for who, places in near.items():
                    totals.update((known[p], who, mark) for p in places if is_term(known[p]))
            return {"term": [k[0].decode("utf-8", "replace") for k in totals], "entity": [k[1] for k in totals], "sketch": [k[2] for k in totals], "n": list(totals.values())}

        return f

    part = map_columns(documents, ["text"], [("term", "string"), ("entity", "string"), ("sketch", "binary"), ("n", "long")], make)
    return part.groupBy("term", "entity", "sketch").agg(F.sum("n").alias("n"))


def disclosing_terms(documents: DataFrame, contexts: int = CONTEXTS, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """term, and the entity kind it discloses most of: terms past the thresholds, from counts over all documents. ``contexts``: documents
    with term and entity, where near-copies count as one: the least number, over the parts of the sketch, of different values. How surprising it is that they meet as often as they
    do, where e times are to be expected, is n log2(n / e) - (n - e) log2(euler) bits (the large-deviation bound of a Poisson number);
    it must come to log2(pairs / ``chance``). A null or empty text holds no term; documents without doc_id count like others; repeated rows
    occur again, but are near-copies; of entities that a term is near equally often, the kind of the least is taken; an empty table gives no rows."""
    counts = stored(gather(documents))
    by_doc = counts.filter(F.col("entity").isNotNull())
    pairs = stored(by_doc.groupBy("term", "entity").agg(F.sum("n").alias("near"), F.count("sketch").alias("documents")))
    known = pairs.filter(F.col("documents") >= contexts)
    totals = counts.filter(F.col("entity").isNull()).select("term", F.col("n").alias("total"))
    size = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]
    frequency = pairs.groupBy("entity").agg(F.sum("near").alias("entity_near"))
    rated = known.join(totals.hint("merge"), "term").join(frequency.hint("merge"), "entity")
    p = F.col("near") / F.col("total")
    expected = F.col("total") * F.col("entity_near") / F.lit(float(max(1, size)))
    surprise = F.col("near") * F.log2(F.col("near") / expected) - (F.col("near") - expected) / math.log(2)
    bits = math.log2(max(1, pairs.count()) / chance)
    rated = stored(rated.filter((p >= share) & (F.col("near") > expected) & (surprise >= bits)).select("term", "entity", "near"))
    parts = [F.countDistinct(F.substring("sketch", 4 * i + 1, 4)) for i in range(SKETCH)]
    unlike = by_doc.join(rated.select("term", "entity").hint("merge"), ["term", "entity"]).groupBy("term", "entity").agg(F.least(*parts).alias("unlike"))
    rated = rated.join(unlike.filter(F.col("unlike") >= contexts).hint("merge"), ["term", "entity"])
    return rated.groupBy("term").agg(F.split(F.min(F.struct(-F.col("near"), "entity"))["entity"], " ")[0].alias("kind"))


def find(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``documents`` with spans (array<string>, kind:start:end by start then kind, code points, end exclusive), which replaces a column of that
    name; others pass through. Base spans always stay; terms of ``terms`` (disclosing_terms of these documents, if None) are added outside base
    spans. A null or empty text has none; texts of any length are read whole; repeated rows stay, each with its spans; rows without a
    doc_id are like others; an empty table stays empty."""
    terms = stored((disclosing_terms(documents) if terms is None else terms).select("term").distinct())
    few = terms.limit(HELD + 1).count() <= HELD
    if few:
        flagged = frozenset(r["term"] for r in terms.collect())
        return add_columns(documents, ["text"], [("spans", "array<string>")], lambda: lambda texts: {"spans": [_spans(t, flagged) for t in texts]})
    # each different text once: its words are joined to the terms, and what it has of them goes back to its rows
    signed = packed(documents, text=F.col("text"), sign=F.xxhash64("text"))
    once = signed.groupBy("sign").agg(F.first("text").alias("text"))

    def make_words():
        return lambda signs, texts: _exploded(signs, texts)

    by_text = map_columns(once, ["sign", "text"], [("sign", "long"), ("term", "string")], make_words)
    own = stored(by_text.join(terms.hint("merge"), "term").groupBy("sign").agg(F.collect_set("term").alias("own")))

    def make():
        return lambda texts, own: {"spans": [_spans(t, frozenset(o or ())) for t, o in zip(texts, own, strict=True)]}

    made = add_columns(join_hot(signed, own, "sign", "left"), ["text", "own"], [("spans", "array<string>")], make)
    return made.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns if c.lower() != "spans"), "spans")


def _exploded(signs, texts) -> dict:
    out: dict[str, list] = {"sign": [], "term": []}
    for i, text in zip(signs, texts, strict=True):
        got = [w.decode("utf-8", "replace") for w in set(words(text)) if is_term(w)]
        out["sign"] += [i] * len(got)
        out["term"] += got
    return out


def _spans(text: str | None, flagged: frozenset) -> list[str]:
    if not text:
        return []
    spans = base_spans(text)
    if flagged and any(w.decode("utf-8", "replace") in flagged for w in set(words(text))):
        plain = masked(text, spans)
        for m in TERM.finditer(plain):
            if (w := words(m[0])) and w[0].decode("utf-8", "replace") in flagged:
                spans.append((m.start(), 4, m.end()))
        spans.sort()
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]


def sanitise(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``documents`` with each span of the text replaced by its kind in brackets; overlapping spans become one. Where n_chars is
    a column, it follows (where the text is null, it stays). Texts without spans stay as they are; all other columns do, whatever their
    names. Odd rows are as in ``find``."""
    rows = packed(documents, doc_id=F.col("doc_id"), text=F.col("text"))
    found = find(rows, terms)

    def make():
        return lambda texts, spans: {"text": [_replaced(t, s) for t, s in zip(texts, spans, strict=True)]}

    made = add_columns(found, ["text", "spans"], [("text", "string")], make)
    length = lambda c: F.coalesce(F.length("text"), F.col(f"row.`{c}`")).cast(documents.schema[c].dataType)
    new = {"text": F.col("text"), **{c: length(c) for c in documents.columns if c == "n_chars"}}
    return made.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


def _replaced(text: str | None, spans: list[str]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in (x.split(":") for x in spans):
        start, end = int(start), int(end)
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
