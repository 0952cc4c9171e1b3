"""Token counts without token ids: each distinct pre-token is encoded once, documents only add up counts.

A pre-token is a stretch of text whose edges no piece of the vocabulary crosses, so that its number of pieces doesn't depend on what
stands beside it. The edges are read off the vocabulary: a piece holds a space at its beginning only, and characters that are in no piece of
several characters stand alone. The distinct pre-tokens of the whole table are encoded, once each; joined to the frequencies in each
document, they give the sum of frequency times pieces. Those that hold more than one in ``FREQUENT`` of all frequencies (so at most that many)
are joined where the frequencies are counted, all others by a shuffle in which no key is hot and a word is eight bytes.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, add_columns, stored

#: How the model writes a space.
SPACE = "▁"
#: Pre-tokens that hold more than one in so many of all frequencies go to all tasks: at most so many, of less than KEY characters.
FREQUENT, KEY = 1_000_000, 64
#: Different pre-tokens that a task holds before it passes their counts on.
HELD = 200_000


class Pieces:
    """A sentencepiece model as counts of pieces: how a text splits into pre-tokens, and how many pieces each has."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        several = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        several = [piece for piece in several if len(piece) > 1]
        probe = "  ﬁ A①\tÉ́\n x  "
        if any(SPACE in piece.lstrip(SPACE) for piece in several) or m.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("pre-tokens need a model that leaves texts as they are and has no piece with a space after other characters")
        joining = "".join(sorted({c for piece in several for c in piece} - {SPACE}))
        alone = f"[^{re.escape(joining)}{SPACE}]"
        self.split = re.compile(f"{SPACE}*[{re.escape(joining)}]+|{SPACE}+|{alone}").findall
        self.guard = next(c for c in "\n\t0\x01" if c not in joining)  # stands before what has no space of its own
        self.guarded = len(m.encode(self.guard))

    def pre_tokens(self, text: str | None) -> Counter:
        """Pre-tokens of a whole text with their frequencies; the model puts a space before the text."""
        return Counter(self.split(SPACE + text.replace(" ", SPACE))) if text else Counter()

    def counts(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token. The model adds a space of its own, which stands for the first one, or before the guard."""
        spaced = [x.startswith(SPACE) for x in pre_tokens]
        # a lone space can't be written by leaving it out: it too comes before the guard
        asked = [x[1:] if own and len(x) > 1 else self.guard if own else self.guard + x for x, own in zip(pre_tokens, spaced, strict=True)]
        made = map(len, self.model.encode(asked, num_threads=1))
        rest = self.guarded - 1  # pieces of the guard alone
        return [n if own and len(x) > 1 else n - rest if own else n - self.guarded for n, x, own in zip(made, pre_tokens, spaced, strict=True)]


@functools.lru_cache(maxsize=1)
def pieces_of(model_path: str) -> Pieces:
    """One model for all tasks of a Python worker."""
    return Pieces(model_path)


def vocabulary(documents: DataFrame, model_path: str) -> DataFrame:
    """word, rows: each pre-token of the table, and how many texts hold it."""

    def run(batches):
        split, found = pieces_of(model_path).pre_tokens, Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    found.update(split(text).keys())
                    if len(found) > HELD:
                        yield rows()
                        found.clear()
        yield rows()

    part = documents.select("text").mapInArrow(run, "word string, rows long")
    return part.groupBy("word").agg(F.sum("rows").alias("rows"))


def key() -> F.Column:
    """Eight bytes that stand for a word in the shuffle."""
    return F.xxhash64("word").alias("key")


def token_counts(documents: DataFrame, model_path: str, frequent: int = FREQUENT) -> DataFrame:
    """``documents`` without their text, with n_bytes (UTF-8) and n_tokens (longs) of the whole text. A null or empty text has no tokens; nulls
    elsewhere, ties and repeated rows or ids stay as they are, row by row; an empty table gives no rows. Texts of any length count whole.
    Columns called n_bytes or n_tokens are replaced, others pass through, whatever their names."""
    pieces_of(model_path)  # a model of another kind fails here

    def count():
        pieces = pieces_of(model_path)
        return lambda words: {"pieces": pieces.counts(words)}

    known = stored(add_columns(vocabulary(documents, model_path), ["word"], [("pieces", "long")], count))
    rows = known.agg(F.sum("rows")).head()[0] or 0
    # different words of one key, if their pieces differ: some n ** 2 / 2 ** 65 of n words, so they go with the frequent ones, by the word itself
    clash = known.groupBy(key()).agg(F.min("pieces").alias("a"), F.max("pieces").alias("b")).filter("a <> b").select("key")
    often = (F.col("rows") > rows // frequent) & (F.length("word") < KEY)
    clashing = known.withColumn("key", key()).join(F.broadcast(clash), "key", "left_semi")
    held = {x["word"]: x["pieces"] for x in known.filter(often).select("word", "pieces").unionByName(clashing.select("word", "pieces")).collect()}

    def look_up():
        split = pieces_of(model_path).pre_tokens

        def f(texts):
            out: dict[str, list] = {"common": [], "words": [], "times": []}
            for text in texts:
                common, words, times = 0, [], []
                for word, n in split(text).items():
                    if (made := held.get(word)) is not None:
                        common += n * made
                    else:
                        words.append(word)
                        times.append(n)
                for name, x in zip(out, (common, words, times), strict=True):
                    out[name].append(x)
            return out

        return f

    rest = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("text", "n_bytes", "n_tokens"))).alias("row")
    texts = documents.select(rest, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = add_columns(texts, ["text"], [("common", "long"), ("words", "array<string>"), ("times", "array<int>")], look_up).drop("text")
    counted = stored(found.withColumn("id", F.monotonically_increasing_id()))
    pairs = counted.select("id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    seldom = known.filter(~often).groupBy(key()).agg(F.min("pieces").alias("pieces"))  # one row a key; those that clash are looked up by word
    sums = pairs.select("id", key(), "times").join(seldom.hint("merge"), "key").groupBy("id").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    whole = counted.select("id", "row", "n_bytes", "common").join(sums.hint("merge"), "id", "left")
    return whole.select("row.*", "n_bytes", (F.col("common") + F.coalesce("others", F.lit(0))).alias("n_tokens"))
