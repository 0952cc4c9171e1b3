"""Fill-in-middle with a learned rank index: where does the k-th line of a text end?

All boundary offsets of a text (0, then the end of each line) are a rising function of their rank. It is fitted by straight segments, each
as long as one slope keeps every offset within ERROR characters; what a segment predicts wrongly is stored as a residual, one byte
each. A cut is found by its rank: the segment that holds the rank predicts, the residual corrects, so every cut is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Characters by which a segment may be wrong; offsets that are fitted at once at first.
ERROR, STRETCH = 120, 64
#: What marks prefix, suffix and middle; a text that holds one of them stays plain.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def boundaries(text: str) -> np.ndarray:
    """0 and the end of each line, in code points; the last line may lack its line feed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    last = [] if not len(codes) or codes[-1] == 10 else [len(codes)]
    return np.concatenate(([0], ends, last)).astype(np.int64)


class RankIndex:
    """Segments (first rank, offset there, slope) and residuals of rising offsets."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residuals: np.ndarray):
        self.first, self.base, self.slope, self.residuals = first, base, slope, residuals

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """The longest segment from each start: the slopes that keep each later offset within ``error`` are an interval; it narrows until it is empty."""
        first, base, slope, at, n = [], [], [], 0, len(offsets)
        while at < n:
            low, high, upto, stretch = -np.inf, np.inf, at + 1, STRETCH
            while upto < n:
                run = np.arange(upto, min(n, upto + stretch)) - at
                rise = offsets[upto : upto + len(run)] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                fits = int(np.argmax(lows > highs)) if (lows > highs).any() else len(run)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                upto += fits
                if fits < len(run):
                    break
                stretch *= 2
            first.append(at)
            base.append(int(offsets[at]))
            slope.append((low + high) / 2 if upto > at + 1 else 0.0)
            at = upto
        made = cls(np.array(first, np.int64), np.array(base, np.int64), np.array(slope, np.float64), np.zeros(n, np.int64))
        residuals = offsets - made.predict(np.arange(n))
        made.residuals = residuals.astype(np.int8 if n == 0 or np.abs(residuals).max() < 128 else np.int64)
        return made

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def offset(self, ranks) -> np.ndarray:
        """Offsets of the ranks, exactly: predicted, then corrected."""
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def line_index(documents: DataFrame, error: int = ERROR) -> DataFrame:
    """``documents`` with n_lines (long), segments (arrays first, base and slope) and residuals (array of ints) of their texts' boundaries, for
    cuts by rank without the text. A null text counts as empty: no line, one boundary."""

    def make():
        def f(texts):
            made = [RankIndex.fit(boundaries(t or ""), error) for t in texts]
            return {
                "n_lines": [len(x.residuals) - 1 for x in made], "first": [x.first.tolist() for x in made], "base": [x.base.tolist() for x in made],
                "slope": [x.slope.tolist() for x in made], "residuals": [x.residuals.tolist() for x in made],
            }

        return f

    return add_columns(documents, ["text"], [("n_lines", "long"), ("first", "array<long>"), ("base", "array<long>"), ("slope", "array<double>"), ("residuals", "array<int>")], make)


def drawn(doc_id: F.Column, seed: int) -> list[F.Column]:
    """Four numbers: the first 8-digit groups of the hex sha256 of ``seed:doc_id``. A null id counts as nothing after the colon."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, error: int = ERROR) -> DataFrame:
    """``documents`` with n_lines (long), form (plain, psm or spm), prefix_chars, middle_chars (longs, null if plain) and output (string).
    Texts are cut at two lines drawn by their id, ``rate`` % of them; of these, ``spm`` % have the suffix first. An empty or null text,
    and one that holds a mark, stays plain (its output is the text, empty if null). Null ids draw as an empty id; repeated ids draw alike, each row on its own; equal
    draws give an empty middle; texts of any length are cut whole; an empty table stays empty. Columns of the names added are replaced, others pass through."""
    draws = [c.alias(f"_h{i}") for i, c in enumerate(drawn(F.col("doc_id"), seed))]
    kept = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select(kept, F.coalesce("text", F.lit("")).alias("_text"), *draws)

    def make():
        def f(texts, h1, h2, h3, h4):
            out: dict[str, list] = {"n_lines": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for text, a, b, c, d in zip(texts, h1, h2, h3, h4, strict=True):
                index = RankIndex.fit(boundaries(text), error)
                n, plain = len(index.residuals) - 1, not text or any(m in text for m in MARKS.values()) or c % 100 >= rate
                form, start, end, made = "plain", None, None, text
                if not plain:
                    start, end = index.offset(sorted((a % (n + 1), b % (n + 1)))).tolist()
                    part = {"prefix": text[:start], "middle": text[start:end], "suffix": text[end:]}
                    form = "spm" if d % 100 < spm else "psm"
                    made = "".join(MARKS[x] + part[x] for x in (("suffix", "prefix", "middle") if form == "spm" else ("prefix", "suffix", "middle")))
                for name, value in zip(out, (n, form, start, end - start if end is not None else None, made), strict=True):
                    out[name].append(value)
            return out

        return f

    added = [("n_lines", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]
    made = add_columns(rows, ["_text", "_h0", "_h1", "_h2", "_h3"], added, make)
    new = [n for n, _ in added]
    return made.select(*(F.col("row").getField(c).alias(c) for c in documents.columns if c.lower() not in new), *new)


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that ``output`` was made of. Marks stand in no text, so the parts between them are the pieces as they were."""
    part = F.split(output, "|".join(MARKS.values()))
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
