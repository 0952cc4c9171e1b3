"""Which terms set a source apart from its language, and how far apart are two sources?

Terms are ranked by cells: in one group, all terms of equal count there and equal count in the language have the same shares and so the
same value. Each cell is evaluated once; cells of equal value are merged; in order of value, their multiplicities add up to the ranks
before them; only cells that begin within the ranks asked for are expanded into terms, in UTF-8 order. Sources are compared alike: in a
block of terms, those of equal counts in all sources are one cell, and the terms that no source of the block's has are one cell more.
All numbers are whole: shares are billionths, computed in decimals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, stored

#: Bytes of text that a task counts at once (or one text, if longer).
HELD = 4 << 20
#: Terms and sources of a block in which sources are compared: a task holds the shares of one block.
TERMS, SOURCES = 512, 64
#: Lower case for A-Z alone; what belongs to no term becomes a space. Bytes over 127 are parts of characters beyond ASCII, which all belong to terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``keys`` in order, and how often each is there."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.concatenate((at, [len(keys)])))


def counted_terms(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
    """lang, source, term, n, docs of some whole texts, and an empty term for each of their groups. The folded texts stand in one buffer; a
    term gets a number by hashing, so that counting is sorting of whole numbers."""
    folded = [x.translate(FOLDED) for x in texts]
    buffer = np.frombuffer(b" ".join([*folded, b""]), np.uint8)
    space = buffer == 32
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(buffer) else np.zeros(0, np.int64)
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[~space].tobytes())]).dictionary_encode()
    code, known = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in folded]), starts, "right")
    place = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group_of = np.array([place[g] for g in groups], np.int64)
    key, n = runs(group_of[doc] * known + code)
    once, _ = runs(doc * known + code)
    docs = runs(group_of[once // known] * known + once % known)[1]
    of = np.concatenate((np.arange(len(place)), key // known))
    lang, source = (pa.DictionaryArray.from_arrays(of, pa.array([g[i] for g in place], pa.string())).cast(pa.string()) for i in (0, 1))
    term = pa.concat_arrays([pa.array([""] * len(place), pa.string()), words.dictionary.take(pa.array(key % known)).cast(pa.string())])
    counts = [pa.array(np.concatenate((np.zeros(len(place), np.int64), x))) for x in (n, docs)]
    return pa.RecordBatch.from_arrays([lang, source, term, *counts], names=["lang", "source", "term", "n", "docs"])


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) by group; a row with an empty term for each group, so that groups
    without terms are there too. Null text, lang and source count as empty."""

    def run(batches):
        groups: list[tuple[str, str]] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    groups.append((lang, source))
                    texts.append(text)
                    held += len(text) + 1
                    if held > HELD:
                        yield counted_terms(groups, texts)
                        groups, texts, held = [], [], 0
        if groups:
            yield counted_terms(groups, texts)

    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = documents.select(*group, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, of: str, kept: str, scale: int) -> F.Column:
    """1 + floor(scale * (count + 2) / (of + 2 * kept)), exactly; null where no term is kept."""
    return F.expr(f"1L + (CAST({count} + 2 AS DECIMAL(20, 0)) * {scale}BD) div nullif(CAST({of} + 2 * {kept} AS DECIMAL(20, 0)), 0)")


def value(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def compare(key, shares: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of values over a block's terms for each pair of its sources. ``shares``: term, place (of the source), p; ``groups``: place, tile and
    none (the share of a term that the source lacks)."""
    lang, _, a, b = (x.as_py() for x in key)
    out: dict[str, list] = {"x": [], "y": [], "value": [], "terms": []}
    if shares.num_rows and groups.num_rows > 1:
        groups = groups.sort_by("place")
        places, tiles, none = (groups.column(c).to_numpy() for c in ("place", "tile", "none"))
        term = shares.column("term").combine_chunks().dictionary_encode()
        table = np.tile(none, (len(term.dictionary), 1))
        table[term.indices.to_numpy(), np.searchsorted(places, shares.column("place").to_numpy())] = shares.column("p").to_numpy()
        cells, times = np.unique(table, axis=0, return_counts=True)
        for i in np.flatnonzero(tiles == a).tolist():
            others = np.flatnonzero((tiles == b) & (places > places[i]))
            p, q = cells[:, [i]], cells[:, others]
            out["x"] += [int(places[i])] * len(others)
            out["y"] += places[others].tolist()
            out["value"] += (times @ ((p - q) ** 2 // (p + q))).tolist()
            out["terms"] += [len(table)] * len(others)
    made = [pa.array(v, pa.int64()) for v in out.values()]
    return pa.table([pa.array([lang] * len(out["x"]), pa.string()), *made], names=["lang", *out])


def audit(documents: DataFrame, least: int = 10, scale: int = 10**9, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the lang by how far it lies from this one; part ``term``: the ``top`` terms
    that the source uses more than its lang, each by f(p, q) = floor((p - q)^2 / (p + q)) of the smoothed shares. Each lang keeps the terms
    in at least ``least`` of its documents (rows; a repeated row counts again). Null text, lang and source count as empty; a group
    without terms has pairs, but no terms; equal values rank by item in UTF-8 order; an empty table gives no rows; other columns are left
    aside, whatever their names. The pairs of a lang's sources are the result itself, so their number grows with the square of the sources, not of the documents."""
    group = ["lang", "source"]
    counted = stored(term_counts(documents))
    terms = counted.filter(F.col("term") != "")
    vocabulary = stored(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    kept = stored(terms.drop("docs").join(vocabulary.hint("merge"), ["lang", "term"]))
    sums = kept.groupBy(*group).agg(F.sum("n").alias("n_group"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("n_lang"))
    groups = counted.filter(F.col("term") == "").select(*group).join(sums.hint("merge"), group, "left").join(langs.hint("merge"), "lang", "left").fillna(0)
    by_source = Window.partitionBy("lang").orderBy("source")
    stats = groups.withColumn("place", F.row_number().over(by_source).cast("long") - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    stats = stored(stats.withColumn("none", share("0L", "n_group", "kept", scale)).withColumn("tile", F.expr(f"place div {SOURCES}L")))
    return _pairs(kept, stats, scale).unionByName(_terms(kept, stats, scale, top))


def _terms(kept: DataFrame, stats: DataFrame, scale: int, top: int) -> DataFrame:
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "total").agg(F.count(F.lit(1)).alias("many")).join(stats.hint("merge"), group)
    cells = cells.withColumn("p", share("n", "n_group", "kept", scale)).withColumn("q", share("total", "n_lang", "kept", scale)).filter("p > q")
    cells = stored(cells.select(*group, "n", "total", "many", value("p", "q").alias("value")))
    best = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = cells.groupBy(*group, "value").agg(F.sum("many").alias("many")).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top)
    before = F.coalesce(F.sum("many").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).drop("many", "at")
    chosen = cells.drop("many").join(values.hint("merge"), [*group, "value"])
    rows = kept.join(chosen.hint("merge"), [*group, "n", "total"])
    within = F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))
    rows = rows.withColumn("at", within).filter(F.col("at") <= top).withColumn("rank", (F.col("before") + F.col("at")).cast("int")).filter(F.col("rank") <= top)
    return rows.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, stats: DataFrame, scale: int) -> DataFrame:
    compared = stats.filter("kept > 0 AND sources > 1")
    blocks = F.expr(f"(kept + {TERMS - 1}L) div {TERMS}L")
    tiles = F.explode(F.expr(f"sequence(0L, (sources - 1L) div {SOURCES}L)")).alias("other")
    keys = ["lang", "block", "a", "b"]
    a, b = F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")
    shares = kept.join(compared.hint("merge"), ["lang", "source"]).withColumn("p", share("n", "n_group", "kept", scale))
    shares = shares.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", "place", "p", "tile", tiles).select(*keys[:2], a, b, "term", "place", "p")
    of_block = compared.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "place", "tile", "none", "sources").select("*", tiles)
    of_block = of_block.select(*keys[:2], a, b, "place", "tile", "none")
    shares, of_block = (df.toDF(*df.columns) for df in (shares, of_block))  # both come from the groups' table: columns of their own
    part = shares.groupBy(*keys).cogroup(of_block.groupBy(*keys)).applyInArrow(compare, "lang string, x long, y long, value long, terms long")
    sums = stored(part.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")))
    other = stats.select("lang", F.col("source").alias("item"), F.col("place").alias("there"), F.col("none").alias("none_there"))
    pairs = stats.join(other.hint("merge"), "lang").filter("place != there").withColumn("x", F.least("place", "there")).withColumn("y", F.greatest("place", "there"))
    whole = pairs.join(sums.hint("merge"), ["lang", "x", "y"], "left")
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * value("none", "none_there")
    whole = whole.withColumn("value", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).cast("long"))  # no share without kept terms
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))
