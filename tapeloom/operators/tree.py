"""Extremes and first hits over spans of a tape, without pairs of spans and ticks.

Ticks of a symbol are cut into chunks of time, each in one group with the spans that begin (or end) in it. Over a chunk's ticks stands a binary hierarchy of
extremes, so a span asks a number of its nodes that grows with the logarithm of the chunk; what lies between its first and its last chunk it asks of the
extremes of whole chunks, which go once to each chunk from which a span reaches them. A span meets at most two chunks, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written

#: Rows (ticks, or ends of spans) of a chunk on average, for the busiest symbol: 2 ** BASE.
BASE = 16


def hierarchy(values, fold, none: float) -> list:
    """Levels of a binary hierarchy: level i holds the fold of each 2 ** i values, padded with ``none``."""
    levels = [np.concatenate([values, np.full((1 << max(len(values) - 1, 0).bit_length()) - len(values), none)])]
    while len(levels[-1]) > 1:
        levels.append(fold(levels[-1][::2], levels[-1][1::2]))
    return levels


def between(values, low, high, fold, none: float):
    """The fold of ``values`` from low up to, but without, high, for each pair (``none``, if there are none): at each level the first node, if it is a right child,
    and the last, if the one after it is."""
    a, b, out = low, high, np.full(len(low), none)
    for level in hierarchy(values, fold, none):
        for at, take in ((a, (a < b) & (a & 1 == 1)), (b - 1, (a < b) & (b & 1 == 1))):
            out[take] = fold(out[take], level[at[take]])
        a, b = (a + 1) >> 1, b >> 1
    return out


def first_below(values, low, high, limit):
    """The first place from low up to, but without, high at which ``values`` are at most ``limit``; -1, if there is none. It climbs the hierarchy to the right until a node's
    least is low enough, then goes down."""
    levels = hierarchy(values, np.fmin, np.inf)
    size = len(levels[0])
    level, node = np.zeros(len(low), dtype=np.int64), low.astype(np.int64)
    found = np.zeros(len(low), dtype=bool)
    todo = np.flatnonzero(low < np.minimum(high, size))
    flat, start = np.concatenate(levels), np.cumsum([0, *(len(x) for x in levels)])
    while len(todo):
        ok = flat[start[level[todo]] + node[todo]] <= limit[todo]
        found[todo[ok]] = True
        todo = todo[~ok]
        right = node[todo] & 1 == 1
        node[todo] += 1
        node[todo[right]] >>= 1
        level[todo[right]] += 1
        todo = todo[node[todo] << level[todo] < np.minimum(high[todo], size)]
    down = np.flatnonzero(found & (level > 0))
    while len(down):
        level[down] -= 1
        node[down] <<= 1
        node[down] += ~(flat[start[level[down]] + node[down]] <= limit[down])
        down = down[level[down] > 0]
    return np.where(found & (node < high), node, -1)


def width_of(ticks: DataFrame, spans: DataFrame, key: str, base: int) -> int:
    """The width of chunks of time that gives the busiest key 2 ** ``base`` rows a chunk on average; ticks of one time are one row."""
    rows = ticks.select(key, "t").unionByName(spans.select(key, F.col("_low").alias("t")))
    made = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).head()
    return 1 if made["a"] is None else max(1, ((made["b"] - made["a"]) << base) // made["n"] + 1)


def _cut(spans: DataFrame, ticks: DataFrame, low: Column, high: Column, key: str, width: int | None, base: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Spans (_low to _high) with their first and last chunk (_a, _b), and those without ends; ticks by chunk (_c; one row for each time: n, least of ``low``, greatest of
    ``high``) with, for each chunk in which spans begin, the chunks after it that these reach (kind 1; t: the chunk's number); and ticks alone."""
    width = width or width_of(ticks, spans, key, base)
    chunk = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    whole = F.col(key).isNotNull() & F.col("_low").isNotNull() & F.col("_high").isNotNull()
    cut = spans.filter(whole).withColumn("_a", chunk("_low")).withColumn("_b", F.greatest(chunk("_high"), chunk("_low")))
    extremes = [F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")]
    known = ticks.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).select(key, "t", low.alias("least"), high.alias("greatest")).filter("least IS NOT NULL")
    times = written(known.groupBy(key, "t").agg(*extremes).withColumn("_c", chunk("t")), "times")
    chunks = times.groupBy(key, "_c").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    reach = cut.filter("_b > _a").groupBy(key, F.col("_a").alias("_from")).agg(F.max("_b").alias("_to"))
    later = reach.join(chunks.hint("merge"), key).filter("_c > _from AND _c <= _to").select(key, F.col("_from").alias("_c"), F.col("_c").alias("t"), "n", "least", "greatest", F.lit(1).alias("kind"))
    ticks = times.select(key, "_c", "t", "n", "least", "greatest", F.lit(0).alias("kind"))
    return cut, spans.filter(~whole), ticks.unionByName(later), ticks


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _with_chunk(key: str, spans: DataFrame, at: str, ticks: DataFrame, make, schema: str) -> DataFrame:
    """``make(spans, ticks)`` over spans by their chunk ``at``, with the ticks of that chunk."""

    def run(asked, rows):
        return make(asked, rows) if len(asked) else pd.DataFrame([], columns=names)

    names = spans.sparkSession.createDataFrame([], schema).columns
    return spans.groupBy(key, at).cogroup(ticks.groupBy(key, "_c")).applyInPandas(run, schema)


def extremes(spans: DataFrame, ticks: DataFrame, value: str = "price", key: str = "symbol", id_: str = "life", start: str = "open_t", end: str = "close_t", width: int | None = None, base: int = BASE) -> DataFrame:
    """Key, id, n (ticks within the span, ends included), least, greatest of ``value`` over them (null, if there are none). Ticks without a value don't count."""
    v = F.col(value).cast("double")
    spans = spans.select(key, id_, F.col(start).alias("_low"), F.col(end).alias("_high"))
    cut, blind, ticks, own = _cut(spans, ticks, v, v, key, width, base)

    def ask(asked, rows, low, high):
        """``asked`` with what ``rows`` from low up to high add. NaN is the greatest of all numbers, as in Spark."""
        high = np.maximum(low, high)
        total = np.concatenate([[0], np.cumsum(rows["n"].to_numpy(np.int64))])
        least = between(rows["least"].to_numpy(float), low, high, np.fmin, np.nan)
        greatest = between(rows["greatest"].to_numpy(float), low, high, np.maximum, -np.inf)
        return asked.assign(n=asked["n"] + total[high] - total[low], least=np.fmin(asked["least"].to_numpy(float), least), greatest=np.maximum(asked["greatest"].to_numpy(float), greatest))

    def first(asked, rows):
        rows = rows.sort_values("t")
        near, far = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        asked = asked.assign(n=0, least=np.nan, greatest=-np.inf)
        asked = ask(asked, near, np.searchsorted(near["t"], asked["_low"]), np.searchsorted(near["t"], asked["_high"], "right"))
        return ask(asked, far, np.searchsorted(far["t"], asked["_a"], "right"), np.searchsorted(far["t"], asked["_b"]))

    def last(asked, rows):
        rows = rows.sort_values("t")
        return ask(asked, rows, np.zeros(len(asked), np.int64), np.searchsorted(rows["t"], asked["_high"], "right"))

    schema = f"{_columns(cut)}, n long, least double, greatest double"
    made = written(_with_chunk(key, cut, "_a", ticks, first, schema), "first")
    made = made.filter("_a = _b").unionByName(_with_chunk(key, made.filter("_a < _b"), "_b", own, last, schema))
    none = F.lit(None).cast("double")
    some = made.select(key, id_, "n", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("least", "greatest")))
    return some.unionByName(blind.select(key, id_, F.lit(0).cast("long").alias("n"), none.alias("least"), none.alias("greatest")))


def excursions(trades: DataFrame, ticks: DataFrame, fee: float = 0.0, **options) -> DataFrame:
    """``trades`` (symbol, life, side, entry_price, size, open_t, close_t) with n, mfe and mae (the best and worst move of the price for the trade's side
    since its entry, within [open_t, close_t]) and peak_pnl (the best net of ``fee``, a share of the notional; at least zero)."""
    trades = written(trades, "trades")
    found = extremes(trades, ticks, **options)
    rows = trades.join(found.hint("merge"), ["symbol", "life"])
    up, down = F.col("greatest") - F.col("entry_price"), F.col("least") - F.col("entry_price")
    long = F.col("side") == "LONG"
    rows = rows.withColumn("mfe", F.when(long, up).otherwise(-down)).withColumn("mae", F.when(long, down).otherwise(-up))
    net = F.col("mfe") * F.col("size") - F.lit(fee) * F.col("entry_price") * F.col("size")
    return rows.withColumn("peak_pnl", F.when(F.col("n") > 0, F.greatest(net, F.lit(0.0)))).drop("least", "greatest")


def liquidation_alerts(trades: DataFrame, ticks: DataFrame, band: float, width: int | None = None, base: int = BASE) -> DataFrame:
    """Symbol, life, t: the first tick within ``band`` (a share of its price) of a position's own liquidation price (column liquidation; null: none), or past it, while the
    position is open. It is sought in the chunk of the opening, and else in the first later chunk whose extremes reach the price."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))  # noqa: E731  # NaN: above all numbers
    spans = trades.filter("liquidation IS NOT NULL").select("symbol", "life", F.coalesce(F.col("side") == "LONG", F.lit(False)).alias("_long"), number("liquidation").alias("_limit"), F.col("open_t").alias("_low"), F.col("close_t").alias("_high"))
    cut, _, ticks, own = _cut(written(spans, "positions"), ticks, number("price") * (1 - band), number("price") * (1 + band), "symbol", width, base)

    def hit(asked, rows, low, high):
        limit, long = asked["_limit"].to_numpy(float), asked["_long"].to_numpy(bool)
        place = np.full(len(asked), -1)
        place[long] = first_below(rows["least"].to_numpy(float), low[long], high[long], limit[long])
        place[~long] = first_below(-rows["greatest"].to_numpy(float), low[~long], high[~long], -limit[~long])
        return np.concatenate([rows["t"].to_numpy(np.int64), [0]])[place], place >= 0

    def first(asked, rows):
        rows = rows.sort_values("t")
        near, far = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        t, here = hit(asked, near, np.searchsorted(near["t"], asked["_low"]), np.searchsorted(near["t"], asked["_high"], "right"))
        next_, there = hit(asked, far, np.searchsorted(far["t"], asked["_a"], "right"), np.searchsorted(far["t"], asked["_b"], "right"))
        return asked.assign(t=t, here=here, _next=next_)[here | there]

    def later(asked, rows):
        rows = rows.sort_values("t")
        t, here = hit(asked, rows, np.zeros(len(asked), np.int64), np.searchsorted(rows["t"], asked["_high"], "right"))
        return asked.assign(t=t)[here]

    schema = f"{_columns(cut)}, t long, here boolean, _next long"
    made = written(_with_chunk("symbol", cut, "_a", ticks, first, schema), "first")
    rest = _with_chunk("symbol", made.filter("NOT here"), "_next", own, later, schema)
    return made.filter("here").unionByName(rest).groupBy("symbol", "life").agg(F.min("t").alias("t"))
