"""Scans over long ordered histories without one task per key.

A symbol may hold a third of all rows, so order-dependent work is cut into chunks: bounded frames see a halo of the rows
before (or after) their chunk; unbounded sums and recursions are computed inside chunks, folded over chunk summaries and
carried back in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(df: DataFrame, width: int, back: int = 0, ahead: int = 0, by: str = "t") -> DataFrame:
    """``df`` with chunk and halo: each row once in its own chunk of ``width`` (halo false) and again in the chunks that look
    back at it by up to ``back``, or ahead by ``ahead``. Frames up to those widths are then exact within (symbol, chunk)."""
    own = F.floor(F.col(by) / F.lit(width)).cast("long")
    first, last = F.floor((F.col(by) - F.lit(ahead)) / F.lit(width)).cast("long"), F.floor((F.col(by) + F.lit(back)) / F.lit(width)).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("halo", F.col("chunk") != own)


def over_chunks(df: DataFrame, width: int, make, back: int = 0, ahead: int = 0, by: str = "t", key: str = "symbol") -> DataFrame:
    """``make(rows, window)`` over chunks with halos; ``window`` is ordered by (t, seq) within a chunk. Halo rows go at the end."""
    rows = chunked(df, width, back, ahead, by)
    return make(rows, Window.partitionBy(key, "chunk").orderBy("t", "seq")).filter(~F.col("halo")).drop("chunk", "halo")


def indexed(df: DataFrame, width: int, key: str = "symbol") -> DataFrame:
    """``df`` with idx, the row's number within its key by (t, seq) from 0: numbers within chunks of time plus what came before."""
    rows = df.withColumn("part", F.floor(F.col("t") / F.lit(width)).cast("long"))
    sizes = rows.groupBy(key, "part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before.drop("count").hint("shuffle_hash"), [key, "part"])
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(key, "part").orderBy("t", "seq")) - 1 + F.col("before")).drop("part", "before")


#: A key is hot if it holds over one in so many rows, and over so many at all.
HOT, MANY = 1_000, 2_000_000


def hot_keys(df: DataFrame, key: str = "symbol", share: int = HOT, many: int = MANY) -> list:
    """Keys whose rows should not meet in one task: at most ``share`` of them, counted by partial sums."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.max("n").alias("most"), F.sum("n").alias("n")).head()
    if (total["most"] or 0) <= many:
        return []
    return [r[0] for r in counts.filter((F.col("n") > many) & (F.col("n") > total["n"] / share) & F.col(key).isNotNull()).select(key).collect()]


def split_hot(df: DataFrame, hot: list, key: str = "symbol") -> tuple[DataFrame, DataFrame | None]:
    """Rows of all other keys, and those of hot ones, if there are any."""
    if not hot:
        return df, None
    often = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.filter(~often), df.filter(often)


def running(df: DataFrame, values: dict[str, Column], width: int, key: str = "symbol", by: str = "t", order: tuple[str, ...] = ("t", "seq"), fold: str = "sum") -> DataFrame:
    """``df`` with running sums (or maxima: ``fold``) by ``order`` within ``key``, the row included: folds inside chunks of ``by``, and the
    fold of earlier chunks carried in."""
    f, plus = (F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + y) if fold == "sum" else (F.max, lambda x, y: F.greatest(x, y))
    rows = df.withColumn("_part", F.floor(F.col(by) / F.lit(width)).cast("long"))
    for name, value in values.items():
        rows = rows.withColumn(f"_of_{name}", value)
    totals = rows.groupBy(key, "_part").agg(*(f(f"_of_{n}").alias(f"_of_{n}") for n in values))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_part", *(f(f"_of_{n}").over(earlier).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried.hint("shuffle_hash"), [key, "_part"])
    for n in values:
        rows = rows.withColumn(n, plus(F.col(f"_before_{n}"), f(f"_of_{n}").over(inside)))
    return rows.drop("_part", *(f"_of_{n}" for n in values), *(f"_before_{n}" for n in values))


def below(df: DataFrame, p: str, sums: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """By distinct ``p`` (0 to 1): sums, and below_<name>, the sums over all smaller ``p``: prefixes inside buckets of ``p``, carried over
    the few buckets."""
    by = df.groupBy(F.col(p).alias("_p")).agg(*(F.sum(c).alias(n) for n, c in sums.items())).withColumn("_b", F.floor(F.col("_p") * buckets))
    totals = by.groupBy("_b").agg(*(F.sum(n).alias(f"_t_{n}") for n in sums))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_b", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums))
    inside = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    rows = by.join(carried.hint("shuffle_hash"), "_b")
    return rows.select("_p", *sums, *((F.col(f"_c_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}") for n in sums))


def affine_scan(df: DataFrame, x: str, out: str, factor: float, seed: Column | None = None, chunk: int = 500, key: str = "symbol", index: str = "idx") -> DataFrame:
    """``out``: y_i = factor * y_{i-1} + (1 - factor) * x_i over ``index`` (0, 1, ... within ``key``); y_0 = x_0, or one step
    from ``seed`` where given. Within a chunk the recursion is a weighted prefix sum; chunk ends are folded in order and
    carried into the next chunk. ``chunk`` rows keep factor ** -n inside the range of doubles. Ends of chunks so long ago that they weigh
    less than 1e-300 are left out: what is folded for a chunk doesn't grow with the history."""
    a = factor
    far = math.ceil(690 / (chunk * -math.log(a))) + 1
    rows = df.withColumn("_part", F.floor(F.col(index) / F.lit(chunk)).cast("long")).withColumn("_k", (F.col(index) % chunk).cast("int"))
    gain = F.when((F.col(index) == 0) & F.lit(seed is None), F.lit(1.0)).otherwise(F.lit(1.0 - a))
    inside = Window.partitionBy(key, "_part").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(gain * F.col(x) * F.pow(F.lit(a), -F.col("_k"))).over(inside)
    rows = rows.withColumn("_own", scaled * F.pow(F.lit(a), F.col("_k")))
    ends = rows.groupBy(key, "_part").agg(F.max_by("_own", "_k").alias("_b"), (F.max("_k") + 1).alias("_n"))
    order = Window.partitionBy(key).orderBy("_part")
    past = F.collect_list(F.struct(F.col("_b").alias("b"), F.col("_n").alias("n"))).over(order.rowsBetween(-far, -1))
    first = F.lit(0.0) if seed is None else F.when(F.col("_part") <= far, seed).otherwise(0.0)
    carry = F.aggregate(past, first.cast("double"), lambda y, e: y * F.pow(F.lit(a), e["n"]) + e["b"])
    rows = rows.join(ends.select(key, "_part", carry.alias("_carry")).hint("shuffle_hash"), [key, "_part"])
    return rows.withColumn(out, F.col("_own") + F.col("_carry") * F.pow(F.lit(a), F.col("_k") + 1)).drop("_part", "_k", "_own", "_carry")


def carried(rows: DataFrame, chunk: Column, summary, summary_schema: str, fold, carry_schema: str, mark, schema, key: str = "symbol", start: DataFrame | None = None) -> DataFrame:
    """A rule whose state goes from row to row, in three steps over chunks of ``key``. ``summary(pdf)``: what a chunk does to each state that
    may come in, in a few rows. ``fold(pdf)``: over a key's summaries in order (with ``start``'s columns, if given), the state that comes into
    each chunk; one task for each key, but of summaries only. ``mark(pdf)``: the chunk's rows (with their state) to result rows."""
    cut = rows.withColumn("_chunk", chunk)
    parts = cut.groupBy(key, "_chunk").applyInPandas(summary, f"{key} string, _chunk long, {summary_schema}")
    if start is not None:
        parts = parts.join(start.hint("merge"), key, "left")
    states = parts.groupBy(key).applyInPandas(fold, f"{key} string, _chunk long, {carry_schema}")
    return cut.join(states.hint("merge"), [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(mark, schema)
