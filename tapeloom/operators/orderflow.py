"""Order flow: side volumes, imbalance, traded volume, windows of time, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import signed_qty
from . import scan


def side_volume(levels: Column, n: int) -> Column:
    """A3: quantity over the first ``n`` levels; a malformed level uses its place and counts nothing."""
    return F.aggregate(F.slice(F.coalesce(levels, F.array().cast("array<struct<px:double,qty:double>>")), 1, n), F.lit(0.0), lambda a, e: a + F.coalesce(e["qty"], F.lit(0.0)))


def imbalance(depth: DataFrame, n: int) -> DataFrame:
    """A4: frames with imbalance in [-1, 1]. Frames without volume go, before anything looks at their time."""
    b, a = side_volume(F.col("bids"), n), side_volume(F.col("asks"), n)
    rows = depth.withColumn("bid_volume", b).withColumn("ask_volume", a).filter("bid_volume + ask_volume > 0")
    share = (F.col("bid_volume") - F.col("ask_volume")) / (F.col("bid_volume") + F.col("ask_volume"))
    return rows.withColumn("imbalance", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))


def traded_volume(tape: DataFrame, width: int) -> DataFrame:
    """A5: buy, sell and delta by symbol and window of time."""
    q = F.col("qty").cast("double")
    made = tape.groupBy("symbol", F.floor(F.col("t") / F.lit(width)).cast("long").alias("slot")).agg(
        F.sum(F.when(~F.col("is_buyer_maker"), q).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("is_buyer_maker"), q).otherwise(0.0)).alias("sell")
    )
    return made.withColumn("delta", F.col("buy") - F.col("sell"))


def windowed(rows: DataFrame, values: dict[str, Column], window: int) -> DataFrame:
    """``rows`` (symbol, t, ...) with sums of ``values`` (nulls count nothing; null where there is none) over the last ``window`` microseconds, both ends included; rows of the
    same time count together. In blocks as long as the window, it is the end of one block and the beginning of the next: each row comes again a window later, and running
    sums from both sides meet. No frame is summed anew for each row, and nothing is subtracted."""
    step = max(window, 0) + 1
    again = F.col("_again").cast("int")
    both = rows.select("*", *(v.alias(f"_of_{n}") for n, v in values.items()), F.explode(F.array(F.lit(False), F.lit(True))).alias("_again"))
    both = both.withColumn("_block", F.floor(F.col("t") / F.lit(step)).cast("long") + again).withColumn("_at", F.col("t") + again * F.lit(window))
    in_block = Window.partitionBy("symbol", "_block")
    so_far = in_block.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    from_here = in_block.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.select("*", *(F.sum(F.when(~F.col("_again"), F.col(f"_of_{n}"))).over(so_far).alias(f"_own_{n}") for n in values))
    both = both.select("*", *(F.sum(F.when(F.col("_again"), F.col(f"_of_{n}"))).over(from_here).alias(f"_old_{n}") for n in values))
    total = lambda n: F.coalesce(F.col(f"_own_{n}") + F.col(f"_old_{n}"), F.col(f"_own_{n}"), F.col(f"_old_{n}"))
    made = both.filter(~F.col("_again"))
    for n in values:
        made = made.withColumn(n, total(n))
    return made.drop("_again", "_at", "_block", *(f"_{k}_{n}" for k in ("of", "own", "old") for n in values))


def rolling_delta(tape: DataFrame, window: int) -> DataFrame:
    """Signed quantity of the last ``window`` microseconds, both ends included; rows of the same time count together."""
    return windowed(tape, {"delta": signed_qty(F.col("qty"), F.col("is_buyer_maker")).cast("double")}, window)


def mean_over(rows: DataFrame, value: str, out: str, window: int) -> DataFrame:
    """``rows`` with the mean of ``value`` over the last ``window`` microseconds; null where there is none."""
    rows = windowed(rows, {"_sum": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1)}, window)
    return rows.withColumn(out, F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def average_imbalance(frames: DataFrame, window: int) -> DataFrame:
    """Mean imbalance of the last ``window`` microseconds."""
    return mean_over(frames, "imbalance", "avg_imbalance", window)


def imbalance_at(ticks: DataFrame, frames: DataFrame, window: int, stale: int, chunk: int) -> DataFrame:
    """``ticks`` with the mean imbalance of the frames of the last ``window`` microseconds (both ends included); where there is none, the latest
    frame's (of one time: that of the highest seq, if they have one), if it isn't over ``stale`` old, else 0. Frames of a tick's own time count."""
    none = F.lit(None).cast("double")
    at = F.struct("t", "imbalance").alias("_latest")
    same = frames.groupBy("symbol", "t").agg((F.max_by("imbalance", "seq") if "seq" in frames.columns else F.max("imbalance")).alias("imbalance"), F.sum("imbalance").alias("_all"), F.count("imbalance").alias("_frames"))
    both = ticks.select("*", F.lit(1).alias("_side"), none.alias("_all"), F.lit(None).cast("long").alias("_frames"), F.lit(None).cast("struct<t:bigint,imbalance:double>").alias("_latest"))
    both = both.unionByName(same.select("symbol", "t", F.lit(0).alias("_side"), "_all", "_frames", at), allowMissingColumns=True)

    def make(rows, _):
        so_far = Window.partitionBy("symbol", "chunk").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_latest", F.last("_latest", ignorenulls=True).over(so_far))
        return rows.withColumn("_fresh", F.when(F.col("t") - F.col("_latest.t") <= stale, F.col("_latest.imbalance")))

    rows = windowed(both, {"_sum": F.col("_all"), "_n": F.col("_frames")}, window)
    rows = scan.over_chunks(rows, max(chunk, 4 * stale), make, back=stale).filter("_side = 1")
    return rows.select(*ticks.columns, F.coalesce(F.col("_sum") / F.col("_n"), F.col("_fresh"), F.lit(0.0)).alias("avg_imbalance"))
