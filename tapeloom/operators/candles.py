"""Candles: aggregation, backfill, retention, warm-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candles(tape: DataFrame, width: int) -> DataFrame:
    """symbol, bucket, open, high, low, close, volume, buy_vol, sell_vol, n, is_closed. Buckets without ticks aren't made. A
    symbol's last bucket is in progress. Partial aggregation runs before the shuffle, so a hot symbol is no bottleneck."""
    at, q = F.struct("t", "seq"), F.col("qty").cast("double")
    made = tape.groupBy("symbol", F.floor(F.col("t") / F.lit(width)).cast("long").alias("bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(q).alias("volume"), F.sum(F.when(~F.col("is_buyer_maker"), q).otherwise(0.0)).alias("buy_vol"),
        F.sum(F.when(F.col("is_buyer_maker"), q).otherwise(0.0)).alias("sell_vol"), F.count("*").alias("n"),
    )
    return made.withColumn("is_closed", F.col("bucket") < F.max("bucket").over(Window.partitionBy("symbol")))


def backfilled(live: DataFrame, history: DataFrame) -> DataFrame:
    """History and live candles as one: of history only closed buckets count, and a live bucket wins over a seeded one."""
    both = live.withColumn("source", F.lit("live")).unionByName(history.filter("is_closed").withColumn("source", F.lit("backfill")))
    first = Window.partitionBy("symbol", "bucket").orderBy(F.when(F.col("source") == "live", 0).otherwise(1))
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, n: int, order: str = "bucket", key: str = "symbol") -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def warm(df: DataFrame, slow: int, atr: int) -> DataFrame:
    """Closed candles with closed_n and warmed_up: enough closed ones for the slowest indicator, and two more."""
    closed = df.filter("is_closed").withColumn("closed_n", F.row_number().over(Window.partitionBy("symbol").orderBy("bucket")).cast("long"))
    return closed.withColumn("warmed_up", F.col("closed_n") >= max(slow, atr) + 2)
