"""Volatility and trend indicators over candles; recursions by affine scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def by_bucket() -> Window:
    return Window.partitionBy("symbol").orderBy("bucket")


def true_range(c: DataFrame) -> DataFrame:
    """tr: null for a symbol's first candle."""
    before = F.lag("close").over(by_bucket())
    tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return c.withColumn("tr", tr)


def atr(c: DataFrame, period: int) -> DataFrame:
    """atr: mean of the last ``period`` true ranges there are; 0 before the second candle. atr_pct: of the close (1 if that is 0)."""
    rows = true_range(c).withColumn("atr", F.coalesce(F.avg("tr").over(by_bucket().rowsBetween(-(period - 1), 0)), F.lit(0.0)))
    return rows.withColumn("atr_pct", F.col("atr") / F.when(F.col("close") == 0, 1.0).otherwise(F.col("close")))


def atr_ratio(c: DataFrame, window: int) -> DataFrame:
    """atr_ratio: atr by its own mean of ``window`` candles (1 where that is 0)."""
    mean = F.avg("atr").over(by_bucket().rowsBetween(-(window - 1), 0))
    return c.withColumn("atr_ratio", F.when(mean == 0, 1.0).otherwise(F.col("atr") / mean))


def numbered(c: DataFrame) -> DataFrame:
    return c.withColumn("idx", F.row_number().over(by_bucket()) - 1)


def ema(c: DataFrame, period: int, x: str = "close", out: str | None = None) -> DataFrame:
    """Exponential mean with k = 2 / (period + 1), seeded with the first value. ``c`` has idx."""
    return scan.affine_scan(c, x, out or f"ema_{period}", 1 - 2 / (period + 1))


def ema_stack(c: DataFrame, fast: int, mid: int, slow: int) -> DataFrame:
    """The three means, the fast one's slope (share per candle), and their order: BULL, BEAR or MIXED."""
    rows = ema(ema(ema(numbered(c), fast), mid), slow)
    f, m, s = (F.col(f"ema_{p}") for p in (fast, mid, slow))
    before = F.lag(f"ema_{fast}").over(by_bucket())
    rows = rows.withColumn("ema_slope", F.when(before != 0, f / before - 1).otherwise(0.0))
    return rows.withColumn("ema_order", F.when((f > m) & (m > s), "BULL").when((f < m) & (m < s), "BEAR").otherwise("MIXED"))


def returns(c: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """ret_n: close by the close n candles ago, less one; null without one."""
    for n in spans:
        c = c.withColumn(f"ret_{n}", F.col("close") / F.lag("close", n).over(by_bucket()) - 1)
    return c


def volume_z(c: DataFrame, window: int) -> DataFrame:
    """volume_z: against the trailing ``window`` candles, the current one left out; 0 without spread."""
    past = by_bucket().rowsBetween(-window, -1)
    spread = F.stddev_samp("volume").over(past)
    return c.withColumn("volume_z", F.when(spread > 0, (F.col("volume") - F.avg("volume").over(past)) / spread).otherwise(0.0))


def rsi(c: DataFrame, period: int = 14) -> DataFrame:
    """rsi: Wilder's, our definition: gains and losses smoothed by 1 / period from the first change on; 50 without changes."""
    rows = numbered(c)
    change = F.coalesce(F.col("close") - F.lag("close").over(by_bucket()), F.lit(0.0))
    rows = rows.withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0)))
    rows = scan.affine_scan(scan.affine_scan(rows, "_up", "_au", 1 - 1 / period), "_down", "_ad", 1 - 1 / period)
    total = F.col("_au") + F.col("_ad")
    return rows.withColumn("rsi", F.when(total > 0, 100 * F.col("_au") / total).otherwise(50.0)).drop("_up", "_down", "_au", "_ad", "idx")


def expanding_z(df: DataFrame, x: str, width: int, learn: bool = True) -> DataFrame:
    """z of ``x`` against all rows so far (the row itself included when learning): sample variance, the raw value below two rows,
    a spread under 1e-8 counts as 1. Moments are carried over chunks of time, about a shift that keeps the sums small."""
    shift = F.lit(100.0)
    v = F.col(x) - shift
    rows = scan.running(df, {"_n": F.lit(1.0), "_s": v, "_q": v * v}, width)
    own = F.lit(0.0 if learn else 1.0)
    n, s, q = F.col("_n") - own, F.col("_s") - own * v, F.col("_q") - own * v * v
    mean = s / n
    spread = F.sqrt(F.greatest((q - s * mean) / (n - 1), F.lit(0.0)))
    z = F.when(n < 2, F.col(x)).otherwise((v - mean) / F.when(spread < 1e-8, 1.0).otherwise(spread))
    return rows.withColumn("z", z).drop("_n", "_s", "_q")


def trend_scale(df: DataFrame, move: str, start: float = 0.0015, keep: float = 0.98) -> DataFrame:
    """trend_scale: s <- keep * s + (1 - keep) * max(abs(move), 1e-6), from ``start``. ``df`` has idx."""
    rows = df.withColumn("_m", F.greatest(F.abs(F.coalesce(F.col(move), F.lit(0.0))), F.lit(1e-6)))
    return scan.affine_scan(rows, "_m", "trend_scale", keep, seed=F.lit(start)).drop("_m")


def regime(atr_ratio: Column, slope: Column) -> Column:
    """HIGH_VOL from 1.6, LOW_VOL up to 0.6, else by slope STRONG_TREND, WEAK_TREND or SIDEWAYS (our order)."""
    s = F.abs(slope)
    return (
        F.when(atr_ratio >= 1.6, "HIGH_VOL").when(atr_ratio <= 0.6, "LOW_VOL").when(s >= 0.0006, "STRONG_TREND")
        .when(s >= 0.0002, "WEAK_TREND").otherwise("SIDEWAYS")
    )
