"""Forward labels and confirmation streaks over ticks, by row number within chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def over_rows(df: DataFrame, size: int, make, back: int = 0, ahead: int = 0) -> DataFrame:
    """``make(rows, window)`` over chunks of ``size`` row numbers (idx) with halos of rows."""
    return scan.over_chunks(df, size, make, back, ahead, by="idx")


def forward(df: DataFrame, horizon: int, size: int = 4096) -> DataFrame:
    """fwd_ret, the return ``horizon`` ticks ahead; null where there is no such tick. ``df`` has idx."""
    return over_rows(df, size, lambda rows, w: rows.withColumn("fwd_ret", F.lead("price", horizon).over(w) / F.col("price") - 1), ahead=horizon)


def tick_volatility(df: DataFrame, n: int, size: int = 4096) -> DataFrame:
    """tick_vol, sample deviation of the last ``n`` tick returns; null with fewer than two."""

    def make(rows, w):
        rows = rows.withColumn("_r", F.col("price") / F.lag("price").over(w) - 1)
        return rows.withColumn("tick_vol", F.stddev_samp("_r").over(w.rowsBetween(-(n - 1), 0))).drop("_r")

    return over_rows(df, size, make, back=n + 1)


def outcome(df: DataFrame, take_profit: float) -> DataFrame:
    """tp_hit whichever way the move goes; noise where it stays inside one tick volatility (our band). Null without a future."""
    move = F.abs("fwd_ret")
    return df.withColumn("tp_hit", F.when(F.col("fwd_ret").isNotNull(), (move >= take_profit).cast("int"))).withColumn(
        "noise", F.when(F.col("fwd_ret").isNotNull() & F.col("tick_vol").isNotNull(), (move <= F.col("tick_vol")).cast("int"))
    )


def streak(df: DataFrame, holds: F.Column, n: int, size: int = 4096) -> DataFrame:
    """Whether the condition held on this tick and the ``n`` - 1 before it."""
    rows = df.withColumn("_h", F.coalesce(holds, F.lit(False)).cast("int"))
    return over_rows(rows, size, lambda r, w: r.withColumn("confirmed", F.sum("_h").over(w.rowsBetween(-(n - 1), 0)) == n).drop("_h"), back=n)


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key, by (t, seq): a partial minimum before the shuffle, so a hot key is one row."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("t", "seq")).alias("_r")).select(key, "_r.*")


def decimate(df: DataFrame, interval: int, key: str = "symbol", start: DataFrame | None = None, chunk: int = 3_600_000_000) -> DataFrame:
    """Ticks on which a decision runs: the first, and then each that comes ``interval`` or more after the last that ran (before them: ``last``
    of ``start``, by key). From any tick, the next one that would run is known by its time alone, so a chunk of time maps each tick of its first
    ``interval``, where the first run must lie, to its last run. These few are folded over the chunks; then chunks mark their ticks in
    parallel. No pause in the tape is needed."""
    if interval <= 0:
        return df
    width, columns = max(chunk, 4 * interval), df.columns

    def summary(pdf):
        import numpy as np
        import pandas as pd

        t = np.unique(pdf["t"].to_numpy())
        after = np.searchsorted(t, t + interval)
        last = np.where(after < len(t), after, np.arange(len(t)))
        for _ in range(len(t).bit_length()):
            last = last[last]  # twice as many runs ahead
        first = int(np.searchsorted(t, int(pdf["_chunk"].iloc[0]) * width + interval)) + 1
        return pd.DataFrame({key: pdf[key].iloc[0], "_chunk": pdf["_chunk"].iloc[0], "run": t[:first], "final": t[last[:first]]})

    def fold(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["_chunk", "run"])
        last = None if "last" not in pdf or pd.isna(pdf["last"].iloc[0]) else int(pdf["last"].iloc[0])
        out = []
        for part, rows in pdf.groupby("_chunk", sort=True):
            out.append((pdf[key].iloc[0], part, last))
            at = 0 if last is None else int(np.searchsorted(rows["run"].to_numpy(), last + interval))
            last = int(rows["final"].iloc[at]) if at < len(rows) else last
        return pd.DataFrame(out, columns=[key, "_chunk", "last"]).astype({"last": "Int64"})

    def mark(pdf):
        import numpy as np

        pdf = pdf.sort_values(["t", "seq"])
        t, last, kept = pdf["t"].to_numpy(), pdf["last"].iloc[0], []
        at = 0 if last is None or last != last else int(np.searchsorted(t, int(last) + interval))
        while at < len(t):
            kept.append(at)
            at = int(np.searchsorted(t, t[at] + interval))
        return pdf.iloc[kept][columns]

    part = F.floor(F.col("t") / F.lit(width)).cast("long")
    if start is not None:  # what is too near the last decision before can't run; the chunk that this lies in starts after it
        df = df.join(start.select(key, F.col("last").alias("_last")).hint("merge"), key, "left").filter(F.col("_last").isNull() | (F.col("t") - F.col("_last") >= interval)).select(*columns)
    return scan.carried(df, part, summary, "run long, final long", fold, "last long", mark, df.schema, key, start)
