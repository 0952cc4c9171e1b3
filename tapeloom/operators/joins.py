"""Joins over time and ids: as-of, interval, overlap of id lists, cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def as_of_many(left: DataFrame, sides: dict[str, tuple[DataFrame, list[str], int]], key: str = "symbol", chunk: int = 0) -> DataFrame:
    """``left`` (symbol, t, seq, ...) with the latest row of each side (name: rows, values, staleness limit) at or before it: its values
    and ``age_<name>``; nulls if that is older than the side's limit. All sides are unioned and carried forward in one pass, within chunks whose
    halo is the largest limit: nothing older could be used. At equal times the sides' rows come first."""
    kinds = {n: right.select(F.struct(F.col("t").alias("at"), *values).alias("v")).schema["v"].dataType for n, (right, values, _) in sides.items()}
    none = {n: F.lit(None).cast(kind).alias(f"_{n}") for n, kind in kinds.items()}
    both = left.select("*", F.lit(1).alias("_side"), *none.values())
    for n, (right, values, _) in sides.items():
        own = F.struct(F.col("t").alias("at"), *values).cast(kinds[n]).alias(f"_{n}")
        both = both.unionByName(right.select(key, "t", F.lit(0).alias("_side"), *(own if m == n else none[m] for m in sides)), allowMissingColumns=True)
    back = max(stale for _, _, stale in sides.values())
    cut = scan.chunked(both, max(chunk, 4 * back, 1), back=back)
    cut = cut.filter(~F.col("halo") | (F.col("_side") == 0))
    w = Window.partitionBy(key, "chunk").orderBy("t", "_side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    for n in sides:
        cut = cut.withColumn(f"_{n}", F.last(f"_{n}", ignorenulls=True).over(w))
    found, made = cut.filter((F.col("_side") == 1) & ~F.col("halo")), []
    for n, (_, values, stale) in sides.items():
        age = F.col("t") - F.col(f"_{n}.at")
        made += [F.when(age <= stale, F.col(f"_{n}.{v}")).alias(v) for v in values] + [F.when(age <= stale, age).alias(f"age_{n}")]
    return found.select(*left.columns, *made)


def as_of(left: DataFrame, right: DataFrame, values: list[str], stale: int, key: str = "symbol", chunk: int = 0) -> DataFrame:
    """J6 with one side: its values and ``age``."""
    return as_of_many(left, {"right": (right, values, stale)}, key, chunk).withColumnRenamed("age_right", "age")


def interval(spans: DataFrame, points: DataFrame, width: int, start: str = "open_t", end: str = "close_t", key: str = "symbol") -> DataFrame:
    """Pairs of spans and the points within them (ends included). Spans are exploded into buckets of ``width`` (about a typical
    span), joined by key and bucket, and then held against the times themselves."""
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width)))))
    marked = points.withColumn("_bucket", F.floor(F.col("t") / F.lit(width)))
    return cut.join(marked.hint("merge"), [key, "_bucket"]).filter(F.col("t").between(F.col(start), F.col(end))).drop("_bucket")


def without_logged(lives: DataFrame, logged: DataFrame, ids: str = "order_ids", id_: str = "order_id") -> DataFrame:
    """Lifecycles none of whose order ids was logged; one shared id drops the whole lifecycle."""
    known = logged.select(id_).distinct()
    seen = lives.select("symbol", "life", F.explode(ids).alias(id_)).join(known.hint("merge"), id_, "left_semi").select("symbol", "life").distinct()
    return lives.join(seen.hint("merge"), ["symbol", "life"], "left_anti")


def latest_event_age(rows: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """``rows`` with since: time since the latest event of its symbol, null beyond ``horizon``."""
    return as_of(rows, events.select("symbol", "t", F.lit(1).alias("_one")), ["_one"], horizon).drop("_one").withColumnRenamed("age", "since")


def phase(since: Column, cool_off: int) -> Column:
    """COOL_OFF after a loss, then as long TIGHT, else NORMAL."""
    return F.when(since < cool_off, "COOL_OFF").when(since < 2 * cool_off, "TIGHT").otherwise("NORMAL")
