"""Adapter views: the given tables as a market tape, order books, fills and trades.

``t`` is the event time in microseconds since 1970 (UTC whatever the session's time zone is); order is always (t, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def tape(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """symbol, t, seq, price, qty, is_buyer_maker: four symbols, or one for each user (``wide``)."""
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string")) if wide else F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select(
        symbol.alias("symbol"), micros("ts").alias("t"), F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value") / 10).alias("price"),
        (F.lit(1) + F.get_json_object("props", "$.k").cast("int")).alias("qty"),
        F.col("event_type").isin("error", "signup").alias("is_buyer_maker"),
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, frame, t, bids, asks (arrays of px, qty; best first): one frame for each order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), micros("l_shipdate").alias("at"), F.col("l_linestatus").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
    )
    level = F.struct("px", "qty")
    sides = lines.groupBy("frame").agg(
        F.max("at").alias("t"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "O", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "F", level)), asc=True).alias("asks"),
    )
    return sides.select(F.concat(F.lit("S"), (F.col("frame") % 4).cast("string")).alias("symbol"), "frame", "t", "bids", "asks")


TOTAL_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


#: Fills of a task about: their sorts and sums are what it holds in memory.
TASK_ROWS = 400_000


def hot_symbols(spark: SparkSession, sf_dir: str) -> list:
    """Symbols of the fills that are hot, counted by the number of their part."""
    return [f"P{k}" for k in scan.hot_keys(table(spark, sf_dir, "lineitem"), "l_partkey")]


def added(*values: F.Column | str) -> F.Column:
    """The values' sum in their order, nulls left out; null if all are, as ``sum`` has it."""
    total = F.lit(0.0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, t, order_id, side, qty (signed), price, commission, realized: two opening rows and a closing one, over and
    over, for each part; odd parts are short. Prices are in cents, so that sums of money are the same in any order."""
    symbol = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem").withColumn("symbol", symbol)
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))  # the count comes from the files' footers
    lines = lines.repartition(parts, "symbol")  # rows lie by symbol, here and in what follows
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    w = Window.partitionBy("symbol").orderBy(*TOTAL_ORDER)  # the two lines before are a closing row's own opening rows: one sort gives number and sums
    q1, q2, p1, p2 = (F.lag(c, n).over(w) for c in (F.col("l_quantity"), price) for n in (2, 1))
    way = F.when(F.col("l_partkey") % 2 == 1, -1.0).otherwise(1.0)
    closing = F.col("seq") % 3 == 0
    lines = lines.select("*", F.row_number().over(w).cast("long").alias("seq"), price.alias("price"), q1.alias("_q1"), q2.alias("_q2"), p1.alias("_p1"), p2.alias("_p2"))
    qty = F.when(closing, -added("_q1", "_q2")).otherwise(F.col("l_quantity")) * way
    rows = lines.withColumn("qty", qty)
    cash = added(-(F.col("_q1") * way) * F.col("_p1"), -(F.col("_q2") * way) * F.col("_p2"), -F.col("qty") * F.col("price"))
    return rows.select(
        "symbol", "seq", micros("l_shipdate").alias("t"), F.col("l_orderkey").alias("order_id"),
        F.when(F.col("qty") > 0, "BUY").otherwise("SELL").alias("side"), "qty", "price",
        (F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5) / 10_000).alias("commission"),
        F.when(closing, cash).otherwise(F.lit(0.0)).alias("realized"),
    )


#: The same views for the SQL twins.
SQL = {
    "tape": """tape AS (SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, epoch_us(ts) AS t, event_id AS seq, 100.0 + value / 10 AS price,
  1 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS qty, event_type IN ('error', 'signup') AS is_buyer_maker FROM events)""",
    "depth": """depth AS (SELECT 'S' || CAST(l_orderkey % 4 AS VARCHAR) AS symbol, l_orderkey AS frame, max(epoch_us(l_shipdate)) AS t,
  list({'px': l_extendedprice / l_quantity, 'qty': l_quantity} ORDER BY l_extendedprice / l_quantity DESC, l_quantity DESC) FILTER (l_linestatus = 'O') AS bids,
  list({'px': l_extendedprice / l_quantity, 'qty': l_quantity} ORDER BY l_extendedprice / l_quantity, l_quantity) FILTER (l_linestatus = 'F') AS asks
  FROM lineitem GROUP BY l_orderkey)""",
    "fills": """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax) AS rn FROM lineitem), signed AS (SELECT *, CASE WHEN l_partkey % 2 = 1 THEN -1.0 ELSE 1.0 END *
  CASE WHEN rn % 3 = 0 THEN -sum(l_quantity) OVER (PARTITION BY l_partkey, (rn - 1) // 3 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ELSE l_quantity END AS q FROM numbered), fills AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, rn AS seq, epoch_us(l_shipdate) AS t,
  l_orderkey AS order_id, CASE WHEN q > 0 THEN 'BUY' ELSE 'SELL' END AS side, q AS qty, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
  floor(l_extendedprice * l_tax * 100 + 0.5) / 10000 AS commission, CASE WHEN rn % 3 = 0 THEN sum(-q * floor(l_extendedprice / l_quantity * 100 + 0.5) / 100)
  OVER (PARTITION BY l_partkey, (rn - 1) // 3 ORDER BY rn) ELSE 0.0 END AS realized FROM signed)""",
}
SQL["trades"] = SQL["fills"] + """, lives AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY seq) AS life FROM (SELECT *, CASE WHEN abs(sum(qty)
  OVER (PARTITION BY symbol ORDER BY seq) - qty) < 1e-9 THEN 1 ELSE 0 END AS starts FROM fills)), trades AS (SELECT symbol, CAST(life AS BIGINT) AS life,
  CASE WHEN arg_min(qty, seq) > 0 THEN 'LONG' ELSE 'SHORT' END AS side, min(t) AS open_t, max(t) AS close_t, sum(realized) AS gross, sum(commission) AS fees,
  sum(realized) - sum(commission) AS net, count(*) AS n_fills, sum(CASE WHEN qty * sign(arg_min_q) > 0 THEN abs(qty) ELSE 0 END) AS size,
  sum(CASE WHEN qty * sign(arg_min_q) > 0 THEN abs(qty) * price ELSE 0 END) AS notional,
  count(DISTINCT CASE WHEN qty * sign(arg_min_q) > 0 THEN order_id END) - 1 AS dca_count, abs(arg_min(qty, seq)) AS first_qty, arg_min(price, seq) AS first_price
  FROM (SELECT *, first_value(qty) OVER (PARTITION BY symbol, life ORDER BY seq) AS arg_min_q FROM lives) GROUP BY symbol, life HAVING abs(sum(qty)) < 1e-9)"""  # fmt: skip


def sql(*views: str, body: str) -> str:
    """A twin's SQL over adapter views."""
    return "WITH " + ", ".join(SQL[v] for v in views) + " " + body
