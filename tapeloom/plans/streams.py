"""Streaming queries, run over what the tables hold; twins are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, ledger, scan, stats
from ..params import FIXTURE as P
from ..sources import adapters
from ..streaming import processors, streams
from .base import query
from .market import DAY, HOUR


#: In append mode a window comes out once the watermark, an hour behind the newest tick, has passed its end.
PASSED = f"(SELECT max(t) FROM tape) - {HOUR}"
#: The greedy rule in SQL: from each time the next that would run, and the chain of these from the first.
RUNS = f"""WITH RECURSIVE times AS (SELECT DISTINCT symbol, t FROM tape), ahead AS (SELECT symbol, t, min(t) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {P.decision_interval_flat} FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM times),
  runs AS (SELECT symbol, min(t) AS t FROM times GROUP BY symbol UNION ALL SELECT runs.symbol, ahead.after FROM runs JOIN ahead ON runs.symbol = ahead.symbol AND runs.t = ahead.t WHERE ahead.after IS NOT NULL)
  SELECT symbol, min(seq) AS seq, t FROM runs JOIN tape USING (symbol, t) GROUP BY symbol, t"""


@query("T3_stream_candles", "symbol start n|open high low close volume", "candles", sql=f"SELECT symbol, bucket * {P.candle} AS start, n, open, high, low, close, volume FROM candles WHERE (bucket + 1) * {P.candle} <= {PASSED}")
def _(spark, d):
    return streams.finished(streams.candles(streams.tape(spark, d), "1 hour"))


@query("T4_stream_sliding", "symbol start|delta", "tape", sql=f"""SELECT symbol, w AS start, sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) AS delta FROM (SELECT *, unnest([t // {2 * HOUR} * {2 * HOUR}, t // {2 * HOUR} * {2 * HOUR} - {2 * HOUR}, t // {2 * HOUR} * {2 * HOUR} - {4 * HOUR}]) AS w FROM tape)
  WHERE w + {6 * HOUR} <= {PASSED} GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return streams.finished(streams.sliding_delta(streams.tape(spark, d), "6 hours", "2 hours"))


SESSIONS = f"""SELECT symbol, min(t) AS start, max(t) + {HOUR} AS end_t, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY t, seq) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY symbol ORDER BY t, seq) > {HOUR} THEN 1 ELSE 0 END AS c FROM tape))
  GROUP BY symbol, g HAVING max(t) + {HOUR} <= {PASSED}"""


@query("T5_stream_sessions", "symbol start end_t n", "tape", sql=SESSIONS)
def _(spark, d):
    return streams.finished(streams.sessions(streams.tape(spark, d), "1 hour")).withColumnRenamed("end", "end_t")


@query("T9_stream_once", "seq", "tape", sql="SELECT seq FROM tape")
def _(spark, d):
    t = streams.tape(spark, d)
    return streams.finished(streams.exactly_once(t.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("twice"), "seq", "60 days"))


@query("T10_stream_restart", "symbol seq|price", "tape", sql="SELECT symbol, seq, price FROM tape")
def _(spark, d):
    return streams.finished(streams.tape(spark, d), runs=2)


@query("T11_stream_day_totals", "symbol day n|volume", "tape", sql=f"SELECT symbol, t // {DAY} AS day, count(*) AS n, sum(qty) AS volume FROM tape GROUP BY 1, 2 HAVING (t // {DAY} + 1) * {DAY} <= {PASSED}")
def _(spark, d):
    return streams.finished(streams.day_totals(streams.tape(spark, d)))


@query("T1_T12_stream_decimated", "symbol seq t", "tape", sql=RUNS)
def _(spark, d):
    return streams.decimated(streams.tape(spark, d), P.decision_interval_flat)


@query("T1_decimated_batch", "symbol seq t", "tape", sql=RUNS)
def _(spark, d):
    return labels.decimate(adapters.tape(spark, d), P.decision_interval_flat)


@query("A16_decimation", "symbol period ticks decisions|skipped_pct", "tape", sql=f"""SELECT symbol, period, ticks, coalesce(decisions, 0) AS decisions, 100 * (1 - coalesce(decisions, 0) / ticks) AS skipped_pct FROM (SELECT symbol, t // {DAY} AS period, count(*) AS ticks FROM tape GROUP BY 1, 2)
  LEFT JOIN (SELECT symbol, t // {DAY} AS period, count(*) AS decisions FROM ({RUNS}) GROUP BY 1, 2) USING (symbol, period)""")  # fmt: skip
def _(spark, d):
    t = adapters.tape(spark, d)
    return stats.decimation(labels.decimate(t, P.decision_interval_flat), t, DAY)


@query("T13_stream_alerts", "symbol t alert", "tape", sql=f"""SELECT symbol, t, 'liquidation' AS alert FROM tape WHERE (price - 100) / price <= 0.0005 UNION ALL SELECT symbol, end_t, 'stale_feed' FROM ({SESSIONS})
  UNION ALL SELECT symbol, t, 'unprotected' FROM tape WHERE qty % 5 = 0 AND NOT (seq % 3 <> 0 AND seq % 10 <= 5) AND t + 300000000 <
  least((SELECT max(t) FROM tape WHERE qty % 5 = 0), (SELECT max(t + seq % 10 * 60000000) FROM tape WHERE qty % 5 = 0 AND seq % 3 <> 0)) - {HOUR}""")  # fmt: skip
def _(spark, d):
    def t():
        return streams.tape(spark, d)

    openings = t().filter("qty % 5 = 0").select("symbol", F.col("seq").alias("life"), "ts")
    stops = t().filter("qty % 5 = 0 AND seq % 3 <> 0").select(F.col("seq").alias("life"), F.expr("ts + make_dt_interval(0, 0, CAST(seq % 10 AS INT), 0)").alias("stop_ts"))
    made = [streams.liquidation_alerts(t(), 100.0, 0.0005), streams.stale_alerts(t(), "1 hour"), streams.unprotected_alerts(openings, stops, "300 seconds")]
    done = [streams.finished(x) for x in made]
    return done[0].unionByName(done[1]).unionByName(done[2])


EVENTS = ("ENTRY_SENT", "ENTRY_FILLED", "ADD_SENT", "ADD_FILLED", "CLOSE_SENT", "CLOSE_FILLED", "ENTRY_CANCELED")
MOVED = "CASE " + " ".join(f"WHEN status = '{a}' AND event = '{e}'{' AND step < 1' if e == 'ADD_SENT' else ''} THEN '{b}'" for (a, e), b in streams.MOVES.items()) + " ELSE status END"


@query("T2_stream_positions", "symbol seq status step", "tape", sql=f"""WITH RECURSIVE ev AS (SELECT symbol, seq, {list(EVENTS)}[qty % {len(EVENTS)} + 1] AS event, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM tape),
  m AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 'FLAT' AS status, 0 AS step FROM ev WHERE n = 1 UNION ALL SELECT symbol, seq, n, status, CASE WHEN status = 'FLAT' THEN 0 WHEN event = 'ADD_FILLED' AND was = 'DCA_PENDING' THEN least(1, step + 1) ELSE step END AS step
  FROM (SELECT ev.symbol, ev.seq, ev.n, m.status AS was, ev.event, m.step, {MOVED.replace("status =", "m.status =").replace("event =", "ev.event =").replace("step <", "m.step <").replace("ELSE status", "ELSE m.status")} AS status FROM m JOIN ev ON ev.symbol = m.symbol AND ev.n = m.n + 1)) SELECT symbol, seq, status, step FROM m WHERE n > 0""")  # fmt: skip
def _(spark, d):
    t = streams.tape(spark, d)
    event = F.element_at(F.array(*(F.lit(n) for n in EVENTS)), (F.col("qty") % len(EVENTS) + 1).cast("int"))
    return streams.position_states(t.select("symbol", "seq", F.unix_micros("ts").alias("t"), event.alias("event")))


@query("T8_stream_matched_fills", "seq matched", "tape", sql=f"SELECT seq, seq % 3 <> 0 AS matched FROM tape WHERE seq % 3 <> 0 OR t + {HOUR} < (SELECT max(t) FROM tape WHERE seq % 3 <> 0) - {HOUR}")
def _(spark, d):
    """Fills that were matched, and those whose time for it was up when the stream ended."""
    t = streams.tape(spark, d)
    fills = t.select(F.col("seq").alias("order_id"), "seq", "ts")
    orders = t.filter("seq % 3 <> 0").select(F.col("seq").alias("order_id"), F.col("ts").alias("order_ts"))
    return streams.finished(streams.matched_fills(fills, orders, "1 hour"))


@query("T6_late_rows", "symbol slot late_rows", "tape", sql=f"""SELECT symbol, t // {DAY} AS slot, count(*) FILTER (t < m - {HOUR}) AS late_rows FROM (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY seq * 7919 % 10007, seq) AS m FROM tape) GROUP BY 1, 2""")
def _(spark, d):
    """Rows that come more than an hour behind the newest seen, when the tape arrives in a shuffled order: what a late sink gets."""
    t = adapters.tape(spark, d).withColumn("arrival", F.col("seq") * 7919 % 10007)
    rows = scan.running(t, {"newest": F.col("t")}, 100, by="arrival", order=("arrival", "seq"), fold="max").withColumn("late", F.col("t") < F.col("newest") - HOUR)
    return rows.groupBy("symbol", F.floor(F.col("t") / DAY).cast("long").alias("slot")).agg(F.sum(F.col("late").cast("long")).alias("late_rows"))


#: What a symbol's order updates tell, over and over: a lifecycle with an add, an add over the cap, and a fill that comes late.
SCRIPT = ("ENTRY_SENT", "ENTRY_FILLED", "ADD_SENT", "ADD_FILLED", "ADD_SENT", "CLOSE_SENT", "CLOSE_FILLED", "ENTRY_FILLED")
DESK_MOVED = MOVED.replace("status =", "m.status =").replace("event =", "r.event =").replace("step <", "m.step <").replace("ELSE status", "ELSE m.status")
RUNS_NOW = f"r.event IS NULL AND (m.last IS NULL OR r.t - m.last >= CASE WHEN m.status = 'FLAT' THEN {P.decision_interval_flat} ELSE {P.decision_interval_open} END)"


def desk_rows(spark, d):
    """Ticks of the tape, some of which are order updates instead (every fifth of these comes twice)."""
    t = adapters.tape(spark, d).select("symbol", "t", "seq", (F.col("is_buyer_maker") & (F.col("qty") % 2 == 0)).alias("update"))
    told = scan.indexed(t.filter("update"), DAY).withColumn("event", F.element_at(F.array(*(F.lit(e) for e in SCRIPT)), (F.col("idx") % len(SCRIPT) + 1).cast("int")))
    told = told.unionByName(told.filter("idx % 5 = 0")).select("symbol", "t", "seq", "event")
    return told.unionByName(t.filter("NOT update").select("symbol", "t", "seq", F.lit(None).cast("string").alias("event")))


@query("T1_T2_stream_desk", "symbol seq t decision status step", "tape", sql=f"""WITH RECURSIVE r AS (SELECT symbol, t, seq, CASE WHEN u THEN {list(SCRIPT)}[(row_number() OVER (PARTITION BY symbol, u ORDER BY t, seq) - 1) % {len(SCRIPT)} + 1] END AS event, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) AS n
  FROM (SELECT *, is_buyer_maker AND qty % 2 = 0 AS u FROM tape)), m AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS t, 'FLAT' AS status, 0 AS step, CAST(NULL AS BIGINT) AS last, false AS decision, false AS move FROM r
  UNION ALL SELECT symbol, n, seq, t, status, CASE WHEN NOT move THEN step WHEN status = 'FLAT' THEN 0 WHEN event = 'ADD_FILLED' AND was = 'DCA_PENDING' THEN least(1, step + 1) ELSE step END AS step, CASE WHEN decision THEN t ELSE last END AS last, decision, move
  FROM (SELECT r.symbol, r.n, r.seq, r.t, r.event, m.status AS was, m.step, m.last, {RUNS_NOW} AS decision, r.event IS NOT NULL AS move, CASE WHEN r.event IS NULL THEN m.status ELSE {DESK_MOVED} END AS status FROM m JOIN r ON r.symbol = m.symbol AND r.n = m.n + 1))
  SELECT symbol, seq, t, decision, status, step FROM m WHERE decision OR move""")  # fmt: skip
def _(spark, d):
    """Decisions by the interval of the position's status, and the moves of that position, from one state; four micro-batches (more, if they are large), one of which fails and is repeated."""
    stream = streams.replayed(desk_rows(spark, d), 4, most=streams.SLICE_ROWS)
    return streams.interrupted(processors.desk(stream, P.decision_interval_flat, P.decision_interval_open), 2, rocks=True)


TTL = 30 * DAY


def fills_of_orders(spark, d):
    """Fills by their order, and when two thirds of the orders were registered: some only after their first fills."""
    fills = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), adapters.micros("l_shipdate").alias("t"), F.col("l_linenumber").cast("long").alias("seq"))
    orders = adapters.table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("order_id"), (adapters.micros("o_orderdate") + F.col("o_orderkey") % 150 * DAY).alias("order_t"))
    return fills, orders


ONCE = f"""SELECT order_id, seq, t, CASE WHEN NOT (alive AND n = 1) THEN 'dropped' WHEN t >= order_t THEN 'matched' ELSE 'replayed' END AS outcome, greatest(max(t) OVER (), (SELECT max(epoch_us(o_orderdate) + o_orderkey % 150 * {DAY}) FROM orders WHERE o_orderkey % 3 <> 0)) AS newest
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, alive ORDER BY t, seq) AS n FROM (SELECT f.*, o.order_t, coalesce(f.t >= o.order_t - {TTL}, false) AS alive
  FROM (SELECT l_orderkey AS order_id, epoch_us(l_shipdate) AS t, l_linenumber AS seq FROM lineitem) f LEFT JOIN (SELECT o_orderkey AS order_id, min(epoch_us(o_orderdate) + o_orderkey % 150 * {DAY}) AS order_t FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) o USING (order_id)))"""


@query("J1_match_once", "order_id seq outcome", sql=f"SELECT order_id, CAST(seq AS BIGINT) AS seq, outcome FROM ({ONCE})")
def _(spark, d):
    return ledger.match_once(*fills_of_orders(spark, d), TTL)


@query("J1_T8_stream_once", "order_id seq outcome", sql=f"SELECT order_id, CAST(seq AS BIGINT) AS seq, outcome FROM ({ONCE}) WHERE outcome <> 'dropped' OR t + {TTL} + 2000 < newest - {HOUR}")
def _(spark, d):
    """Each order takes one fill; a fill that comes first waits and is replayed, or dropped by a timer. Three micro-batches, one of which is repeated."""
    fills, orders = fills_of_orders(spark, d)
    rows = fills.withColumn("kind", F.lit(1)).unionByName(orders.select("order_id", F.col("order_t").alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind")))
    return streams.interrupted(processors.matched_once(streams.replayed(rows, 3, at="t"), TTL), 1, rocks=True)


@query("T6_stream_late_sink", "symbol slot on_time late_rows", "tape", sql=f"""SELECT symbol, t // {DAY} AS slot, count(*) FILTER (t >= m - {HOUR}) AS on_time, count(*) FILTER (t < m - {HOUR}) AS late_rows FROM (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY seq * 7919 % 10007, seq) AS m FROM tape) GROUP BY 1, 2""")
def _(spark, d):
    """The tape in a shuffled order: late rows go to an output of their own; rows of both, by day."""
    arrived = adapters.tape(spark, d).select("symbol", "seq", "t", (F.col("seq") * 7919 % 10007).alias("arrival"))
    on_time, behind = streams.routed(processors.late(streams.replayed(arrived, 3, by="arrival"), HOUR), "late", rocks=True)
    rows = on_time.withColumn("late", F.lit(0)).unionByName(behind.withColumn("late", F.lit(1)))
    return rows.groupBy("symbol", F.floor(F.col("t") / DAY).cast("long").alias("slot")).agg(F.sum(1 - F.col("late")).alias("on_time"), F.sum("late").alias("late_rows"))
