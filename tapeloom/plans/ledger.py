"""Queries over fills and trades: roll-ups, lifecycles, statistics, audits, set operations, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..operators import indicators, joins, ledger, models, scan, stats, tree
from ..params import FIXTURE as P
from ..sources import adapters, readers, sinks, tradelog
from ..sources.adapters import table
from .base import query
from .market import DAY, labelled



def made_trades(spark, d):
    return ledger.trades(adapters.fills(spark, d), hot=adapters.hot_symbols(spark, d))


def results(spark, d):
    """Running results; a symbol is hot if its fills are."""
    fills, hot = adapters.fills(spark, d), adapters.hot_symbols(spark, d)
    return ledger.running_results(ledger.trades(fills, hot=hot), hot=hot)


@query("A6_order_rollup", "symbol order_id|qty avg_price commission realized", "fills", sql="SELECT symbol, order_id, sum(abs(qty)) AS qty, sum(price * abs(qty)) / sum(abs(qty)) AS avg_price, sum(commission) AS commission, sum(realized) AS realized FROM fills GROUP BY 1, 2")
def _(spark, d):
    return ledger.orders(adapters.fills(spark, d))


@query("A7_trades", "symbol life side open_t close_t n_fills dca_count win|gross fees net size notional", "trades", sql="SELECT *, net > 0 AS win FROM trades")
def _(spark, d):
    return made_trades(spark, d)


@query("A8_open_lives", "symbol n_fills open_t last_t|left_qty", "fills", sql="""SELECT symbol, count(*) AS n_fills, min(t) AS open_t, max(t) AS last_t, sum(qty) AS left_qty FROM (SELECT *, max(seq) OVER (PARTITION BY symbol) AS m FROM fills)
  WHERE m % 3 <> 0 AND (seq - 1) // 3 = (m - 1) // 3 GROUP BY symbol""")  # fmt: skip
def _(spark, d):
    return ledger.open_lives(adapters.fills(spark, d)).withColumnRenamed("left", "left_qty")


@query("A9_W21_entry_prices", "symbol seq|avg_entry anchor_distance", "fills", sql="""SELECT symbol, seq, CASE WHEN seq % 3 = 1 THEN price ELSE (abs(q1) * p1 + abs(q2) * p2) / (abs(q1) + abs(q2)) END AS avg_entry,
  CASE WHEN seq % 3 = 2 THEN CASE WHEN q1 > 0 THEN p1 - price ELSE price - p1 END / p1 END AS anchor_distance FROM (SELECT *, max(CASE WHEN seq % 3 = 1 THEN qty END) OVER g AS q1, max(CASE WHEN seq % 3 = 1 THEN price END) OVER g AS p1,
  max(CASE WHEN seq % 3 = 2 THEN qty END) OVER g AS q2, max(CASE WHEN seq % 3 = 2 THEN price END) OVER g AS p2 FROM fills WINDOW g AS (PARTITION BY symbol, (seq - 1) // 3))""")  # fmt: skip
def _(spark, d):
    return ledger.entry_prices(adapters.fills(spark, d))


def graded_trades(spark, d):
    t = made_trades(spark, d)
    part = F.substring("symbol", 2, 20).cast("long")
    return t.withColumn("regime", F.when(part % 3 == 0, "SIDEWAYS").when(part % 3 == 1, "WEAK_TREND").otherwise("STRONG_TREND")).withColumn("bucket", part % 10)


GRADED = "SELECT *, CAST(substr(symbol, 2) AS BIGINT) % 10 AS bucket, CASE CAST(substr(symbol, 2) AS BIGINT) % 3 WHEN 0 THEN 'SIDEWAYS' WHEN 1 THEN 'WEAK_TREND' ELSE 'STRONG_TREND' END AS regime FROM trades"


@query("A10_performance", "level value trades wins|win_rate profit_factor expectancy", "trades", sql=f"""SELECT CASE WHEN grouping(side) = 0 THEN 'side' WHEN grouping(regime) = 0 THEN 'regime' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS level,
  coalesce(side, regime, CAST(bucket AS VARCHAR), 'all') AS value, count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net > 0) / count(*) AS win_rate,
  sum(net) FILTER (net > 0) / (-(sum(net) FILTER (net < 0))) AS profit_factor, avg(net) AS expectancy FROM ({GRADED}) GROUP BY GROUPING SETS ((), (side), (regime), (bucket))""")  # fmt: skip
def _(spark, d):
    return stats.performance(graded_trades(spark, d))


TODAY = 11_000


@query("A11_accounting", "trade_count|realized today", "trades", sql=f"SELECT count(*) AS trade_count, coalesce(sum(net), 0.0) AS realized, coalesce(sum(net) FILTER (close_t // {DAY} = {TODAY}), 0.0) AS today FROM trades")
def _(spark, d):
    return ledger.accounting(made_trades(spark, d), TODAY)


def head_labels(spark, d):
    rows = labelled(spark, d)
    return rows.select("symbol", F.explode(F.map_from_arrays(F.array(F.lit("tp_hit"), F.lit("noise")), F.array("tp_hit", "noise"))).alias("head", "label"))


HEADS = """SELECT symbol, head, count(label) AS samples, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives, count(DISTINCT label) AS classes, CASE WHEN count(label) > 0 THEN sum(label) / count(label) ELSE 0.0 END AS base_rate
  FROM (SELECT symbol, 'tp_hit' AS head, tp_hit AS label FROM lab UNION ALL SELECT symbol, 'noise', noise FROM lab) GROUP BY 1, 2"""


def _labels_view():
    from .market import LABELS

    adapters.SQL["lab"] = adapters.SQL["tape"] + f", lab AS ({LABELS})"


_labels_view()


@query("A12_head_statistics", "symbol head samples positives classes|base_rate", "lab", sql=HEADS)
def _(spark, d):
    return stats.head_statistics(head_labels(spark, d))


@query("A13_readiness", "symbol head readiness", "lab", sql=f"SELECT symbol, head, CASE WHEN symbol = 'S0' THEN 'WARMING_UP' WHEN samples >= 20 AND classes >= 2 THEN 'READY' ELSE 'UNRELIABLE' END AS readiness FROM ({HEADS})")
def _(spark, d):
    return stats.head_statistics(head_labels(spark, d)).withColumn("readiness", rules.readiness(F.col("symbol") != "S0", F.col("samples"), F.col("classes")))


@query("A14_bucket_evidence", "bucket trades wins|win_share net", "trades", sql="""SELECT CASE WHEN p < 0.05 THEN '~0' WHEN p < 0.5 THEN '<0.5' WHEN p < 0.95 THEN '0.5+' ELSE '~1' END AS bucket, count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net > 0) / count(*) AS win_share,
  sum(net) AS net FROM (SELECT *, (CAST(substr(symbol, 2) AS BIGINT) % 101) / 100.0 AS p FROM trades) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return stats.bucket_evidence(made_trades(spark, d).withColumn("p", (F.substring("symbol", 2, 20).cast("long") % 101) / 100.0))


@query("A15_break_even", "|break_even avg_win avg_loss", "trades", sql=f"""SELECT (l + {P.round_trip_fee} * n) / (w + l) AS break_even, w AS avg_win, l AS avg_loss FROM (SELECT avg(gross) FILTER (gross > 0) AS w, -(avg(gross) FILTER (gross < 0)) AS l, avg(notional) AS n FROM trades)""")
def _(spark, d):
    return stats.break_even(made_trades(spark, d), P.round_trip_fee)


@query("A17_exit_breakdown", "exit_reason trades|avg_hold net", "trades", sql="SELECT CASE WHEN net > 0 THEN 'target' WHEN dca_count > 0 THEN 'stop_after_add' ELSE 'stop' END AS exit_reason, count(*) AS trades, avg((close_t - open_t) / 1e6) AS avg_hold, sum(net) AS net FROM trades GROUP BY 1", digits=3)
def _(spark, d):
    t = made_trades(spark, d)
    reason = F.when(F.col("net") > 0, "target").when(F.col("dca_count") > 0, "stop_after_add").otherwise("stop")
    return stats.exit_breakdown(t.withColumn("exit_reason", reason).withColumn("hold", (F.col("close_t") - F.col("open_t")) / 1e6))


def scored_trades(spark, d):
    t = made_trades(spark, d)
    return t.select(((F.col("notional").cast("long") % 1000) / 1000.0).alias("p"), F.col("win").cast("int").alias("y"))


SCORED = "SELECT (CAST(trunc(notional) AS BIGINT) % 1000) / 1000.0 AS p, CAST(net > 0 AS INTEGER) AS y FROM trades"


@query("A18_decile_lift", "decile n|rate lift", "trades", sql=f"""SELECT decile, CAST(sum(n) AS BIGINT) AS n, sum(pos) / sum(n) AS rate, (sum(pos) / sum(n)) / (any_value(allpos) / any_value(total)) AS lift FROM (SELECT *, CAST(floor(10 * (sum(n) OVER (ORDER BY p) - n) / sum(n) OVER ()) AS INTEGER) + 1 AS decile, sum(n) OVER () AS total, sum(pos) OVER () AS allpos
  FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM ({SCORED}) GROUP BY p)) GROUP BY decile""")  # fmt: skip
def _(spark, d):
    return stats.decile_lift(scored_trades(spark, d))


@query("A18_M5_auc", "|auc", "trades", sql=f"SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM ({SCORED}) GROUP BY p))")
def _(spark, d):
    return stats.auc(scored_trades(spark, d))


@query("M5_reliability", "bin n|mean_p rate base_rate gap over_base", "trades", sql=f"""SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate, any_value(b) AS base_rate, avg(y) - avg(p) AS gap, avg(y) - any_value(b) AS over_base
  FROM (SELECT p, y, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, avg(y) OVER () AS b FROM ({SCORED})) GROUP BY bin""")  # fmt: skip
def _(spark, d):
    """Calibration against the base rate."""
    return stats.reliability(scored_trades(spark, d))


@query("M5_isotonic", "n pos|low high rate", "trades", sql=f"""WITH s AS (SELECT p, row_number() OVER (ORDER BY p) AS i, n, pos, sum(n) OVER (ORDER BY p) AS cn, sum(pos) OVER (ORDER BY p) AS cp FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM ({SCORED}) GROUP BY p)),
  spans AS (SELECT a.i AS a, b.i AS i, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM s a JOIN s b ON a.i <= b.i), fit AS (SELECT i, max(m) AS rate FROM (SELECT a, i, min(m) OVER (PARTITION BY a ORDER BY i DESC) AS m FROM spans) GROUP BY i)
  SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, min(p) AS low, max(p) AS high, rate FROM fit JOIN s USING (i) GROUP BY rate""")  # fmt: skip
def _(spark, d):
    """The rising fit of the win rate over the probability."""
    return stats.isotonic(scored_trades(spark, d))


@query("W15_T11_running_results", "symbol life day|cum_net day_net drawdown", "trades", sql=f"""SELECT symbol, life, day, cum AS cum_net, sum(net) OVER (PARTITION BY symbol, day ORDER BY close_t, life) AS day_net, greatest(max(cum) OVER (PARTITION BY symbol ORDER BY close_t, life), 0.0) - cum AS drawdown
  FROM (SELECT *, close_t // {DAY} AS day, sum(net) OVER (PARTITION BY symbol ORDER BY close_t, life) AS cum FROM trades)""")  # fmt: skip
def _(spark, d):
    return results(spark, d)


@query("P18_daily_lock", "symbol life lock", "trades", sql=f"""SELECT symbol, life, CASE WHEN x <= -50000 THEN 'loss_limit' WHEN x >= 50000 THEN 'profit_target' END AS lock FROM (SELECT *, sum(net) OVER (PARTITION BY symbol, close_t // {DAY} ORDER BY close_t, life) AS x FROM trades)""")
def _(spark, d):
    return results(spark, d).withColumn("lock", rules.daily_lock(F.col("day_net"), 50_000, 50_000, False))


@query("W16_P16_recent_win_rate", "symbol life|recent_win_rate", "trades", sql=f"SELECT symbol, life, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY close_t, life ROWS BETWEEN {P.win_rate_window} PRECEDING AND 1 PRECEDING) AS recent_win_rate FROM trades WHERE life % 5 <> 0")
def _(spark, d):
    fills = adapters.fills(spark, d)
    hot = scan.hot_keys(fills)  # a symbol is hot if its fills are
    return ledger.recent_win_rate(ledger.trades(fills, hot=hot).filter("life % 5 <> 0"), P.win_rate_window, hot)


@query("W17_positions", "symbol seq life|position", "fills", sql="""SELECT symbol, seq, CAST((seq - 1) // 3 + 1 AS BIGINT) AS life, CASE WHEN seq % 3 = 0 THEN 0.0 ELSE sum(qty) OVER (PARTITION BY symbol ORDER BY seq) END AS position FROM fills""")
def _(spark, d):
    return ledger.positions(adapters.fills(spark, d))


@query("P10_after_cutoff", "symbol life|net", "trades", sql=f"SELECT symbol, life, net FROM trades WHERE close_t >= {TODAY * DAY}")
def _(spark, d):
    return ledger.after_cutoff(made_trades(spark, d), TODAY * DAY)


@query("P13_clean_log", "o_orderkey|net", sql="SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0.0 ELSE o_totalprice END AS net FROM orders WHERE o_orderkey % 6 IN (0, 4, 5)")
def _(spark, d):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, None).when(k == 1, "not-a-number").when(k == 2, "NaN").when(k == 3, "-Infinity").otherwise(F.col("o_totalprice").cast("string"))
    return ledger.clean_log(table(spark, d, "orders").withColumn("net_pnl", text))


def position_ticks(spark, d):
    """Ticks of the tape priced against a position of each of its days."""
    t = adapters.tape(spark, d).withColumn("life", F.floor(F.col("t") / DAY).cast("long"))
    return t.withColumn("net", F.col("price") - 104)


@query("W20_peak_pnl", "symbol seq|peak", "tape", sql=f"SELECT symbol, seq, max(price - 104) OVER (PARTITION BY symbol, t // {DAY} ORDER BY t, seq) AS peak FROM tape")
def _(spark, d):
    return ledger.peak_pnl(position_ticks(spark, d))


@query("W20_armed_peak", "symbol seq|peak", "tape", sql=f"""SELECT symbol, seq, CASE WHEN armed THEN max(CASE WHEN armed THEN net END) OVER (PARTITION BY symbol, life ORDER BY t, seq) END AS peak
  FROM (SELECT *, count(*) FILTER (net >= 3) OVER (PARTITION BY symbol, life ORDER BY t, seq) > 0 AS armed FROM (SELECT symbol, seq, t, t // {DAY} AS life, price - 104 AS net FROM tape))""")  # fmt: skip
def _(spark, d):
    """The peak since the profit lock was armed, by a net of 3."""
    return ledger.peak_pnl(position_ticks(spark, d), 3.0)


#: Trades of parts on the tape's symbols and time axis.
ON_TAPE = "'S' || CAST(CAST(substr(symbol, 2) AS BIGINT) % 4 AS VARCHAR)"


def on_tape(t, time):
    """symbol and a time (``time`` of the trade, moved into the tape's days) of trades, and their number."""
    part = F.substring("symbol", 2, 20).cast("long")
    at = F.lit(1_704_067_200_000_000) + F.floor(F.col(time) / 1000) % 2_000_000_000_000
    return t.select(F.concat(F.lit("S"), (part % 4).cast("string")).alias("symbol"), (part * 1000 + F.col("life")).alias("life"), at.alias("open_t"))


def trades_on_tape(spark, d):
    """Trades moved onto the tape: its symbols, days and prices; a thousand times as fast."""
    t = made_trades(spark, d)
    part = F.substring("symbol", 2, 20).cast("long")
    at = F.lit(1_704_067_200_000_000) + F.floor(F.col("open_t") / 1000) % 2_000_000_000_000
    return t.select(
        F.concat(F.lit("S"), (part % 4).cast("string")).alias("symbol"), (part * 1000 + F.col("life")).alias("life"), "side", "size", "win",
        (100 + F.col("notional") / F.col("size") % 10).alias("entry_price"), at.alias("open_t"), (at + F.floor((F.col("close_t") - F.col("open_t")) / 1000)).alias("close_t"),
    )


TRADES_ON_TAPE = f"""SELECT {ON_TAPE} AS symbol, CAST(substr(symbol, 2) AS BIGINT) * 1000 + life AS life, side, size, 100 + (notional / size) % 10 AS entry_price,
  1704067200000000 + (open_t // 1000) % 2000000000000 AS open_t, 1704067200000000 + (open_t // 1000) % 2000000000000 + (close_t - open_t) // 1000 AS close_t FROM trades"""


@query("J7_excursions", "symbol life n|mfe mae peak_pnl", "tape", "trades", sql=f"""SELECT symbol, life, count(price) AS n, CASE WHEN side = 'LONG' THEN max(price) - entry_price ELSE entry_price - min(price) END AS mfe, CASE WHEN side = 'LONG' THEN min(price) - entry_price ELSE entry_price - max(price) END AS mae,
  CASE WHEN count(price) > 0 THEN greatest(CASE WHEN side = 'LONG' THEN max(price) - entry_price ELSE entry_price - min(price) END * size - {P.round_trip_fee} * entry_price * size, 0.0) END AS peak_pnl
  FROM (SELECT s.*, p.price FROM ({TRADES_ON_TAPE}) s LEFT JOIN tape p ON p.symbol = s.symbol AND p.t BETWEEN s.open_t AND s.close_t) GROUP BY symbol, life, side, size, entry_price""")  # fmt: skip
def _(spark, d):
    """Best and worst move, and the best net, of each trade by its entry price and side over its whole time, by a hierarchy of extremes."""
    return tree.excursions(trades_on_tape(spark, d), adapters.tape(spark, d), P.round_trip_fee)


@query("T13_liquidation_alerts", "symbol life t", "tape", "trades", sql=f"""SELECT s.symbol, s.life, min(p.t) AS t FROM (SELECT *, CASE WHEN side = 'LONG' THEN entry_price * 0.96 ELSE entry_price * 1.04 END AS liquidation FROM ({TRADES_ON_TAPE})) s JOIN tape p ON p.symbol = s.symbol AND p.t BETWEEN s.open_t AND s.close_t
  WHERE CASE WHEN side = 'LONG' THEN p.price * (1 - 0.005) <= liquidation ELSE p.price * (1 + 0.005) >= liquidation END GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    """Each position by its own liquidation price: 4 % from its entry."""
    t = trades_on_tape(spark, d).withColumn("liquidation", F.when(F.col("side") == "LONG", F.col("entry_price") * 0.96).otherwise(F.col("entry_price") * 1.04))
    return tree.liquidation_alerts(t, adapters.tape(spark, d), 0.005)


@query("J9_post_loss_phase", "symbol seq phase", "tape", "trades", sql=f"""SELECT l.symbol, l.seq, CASE WHEN l.t - r.t < {P.cool_off} THEN 'COOL_OFF' WHEN l.t - r.t < {2 * P.cool_off} THEN 'TIGHT' ELSE 'NORMAL' END AS phase
  FROM tape l ASOF LEFT JOIN (SELECT DISTINCT {ON_TAPE} AS symbol, 1704067200000000 + (close_t // 1000) % 2000000000000 AS t FROM trades WHERE net < 0) r ON l.symbol = r.symbol AND l.t >= r.t""")  # fmt: skip
def _(spark, d):
    losses = on_tape(made_trades(spark, d).filter("net < 0"), "close_t").withColumnRenamed("open_t", "t")
    rows = joins.latest_event_age(adapters.tape(spark, d), losses, 2 * P.cool_off)
    return rows.withColumn("phase", joins.phase(F.col("since"), P.cool_off))


adapters.SQL["lv"] = "lv AS (SELECT symbol, CAST(life AS BIGINT) AS life, order_id FROM lives)"


@query("J5_U3_not_logged", "symbol life", "trades", "lv", sql="SELECT symbol, life FROM trades WHERE (symbol, life) NOT IN (SELECT symbol, life FROM lv WHERE order_id % 10 = 0)")
def _(spark, d):
    logged = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("order_id"))
    logged = logged.unionByName(adapters.fills(spark, d).filter("order_id % 10 = 0").select("order_id"))
    return joins.without_logged(made_trades(spark, d), logged)


@query("J1_match_fills", "order_id symbol seq matched", "fills", sql="SELECT order_id, symbol, seq, order_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) AS matched FROM fills")
def _(spark, d):
    return ledger.match_fills(adapters.fills(spark, d), table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("order_id")))


@query("J2_algo_outcome", "algo_id outcome", sql="SELECT o_orderkey AS algo_id, CASE WHEN o_orderstatus <> 'F' THEN 'WORKING' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'FILLED' ELSE 'CANCELLED' END AS outcome FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    algos = o.select(F.col("o_orderkey").alias("algo_id"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("NEW").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("actual_order_id"))
    return ledger.algo_outcome(algos, o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("order_id")))


@query("J12_T9_resolve", "order_id source action", sql="""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'stream' ELSE 'rest' END AS source, CASE CASE WHEN o_orderkey % 2 = 0 THEN 'FILLED' ELSE CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'NEW' ELSE 'ERROR' END END
  WHEN 'FILLED' THEN 'ADVANCE' WHEN 'NEW' THEN 'WAIT' ELSE 'BLOCKED' END AS action FROM orders""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "order_id")
    stream = o.filter("order_id % 2 = 0").select("order_id", F.lit("FILLED").alias("status"))
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "NEW").otherwise("ERROR")
    return ledger.resolve(stream.unionByName(stream), o.select("order_id", status.alias("status")))


@query("J3_reconcile", "symbol verdict", sql="""SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 5 = 0 THEN 'ADOPT' WHEN c_custkey % 5 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'LAGGING' ELSE 'RESET' END
  WHEN c_custkey % 5 = 2 THEN 'SYNCED' WHEN c_custkey % 2 = 0 THEN 'LAGGING' ELSE 'REBUILD' END AS verdict FROM customer""")  # fmt: skip
def _(spark, d):
    k = F.col("c_custkey")
    base = table(spark, d, "customer").select(k, F.concat(F.lit("C"), k.cast("string")).alias("symbol"), F.lit("LONG").alias("side"), F.lit(1.0).alias("qty"), F.lit(10.0).alias("avg_price"), F.when(k % 2 == 0, 1_000_000).otherwise(60_000_000).alias("age"))
    far = base.filter("c_custkey % 5 <> 1").withColumn("qty", F.when(F.col("c_custkey") % 5 == 3, 2.0).otherwise(1.0)).withColumn("avg_price", F.when(F.col("c_custkey") % 5 == 4, 11.0).otherwise(10.0))
    return ledger.reconcile(base.filter("c_custkey % 5 <> 0"), far)


@query("J4_K4_stop_actions", "symbol stop_id action", sql="""SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol, i AS stop_id, CASE WHEN i IS NULL THEN 'PLACE' WHEN i % 10 = 9 THEN 'LEAVE' WHEN c_custkey % 2 = 1 THEN 'CANCEL_STALE' WHEN i % 10 = 0 THEN 'ADOPT' ELSE 'CANCEL' END AS action FROM (
  SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [c_custkey * 10, c_custkey * 10 + 1] WHEN c_custkey % 3 = 1 THEN [c_custkey * 10 + 9] ELSE [NULL] END) AS i FROM customer
  UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 2 = 0) WHERE i IS NOT NULL OR c_custkey % 2 = 0""")  # fmt: skip
def _(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, F.concat(F.lit("C"), k.cast("string")).alias("symbol"))
    ids = F.when(k % 3 == 0, F.array(k * 10, k * 10 + 1)).when(k % 3 == 1, F.array(k * 10 + 9))
    stops = c.select("symbol", F.explode(ids).alias("stop_id")).withColumn("owned", F.col("stop_id") % 10 != 9)
    return ledger.stop_actions(c.select("symbol", (k % 2 == 0).alias("is_open")), stops)


@query("J4_blocked_stops", "symbol stop_id action", sql="""SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol, i AS stop_id, CASE WHEN i IS NULL THEN CASE WHEN c_custkey % 7 = 0 THEN 'BLOCK' ELSE 'PLACE' END WHEN c_custkey % 2 = 1 THEN 'CANCEL_STALE' WHEN i % 10 = 0 THEN 'ADOPT' ELSE 'CANCEL' END AS action
  FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 7 = 0 THEN [NULL] WHEN c_custkey % 3 = 0 THEN [c_custkey * 10, c_custkey * 10 + 1] WHEN c_custkey % 2 = 0 THEN [NULL] END) AS i FROM customer)""")  # fmt: skip
def _(spark, d):
    """Positions whose stops couldn't be listed (here: every seventh) are blocked, whatever stops there are."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, F.concat(F.lit("C"), k.cast("string")).alias("symbol"))
    stops = c.filter("c_custkey % 3 = 0").select("symbol", F.explode(F.array(k * 10, k * 10 + 1)).alias("stop_id"), F.lit(True).alias("owned"))
    return ledger.stop_actions(c.select("symbol", (k % 2 == 0).alias("is_open"), (k % 7 != 0).alias("listed")), stops)


@query("J13_semi_join", "symbol n", "fills", sql="SELECT symbol, count(*) AS n FROM fills WHERE symbol IN (SELECT symbol FROM (SELECT symbol, max(seq) AS m FROM fills GROUP BY 1) WHERE m % 3 <> 0) GROUP BY 1")
def _(spark, d):
    f = adapters.fills(spark, d)
    return f.join(ledger.open_lives(f).select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))


@query("K6_overlap", "t open over", "trades", sql="""SELECT t, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS open, sum(d) OVER (ORDER BY t) > 500 AS over FROM (SELECT t, sum(d) AS d FROM (SELECT open_t AS t, 1 AS d FROM trades UNION ALL SELECT close_t, -1 FROM trades) GROUP BY t)""".replace("AS over FROM", 'AS "over" FROM'))
def _(spark, d):
    return stats.overlap(made_trades(spark, d), 500)


PLACES = f"""WITH RECURSIVE q AS (SELECT symbol, life, open_t, close_t, CAST(substr(symbol, 2) AS BIGINT) % 10 AS account, row_number() OVER (PARTITION BY CAST(substr(symbol, 2) AS BIGINT) % 10 ORDER BY open_t, symbol, life) AS n FROM trades),
  m AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS n, '' AS symbol, CAST(0 AS BIGINT) AS life, false AS admitted, CAST([] AS BIGINT[]) AS taken FROM q UNION ALL SELECT account, n, symbol, life, len(free) < {P.max_positions}, CASE WHEN len(free) < {P.max_positions} THEN list_append(free, close_t) ELSE free END
  FROM (SELECT q.*, list_filter(m.taken, lambda x: x > q.open_t) AS free FROM m JOIN q ON q.account = m.account AND q.n = m.n + 1)) SELECT account, symbol, life, admitted FROM m WHERE n > 0"""


@query("K6_admitted", "account symbol life admitted", "trades", sql=PLACES)
def _(spark, d):
    """Ten accounts with two places each."""
    t = made_trades(spark, d).withColumn("account", F.substring("symbol", 2, 20).cast("long") % 10)
    return stats.admitted(t, P.max_positions)


@query("U2_except_foreign", "order_id", sql="SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey % 4 = 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    return o.filter("order_id % 2 = 1").exceptAll(o.filter("order_id % 4 = 3"))


@query("U4_missing", "which name", sql="SELECT CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'unexpected' END AS which, 'P' || CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_partkey % 3 <> 1")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    want, have = p.filter("p_partkey % 3 <> 2").select("name"), p.filter("p_partkey % 3 <> 0").select("name")
    return want.exceptAll(have).withColumn("which", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("which", F.lit("unexpected")))


def user_events(spark, d):
    e, u = F.col("event_id"), F.concat(F.lit(" s"), (F.col("user_id") % 4).cast("string"), F.lit(" "))
    order = F.concat(F.lit('{"e":"ORDER_TRADE_UPDATE","o":{"s":"'), u, F.lit('","i":'), e.cast("string"), F.lit("}}"))
    wrapped = F.when(e % 2 == 0, F.concat(F.lit('{"e":"ALGO_UPDATE","ao":{"symbol":"'), u, F.lit('","algoId":"'), e.cast("string"), F.lit('","algoStatus":"NEW","S":"BUY","ai":"7"}}'))).otherwise(F.concat(F.lit('{"e":"ALGO_UPDATE","o":{"s":"  ","aid":"'), e.cast("string"), F.lit('","caid":"bot-1","X":"","aoi":"9"}}')))
    raw = F.when(F.col("event_type") == "click", order).when(F.col("event_type") == "view", wrapped).when(F.col("event_type") == "purchase", '{"e":"ACCOUNT_UPDATE","a":{}}').otherwise("[1, 2")
    return readers.user_events(table(spark, d, "events").select(e.alias("seq"), raw.alias("raw")))


@query("S9_user_events", "kind n", sql="SELECT CASE event_type WHEN 'click' THEN 'order' WHEN 'view' THEN 'algo' WHEN 'purchase' THEN 'account' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return user_events(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


SYM = "CASE WHEN event_type = 'click' OR event_type = 'view' AND event_id % 2 = 0 THEN 'S' || CAST(user_id % 4 AS VARCHAR) END"


@query("P2_event_symbol", "seq symbol", sql=f"SELECT event_id AS seq, {SYM} AS symbol FROM events")
def _(spark, d):
    return user_events(spark, d).withColumn("symbol", readers.event_symbol(F.col("raw")))


def watchlist(spark):
    return spark.range(4).filter("id % 2 = 0").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"))


@query("P3_route", "seq symbol routed", sql=f"SELECT event_id AS seq, {SYM} AS symbol, coalesce({SYM} IN ('S0', 'S2'), false) AS routed FROM events")
def _(spark, d):
    return readers.route(user_events(spark, d).withColumn("symbol", readers.event_symbol(F.col("raw"))), watchlist(spark))


@query("P3_unknown", "symbol seq n", sql=f"SELECT {SYM} AS symbol, min(event_id) AS seq, count(*) AS n FROM events WHERE {SYM} NOT IN ('S0', 'S2') GROUP BY 1")
def _(spark, d):
    """Symbols that no watchlist knows, each reported once, with its first event and how many there were."""
    routed = readers.route(user_events(spark, d).withColumn("symbol", readers.event_symbol(F.col("raw"))), watchlist(spark))
    return routed.filter("NOT routed AND symbol IS NOT NULL").groupBy("symbol").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))


ACCOUNT = "user_id % 10"


@query("P4_account_positions", "seq account symbol own", sql=f"""WITH e AS (SELECT event_id AS seq, {ACCOUNT} AS account, 'S' || CAST(user_id % 4 AS VARCHAR) AS held FROM events)
  SELECT seq, account, w AS symbol, held = w AS own FROM e JOIN (SELECT DISTINCT account AS a, held AS w FROM e) ON account = a""")  # fmt: skip
def _(spark, d):
    """Each account event goes to every symbol that its account trades; each keeps its own position."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(ACCOUNT).alias("account"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("held"))
    return ledger.account_events(e).withColumn("own", F.col("symbol") == F.col("held"))


@query("P5_algo_fields", "seq algo_id client_algo_id status actual_order_id", sql="""SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS algo_id, CASE WHEN event_id % 2 = 1 THEN 'bot-1' END AS client_algo_id, CASE WHEN event_id % 2 = 1 THEN '' ELSE 'NEW' END AS status, CASE WHEN event_id % 2 = 1 THEN '9' END AS actual_order_id FROM events WHERE event_type = 'view'""")
def _(spark, d):
    return user_events(spark, d).filter("kind = 'algo'").select("seq", *readers.algo_fields(F.col("raw")))


@query("P6_P7_protective", "stop_id owned protective", sql="SELECT o_orderkey AS stop_id, o_orderkey % 4 = 0 AS owned, o_orderkey % 4 = 0 AND o_orderstatus = 'F' AND o_orderkey % 8 = 0 AS protective FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    client = F.when(k % 4 == 0, "bot-7").when(k % 4 == 1, "bot").when(k % 4 == 2, "botX-1")
    kind = F.when(F.col("o_orderstatus") == "F", "STOP_MARKET").otherwise("LIMIT")
    return table(spark, d, "orders").select(k.alias("stop_id"), rules.owned(client, "bot").alias("owned"), rules.protective(client, "bot", kind, k % 8 == 0).alias("protective"))


@query("S10_trade_log", "id|net_pnl", sql="SELECT o_orderkey AS id, o_totalprice AS net_pnl FROM orders WHERE o_orderkey % 8 = 0")
def _(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 8 == 0, F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"net_pnl":'), F.col("o_totalprice").cast("string"), F.lit("}")))
    for i, text in enumerate(("", "null", "[1, 2]", '"text"', "12", '{"id": 1', "  "), 1):
        raw = raw.when(k % 8 == i, text)
    rows = readers.trade_log(table(spark, d, "orders").select(raw.alias("raw")))
    return rows.select(readers.field(F.col("v"), "$.id", "long").alias("id"), readers.field(F.col("v"), "$.net_pnl", "double").alias("net_pnl"))


@query("S11_additive_csv", "id|net score", sql="SELECT o_orderkey AS id, o_totalprice AS net, CASE WHEN o_orderkey % 2 = 1 THEN 0.5 END AS score FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("net"))
    path = sinks.scratch(spark, "csv")
    o.filter("id % 2 = 0").write.option("header", True).csv(f"{path}/v1")
    o.filter("id % 2 = 1").withColumn("score", F.lit(0.5)).write.option("header", True).csv(f"{path}/v2")
    read = lambda v, s: spark.read.schema(s).option("header", True).csv(f"{path}/{v}")
    return readers.additive(read("v1", "id long, net double"), read("v2", "id long, net double, score double"))


@query("S12_trade_log_sink", "symbol life|net", "trades", sql="SELECT symbol, life, net FROM trades")
def _(spark, d):
    t, path = made_trades(spark, d).select("symbol", "life", "net"), sinks.scratch(spark, "log")
    sinks.append_trades(t.filter("life % 2 = 0"), path)
    sinks.append_trades(t, path)  # the half that is there already isn't written again
    return spark.read.parquet(path)


@query("S12_T10_committed_log", "symbol life|net", "trades", sql="SELECT symbol, life, net FROM trades")
def _(spark, d):
    """Two halves that overlap, one of them sent twice as the same batch, then joined into one folder: each lifecycle once."""
    t, path = sinks.written(made_trades(spark, d).select("symbol", "life", "net"), "trades"), sinks.scratch(spark, "log")
    tradelog.append(t.filter("life % 3 <> 0"), path, "closes:0")
    for _ in range(2):
        tradelog.append(t.filter("life % 3 <> 1"), path, "closes:1")
    tradelog.append(t, path)
    tradelog.compact(spark, path, t.schema)
    return tradelog.snapshot(spark, path, t.schema)


@query("S13_statistics_sink", "level value trades", "trades", sql=f"""SELECT CASE WHEN grouping(side) = 0 THEN 'side' WHEN grouping(regime) = 0 THEN 'regime' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS level, coalesce(side, regime, CAST(bucket AS VARCHAR), 'all') AS value, count(*) AS trades
  FROM ({GRADED}) GROUP BY GROUPING SETS ((), (side), (regime), (bucket))""")  # fmt: skip
def _(spark, d):
    path = sinks.scratch(spark, "stats")
    sinks.export_statistics(stats.performance(graded_trades(spark, d)).select("level", "value", "trades"), path)
    return spark.read.schema("level string, value string, trades long").json(f"{path}/json")


@query("S14_scoped_layout", "env symbol n", "tape", sql="SELECT 'DEMO' AS env, symbol, count(*) AS n FROM tape GROUP BY symbol")
def _(spark, d):
    path = sinks.scratch(spark, "scoped")
    sinks.write_scoped(adapters.tape(spark, d), path, "DEMO")
    return spark.read.parquet(path).filter("env = 'DEMO'").groupBy("env", "symbol").agg(F.count("*").alias("n"))


def snapshots(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    q = F.col("l_quantity").cast("string")
    hist = F.concat(F.lit('[[10.5,'), q, F.lit("]]"))
    m = k % 6
    raw = (
        F.when(m == 0, F.concat(F.lit('{"status":"OPEN","side":"LONG","qty":'), q, F.lit(',"avg_entry_price":10.5,"dca_step":3,"dca_history":'), hist, F.lit("}")))
        .when(m == 1, '{"status":"FLAT"}').when(m == 2, F.concat(F.lit('{"status":"OPEN","side":"UP","total_qty":'), q, F.lit(',"avg_entry_price":1.0}')))
        .when(m == 3, '{"status":"OPEN","side":"SHORT","total_qty":0,"avg_entry_price":1.0}').when(m == 4, F.concat(F.lit('{"status":"CLOSING","side":"SHORT","total_qty":5,"avg_entry_price":1.0,"dca_history":'), hist, F.lit("}")))
        .otherwise('{"status":"FLAT","side":"LONG"}')
    )
    one = table(spark, d, "lineitem").select(k.alias("id"), F.col("l_quantity").alias("q"), raw.alias("raw"))
    return readers.snapshots(one)


@query("S15_snapshots", "id status n_entries|total_qty original_qty", sql="""SELECT l_orderkey * 10 + l_linenumber AS id, CASE m WHEN 1 THEN 'FLAT' WHEN 5 THEN 'FLAT' WHEN 4 THEN 'CLOSING' ELSE 'OPEN' END AS status, CASE WHEN m IN (0, 4) THEN 1 ELSE 0 END AS n_entries,
  CASE m WHEN 0 THEN l_quantity WHEN 2 THEN l_quantity WHEN 3 THEN 0.0 WHEN 4 THEN 5.0 END AS total_qty, CASE m WHEN 0 THEN l_quantity WHEN 2 THEN l_quantity WHEN 3 THEN 0.0 WHEN 4 THEN 5.0 END AS original_qty FROM (SELECT *, (l_orderkey * 10 + l_linenumber) % 6 AS m FROM lineitem)""")  # fmt: skip
def _(spark, d):
    return snapshots(spark, d).withColumn("n_entries", F.coalesce(F.when(F.col("entries").isNotNull(), F.size("entries")), F.lit(0)))


@query("P14_P15_validate", "id ok reason dca_step add_blocked", sql="""SELECT l_orderkey * 10 + l_linenumber AS id, m IN (0, 1) OR m = 4 AND abs(l_quantity - 5) <= 0.02 AS ok, CASE m WHEN 2 THEN 'bad_side' WHEN 3 THEN 'bad_qty' WHEN 4 THEN CASE WHEN abs(l_quantity - 5) > 0.02 THEN 'entries_do_not_sum' END WHEN 5 THEN 'flat_with_position' END AS reason,
  CASE WHEN m = 0 THEN 1 ELSE 0 END AS dca_step, m = 0 AS add_blocked FROM (SELECT *, (l_orderkey * 10 + l_linenumber) % 6 AS m FROM lineitem)""")  # fmt: skip
def _(spark, d):
    rows = snapshots(spark, d).withColumn("step_size", F.lit(0.01)).withColumn("dca_step", F.coalesce("dca_step", F.lit(0)))
    rows = rows.select("id", "dca_step", F.struct("status", "side", "total_qty", "avg_entry_price", F.col("dca_step"), "entries", "step_size").alias("s"))
    rows = rows.withColumn("_v", rules.snapshot_verdict()).select("id", "dca_step", F.col("_v.ok").alias("ok"), F.col("_v.reason").alias("reason"))
    return ledger.clamp_step(rows, 1)


@query("P11_J11_feasibility", "symbol step ok|margin", sql="""SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, step, 5.0 * pow(1.5, step) * CASE WHEN step = 0 THEN 1.0 ELSE 0.5 END * 20 >= CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 10 ELSE 0.0 END AS ok, 5.0 * pow(1.5, step) * CASE WHEN step = 0 THEN 1.0 ELSE 0.5 END * 20 AS margin
  FROM part, (SELECT unnest([0, 1, 2]) AS step)""")  # fmt: skip
def _(spark, d):
    from .market import exchange_info

    steps = readers.symbol_filters(exchange_info(spark, d)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    margin = scalars.notional_for_step(5.0, 1.5, F.col("step"), F.lit(0.5), 20)
    return steps.withColumn("margin", margin).withColumn("ok", F.col("margin") >= F.col("min_notional") / 10)


@query("J11_sweep", "symbol size threshold allowed|notional", sql="""SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, size, threshold, size * p_retailprice AS notional, size * p_retailprice >= 10 * CASE WHEN p_size % 5 <> 0 THEN p_retailprice ELSE 0.0 END AND size * p_retailprice * threshold >= 20.0 AS allowed
  FROM part, (SELECT unnest([5, 10, 20, 40]) AS size), (SELECT CAST(unnest([0.0001, 0.001, 0.01]) AS DOUBLE) AS threshold)""")  # fmt: skip
def _(spark, d):
    """Each symbol with every size and threshold of a sweep (twelve scenarios): whether the size is feasible and its expected gain worth it."""
    from .market import exchange_info

    sizes = spark.createDataFrame([(x,) for x in (5, 10, 20, 40)], "size int").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in (0.0001, 0.001, 0.01)], "threshold double")))
    known = readers.symbol_filters(exchange_info(spark, d)).join(table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), "p_retailprice").hint("merge"), "symbol")
    rows = known.crossJoin(F.broadcast(sizes)).withColumn("notional", F.col("size") * F.col("p_retailprice"))
    return rows.withColumn("allowed", (F.col("notional") >= 10 * F.col("min_notional")) & (F.col("notional") * F.col("threshold") >= 20.0))


def features(spark, d):
    """Ticks with labels and features: quantity, volatility, and the price against all before it, itself left out."""
    rows = labelled(spark, d).withColumn("f_qty", F.col("qty").cast("double")).withColumn("f_vol", F.col("tick_vol"))
    return indicators.expanding_z(rows, "price", DAY, learn=False).withColumnRenamed("z", "f_z")


#: What every head learns from and is scored on, whether at a tick or at a trade's entry.
NAMES = ["f_qty", "f_vol", "f_z"]
FEATURES = """SELECT symbol, seq, t, f_qty, f_vol, CASE WHEN n < 2 THEN price ELSE (price - m) / CASE WHEN s < 1e-8 THEN 1.0 ELSE s END END AS f_z FROM (SELECT l.symbol, l.seq, tape.t, tape.price, CAST(tape.qty AS DOUBLE) AS f_qty, l.tick_vol AS f_vol,
  count(*) OVER w AS n, avg(tape.price) OVER w AS m, stddev_samp(tape.price) OVER w AS s FROM lab l JOIN tape USING (symbol, seq) WINDOW w AS (PARTITION BY l.symbol ORDER BY tape.t, l.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("M1_training_set", "symbol seq tp_hit|f_vol", "lab", sql="SELECT symbol, seq, tp_hit, tick_vol AS f_vol FROM lab WHERE tp_hit IS NOT NULL AND tick_vol IS NOT NULL")
def _(spark, d):
    return models.training_set(features(spark, d), NAMES, "tp_hit")


@query("M1_success_set", "symbol life success|size notional entry_price hold", "trades", sql="SELECT symbol, life, CAST(net > 0 AS INTEGER) AS success, first_qty AS size, first_qty * first_price AS notional, first_price AS entry_price, (close_t - open_t) / 1e6 AS hold FROM trades WHERE life % 5 <> 0")
def _(spark, d):
    """Success at close by the features frozen at entry; infrastructure exits (here: every fifth) are no evidence."""
    t = made_trades(spark, d).filter("life % 5 <> 0").withColumn("success", F.col("win").cast("int"))
    t = t.withColumn("size", F.col("first_qty")).withColumn("entry_price", F.col("first_price")).withColumn("notional", F.col("first_qty") * F.col("first_price"))  # later adds aren't known
    return models.training_set(t.withColumn("hold", (F.col("close_t") - F.col("open_t")) / 1e6), ["size", "notional", "entry_price"], "success")


#: Heads: label and kind. The success head learns from trades, by the same names of features.
HEADS = {"tp_hit": ("tp_hit", "logistic"), "noise": ("noise", "logistic"), "trend": ("fwd", "squaredError"), "quality": ("fwd_abs", "huber")}


def training_rows(spark, d):
    """The tape's training set, written once: heads are fitted to it again and again."""
    rows = models.training_set(features(spark, d), NAMES, "tp_hit").withColumn("fwd", F.col("fwd_ret")).withColumn("fwd_abs", F.abs("fwd_ret"))
    rows = rows.select("symbol", "seq", "t", "tp_hit", "noise", "fwd", "fwd_abs", *NAMES)
    path = sinks.scratch(spark, "training")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def entry_set(spark, d):
    """Trades on the tape with success at close and the features as of their entry; infrastructure exits are no evidence."""
    t = trades_on_tape(spark, d).filter("life % 5 <> 0").select("symbol", "life", "open_t", "close_t", F.col("win").cast("int").alias("success"))
    return models.training_set(models.entry_features(t, features(spark, d), NAMES, P.depth_stale), NAMES, "success")


@query("M1_entry_set", "symbol life success open_t close_t|f_qty f_vol f_z", "lab", "trades", sql=f"""SELECT e.symbol, e.life, CAST(e.net > 0 AS INTEGER) AS success, e.open_t, e.close_t, f.f_qty, f.f_vol, f.f_z FROM ({TRADES_ON_TAPE.replace("SELECT ", "SELECT net, ", 1)}) e
  ASOF JOIN ({FEATURES}) f ON e.symbol = f.symbol AND e.open_t >= f.t WHERE e.life % 5 <> 0 AND e.open_t - f.t <= {P.depth_stale} AND f.f_vol IS NOT NULL""")  # fmt: skip
def _(spark, d):
    return entry_set(spark, d)


@query("M2_rolling_origin", "block n_train n positives|mean_p base_rate")
def _(spark, d):
    """The success head, fitted again before each block of entries to what had closed by then, and scored on the block."""
    rows = sinks.written(entry_set(spark, d), "entries")
    by = models.rolling_origin(rows, NAMES, "success").groupBy("block", "n_train")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("positives"), F.avg("p").alias("mean_p"), F.avg(F.col("success").cast("double")).alias("base_rate"))


FIXED = {"p_tp": ({"f_vol": 20.0, "f_qty": 0.1}, -1.0), "p_noise": ({"f_vol": -10.0}, 1.0), "p_success": ({"f_z": 0.2, "f_qty": -0.05}, 0.0)}


def blended(scored):
    """Risk, confidence and the probabilities of holding and leaving, from the heads' outputs (pred: the trend head's)."""
    strength, direction = models.trend(F.col("pred"), F.lit(0.0015))
    scored = scored.withColumn("trend_confidence", strength).withColumn("direction", direction).withColumn("risk", F.least(F.lit(1.0), F.col("f_vol") / 0.05))
    scored = scored.withColumn("confidence", models.confidence(F.col("p_tp"), F.col("quality"), F.col("trend_confidence"), F.col("p_noise"), F.col("risk")))
    hold = models.hold_probability(F.col("p_success"), F.col("p_tp"), F.col("trend_confidence"), F.col("risk"))
    return scored.withColumn("p_hold", hold).withColumn("p_exit", 1 - F.col("p_hold"))


@query("M3_M6_fixed_blend", "symbol seq direction|p_tp p_noise p_success trend_confidence risk confidence p_hold p_exit", "lab", sql=f"""SELECT *, 1 - p_hold AS p_exit FROM (SELECT *, 0.30 * p_tp + 0.25 * p_success + 0.25 * trend_confidence + 0.20 * (1 - p_noise) - 0.10 * risk AS confidence,
  greatest(0.0, least(1.0, 0.50 * p_success + 0.30 * p_tp + 0.20 * trend_confidence - 0.20 * risk)) AS p_hold FROM (SELECT symbol, seq, 1 / (1 + exp(-(-1.0 + 20.0 * f_vol + 0.1 * f_qty))) AS p_tp, 1 / (1 + exp(-(1.0 - 10.0 * f_vol))) AS p_noise,
  1 / (1 + exp(-(0.2 * f_z - 0.05 * f_qty))) AS p_success, least(abs(0.001 * f_z) / 0.0015, 1.0) AS trend_confidence, CASE WHEN f_z > 0 THEN 'LONG' WHEN f_z < 0 THEN 'SHORT' ELSE 'FLAT' END AS direction, least(1.0, f_vol / 0.05) AS risk FROM ({FEATURES}) WHERE f_vol IS NOT NULL))""")  # fmt: skip
def _(spark, d):
    """The blend over heads of known coefficients."""
    scored = features(spark, d).filter("f_vol IS NOT NULL").withColumn("pred", models.fixed_head({"f_z": 0.001}, logistic=False))
    for name, (weights, intercept) in FIXED.items():
        scored = scored.withColumn(name, models.fixed_head(weights, intercept))
    return blended(scored.withColumn("quality", F.col("p_success")))


def heads(spark, d, which=tuple(HEADS)):
    rows = training_rows(spark, d)
    return rows, {h: models.fit_head(rows, NAMES, *HEADS[h]) for h in which}


@query("M2_M3_M6_F40_scores", "symbol seq direction|p_tp p_noise p_success trend_confidence risk confidence p_hold p_exit")
def _(spark, d):
    """All heads, trend, confidence and hold probability; risk is how far the tick's volatility goes beyond the take-profit distance."""
    rows, made = heads(spark, d)
    made["success"] = models.fit_head(sinks.written(entry_set(spark, d), "entries"), NAMES, "success", "logistic")
    scored = rows
    for head, out in (("tp_hit", "p_tp"), ("noise", "p_noise"), ("success", "p_success"), ("trend", "pred"), ("quality", "worth")):
        scored = models.score(made[head], scored, out=out)
    return blended(scored.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("worth") / 0.05))))


@query("M4_saturation", "head retrain samples|peak peak_after")
def _(spark, d):
    """Heads with a coefficient past the limit (a low one, so that some are) are fitted anew from zero to the later half of the rows, and their
    counters start again."""
    rows, made = heads(spark, d)
    middle = rows.approxQuantile("t", [0.5], 0.001)
    return models.retrained(rows, rows.filter(F.col("t") > (middle or [0])[0]), NAMES, HEADS, made, limit=0.05)


@query("M5_decile_lift", "decile n|rate lift")
def _(spark, d):
    rows, made = heads(spark, d, ("tp_hit",))
    return stats.decile_lift(models.score(made["tp_hit"], rows), y="tp_hit")
