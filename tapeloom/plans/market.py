"""Queries over the tape: ingest, candles, indicators, order flow, labels, joins over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import candles, indicators, joins, labels, orderflow, scan, stats
from ..params import FIXTURE as P
from ..sources import adapters, readers, sinks
from ..sources.adapters import SQL, table
from .base import query

DAY = 86_400_000_000
HOUR = 3_600_000_000

SQL["candles"] = SQL["tape"] + f""", candles AS (SELECT symbol, t // {P.candle} AS bucket, arg_min(price, t) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, t) AS close, CAST(sum(qty) AS DOUBLE) AS volume, CAST(sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS DOUBLE) AS buy_vol,
  CAST(sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS DOUBLE) AS sell_vol, count(*) AS n,
  t // {P.candle} < max(t // {P.candle}) OVER (PARTITION BY symbol) AS is_closed FROM tape GROUP BY symbol, t // {P.candle})"""  # fmt: skip
SQL["tr"] = SQL["candles"] + """, tr AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bucket) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS idx FROM candles))"""
SQL["atr"] = SQL["tr"] + f""", atr AS (SELECT *, atr / CASE WHEN close = 0 THEN 1.0 ELSE close END AS atr_pct FROM (SELECT *, coalesce(avg(tr) OVER
  (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {P.atr_period - 1} PRECEDING AND CURRENT ROW), 0.0) AS atr FROM tr))"""
SQL["imb"] = SQL["depth"] + f""", vols AS (SELECT symbol, frame, t, coalesce(list_sum(list_transform(bids[1:{2}], lambda e: e.qty)), 0.0) AS b,
  coalesce(list_sum(list_transform(asks[1:{2}], lambda e: e.qty)), 0.0) AS a FROM depth), imb AS (SELECT symbol, frame, frame AS seq, t, b AS bid_volume, a AS ask_volume,
  greatest(-1.0, least(1.0, (b - a) / (b + a))) AS imbalance FROM vols WHERE a + b > 0)"""


def ema_sql(x: str, p: int, source: str) -> str:
    """The recursion as a recursive common table."""
    k = 2 / (p + 1)
    return f"""(WITH RECURSIVE e AS (SELECT symbol, idx, bucket, CAST({x} AS DOUBLE) AS y FROM {source} WHERE idx = 0 UNION ALL
  SELECT s.symbol, s.idx, s.bucket, {k!r} * s.{x} + {1 - k!r} * e.y FROM e JOIN {source} s ON s.symbol = e.symbol AND s.idx = e.idx + 1) SELECT * FROM e)"""


def made_candles(spark, d):
    return candles.candles(adapters.tape(spark, d), P.candle)


def frames(spark, d):
    """Wire frames derived from the events: four kinds and broken ones."""
    e, s = F.col("event_id"), lambda c: c.cast("string")
    price, k = F.lit(100.0) + F.col("value") / 10, F.get_json_object("props", "$.k").cast("int")
    ticker = F.concat(F.lit('{"stream":"s@bookTicker","data":{"b":"'), s(price), F.lit('"'), F.when(k % 10 != 0, F.concat(F.lit(',"a":"'), s(price + 0.01), F.lit('"'))).otherwise(""), F.lit(',"B":"1","A":"2"}}'))
    trade = F.concat(F.lit('{"stream":"s@aggTrade","data":{"q":"'), F.when(k % 10 == 1, "x").otherwise(s(k)), F.lit('","m":'), F.when(e % 2 == 0, "true").otherwise("false"), F.lit("}}"))
    levels = F.concat(F.lit('[["'), s(price), F.lit('","'), s(k), F.lit('"]]'))
    book = F.when(e % 3 == 0, F.lit('{"stream":"s@depth20","data":{"b":[],"a":[]}}')).when(e % 3 == 1, F.concat(F.lit('{"stream":"s@depth20","data":{"b":'), levels, F.lit(',"a":[]}}'))).otherwise(F.concat(F.lit('{"stream":"s@depth20","data":{"bids":'), levels, F.lit(',"asks":[["bad","1"]]}}')))
    raw = F.when(F.col("event_type") == "click", ticker).when(F.col("event_type").isin("view", "purchase"), trade).when(F.col("event_type") == "signup", book).otherwise("not a frame {")
    return table(spark, d, "events").select(e.alias("seq"), raw.alias("raw"))


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("S1_envelopes", "kind n", sql="""SELECT CASE event_type WHEN 'click' THEN 'book_ticker' WHEN 'signup' THEN 'depth' WHEN 'error' THEN 'malformed' ELSE 'agg_trade' END AS kind,
  count(*) AS n FROM events GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return readers.envelopes(frames(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("S1_quarantine", "seq n", sql="SELECT event_id AS seq, count(*) OVER () AS n FROM events WHERE event_type = 'error'")
def _(spark, d):
    """What the fan-out's quarantine holds, and how many it counted while it wrote."""
    path = sinks.scratch(spark, "frames")
    counts = readers.fan_out(readers.envelopes(frames(spark, d)), path)
    return spark.read.schema("seq long, raw string, kind string").parquet(path).filter("kind = 'malformed'").select("seq", F.lit(counts["malformed"]).cast("long").alias("n"))


@query("S2_book_ticker", "seq|bid ask bid_qty mid", sql=f"""SELECT event_id AS seq, 100.0 + value / 10 AS bid, 100.0 + value / 10 + 0.01 AS ask, 1.0 AS bid_qty, 100.0 + value / 10 + 0.005 AS mid
  FROM events WHERE event_type = 'click' AND {K} % 10 <> 0""")  # fmt: skip
def _(spark, d):
    return readers.book_ticker(readers.envelopes(frames(spark, d)))


@query("S3_agg_trades", "seq is_buyer_maker|qty signed_qty", sql=f"""SELECT event_id AS seq, event_id % 2 = 0 AS is_buyer_maker, {K} AS qty, CASE WHEN event_id % 2 = 0 THEN -{K} ELSE {K} END AS signed_qty
  FROM events WHERE event_type IN ('view', 'purchase') AND {K} > 0 AND {K} % 10 <> 1""")  # fmt: skip
def _(spark, d):
    return readers.agg_trades(readers.envelopes(frames(spark, d)))


@query("S4_depth_rows", "seq n_bids n_asks|best_bid", sql="""SELECT event_id AS seq, 1 AS n_bids, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS n_asks, 100.0 + value / 10 AS best_bid
  FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0""")  # fmt: skip
def _(spark, d):
    rows = readers.depth(readers.envelopes(frames(spark, d)))
    return rows.select("seq", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.get("bids", F.lit(0))["px"].alias("best_bid"))


@query("S5_K1_klines", "symbol open_ms close_ms n|open close volume", "candles", sql=f"""SELECT symbol, bucket * {P.candle // 1000} AS open_ms, (bucket + 1) * {P.candle // 1000} - 1 AS close_ms, n, open, close, volume
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS r FROM candles) WHERE r <= 100""")  # fmt: skip
def _(spark, d):
    ms = P.candle // 1000
    slots = F.array(*(x.cast("string") for x in (F.col("bucket") * ms, *(F.col(n) for n in ("open", "high", "low", "close", "volume")), (F.col("bucket") + 1) * ms - 1, F.lit(0), F.col("n"), F.lit(0), F.lit(0), F.lit(0))))
    return readers.klines(made_candles(spark, d).select("symbol", F.to_json(slots).alias("raw")), 100)


@query("S6_fill_history", "id order_id|price", "fills", sql="""SELECT * FROM (SELECT CAST(substr(symbol, 2) AS BIGINT) * 1000 + seq AS id, order_id, price FROM fills WHERE CAST(substr(symbol, 2) AS BIGINT) * 1000 + seq >= 50000 ORDER BY 1 LIMIT 1000)""")
def _(spark, d):
    rows = adapters.fills(spark, d).withColumn("id", F.substring("symbol", 2, 20).cast("long") * 1000 + F.col("seq"))
    return readers.fill_history(rows, from_id=50_000)


@query("S7_latest_snapshot", "symbol t seq qty|price", "tape", sql="SELECT symbol, t, seq, qty, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC, seq DESC) AS n FROM tape) WHERE n = 1")
def _(spark, d):
    return readers.latest(adapters.tape(spark, d), "symbol", ["t", "seq"])


@query("S7_snapshots", "kind symbol t|a b c", sql="""WITH raw AS (SELECT event_id AS seq, event_id % 4 AS k, 'S' || CAST(user_id % 4 AS VARCHAR) AS s, epoch_us(ts) // 1000 AS t, 100.0 + value / 10 AS x FROM events)
  SELECT kind, symbol, t, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY kind, symbol ORDER BY t DESC, seq DESC) AS n FROM (
  SELECT CASE k WHEN 0 THEN 'position' WHEN 1 THEN 'premium' WHEN 2 THEN 'open_interest' ELSE 'balance' END AS kind, CASE k WHEN 3 THEN 'USDT' ELSE s END AS symbol, seq, t,
  CASE k WHEN 0 THEN -x ELSE x END AS a, CASE k WHEN 0 THEN x + 1 WHEN 1 THEN x / 1000 WHEN 3 THEN x - 1 END AS b, CASE k WHEN 0 THEN x / 2 END AS c FROM raw)) WHERE n = 1""")  # fmt: skip
def _(spark, d):
    x, k = F.lit(100.0) + F.col("value") / 10, F.col("event_id") % 4
    text, t = (lambda name, v: F.concat(F.lit(f'"{name}":"'), v.cast("string"), F.lit('"'))), F.floor(adapters.micros("ts") / 1000).cast("string")
    s = F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string"))
    raws = {
        0: ([text("symbol", s), text("positionAmt", -x), text("entryPrice", x + 1), text("liquidationPrice", x / 2)], "updateTime"), 1: ([text("symbol", s), text("markPrice", x), text("lastFundingRate", x / 1000)], "time"),
        2: ([text("symbol", s), text("openInterest", x)], "time"), 3: ([text("asset", F.lit("USDT")), text("balance", x), text("availableBalance", x - 1)], "updateTime"),
    }
    raw = F.coalesce(*(F.when(k == i, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(f',"{at}":'), t, F.lit("}"))) for i, (parts, at) in raws.items()))
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), k.alias("k"), raw.alias("raw"))
    return readers.account_snapshots(rows, {0: "position", 1: "premium", 2: "open_interest", 3: "balance"})


def exchange_info(spark, d):
    size = F.col("p_size")
    lot = F.concat(F.lit('{"filterType":"LOT_SIZE","stepSize":"'), (F.lit(1.0) / size).cast("string"), F.lit('","minQty":"'), size.cast("string"), F.lit('"}'))
    rest = F.when(size % 5 != 0, F.concat(F.lit(',{"filterType":"MIN_NOTIONAL","notional":"'), F.col("p_retailprice").cast("string"), F.lit('"}'))).otherwise("")
    raw = F.concat(F.lit('{"symbol":"P'), F.col("p_partkey").cast("string"), F.lit('","filters":[{"filterType":"PRICE_FILTER","tickSize":"0.01"},'), lot, rest, F.lit("]}"))
    return table(spark, d, "part").select(raw.alias("raw"))


FILTERS = "SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, 0.01 AS tick_size, 1.0 / p_size AS step_size, CAST(p_size AS DOUBLE) AS min_qty, CASE WHEN p_size % 5 <> 0 THEN p_retailprice ELSE 0.0 END AS min_notional FROM part"


@query("S8_symbol_filters", "symbol|tick_size step_size min_qty min_notional", sql=FILTERS)
def _(spark, d):
    return readers.symbol_filters(exchange_info(spark, d))


@query("J10_known_filters", "symbol n|tick_size", "fills", sql="SELECT symbol, count(*) AS n, max(0.01) AS tick_size FROM fills GROUP BY symbol")
def _(spark, d):
    filters = readers.symbol_filters(exchange_info(spark, d))
    return readers.known_filters(adapters.fills(spark, d), filters).groupBy("symbol").agg(F.count("*").alias("n"), F.max("tick_size").alias("tick_size"))


@query("A1_candles", "symbol bucket n is_closed|open high low close volume buy_vol sell_vol", "candles", sql="SELECT * FROM candles")
def _(spark, d):
    return made_candles(spark, d)


@query("A2_U1_backfill", "symbol bucket source|close", "candles", sql="""SELECT symbol, bucket, CASE WHEN bucket % 3 = 0 THEN 'live' ELSE 'backfill' END AS source, CASE WHEN bucket % 3 = 0 THEN close ELSE close + 1 END AS close
  FROM candles WHERE bucket % 3 = 0 OR is_closed""")  # fmt: skip
def _(spark, d):
    c = made_candles(spark, d)
    return candles.backfilled(c.filter("bucket % 3 = 0"), c.withColumn("close", F.col("close") + 1))


@query("K3_keep_last", "symbol bucket|close", "candles", sql=f"SELECT symbol, bucket, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS r FROM candles) WHERE r <= {P.keep_candles}")
def _(spark, d):
    return candles.keep_last(made_candles(spark, d), P.keep_candles)


@query("P12_warm_up", "symbol bucket closed_n warmed_up", "candles", sql=f"SELECT symbol, bucket, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS closed_n, row_number() OVER (PARTITION BY symbol ORDER BY bucket) >= {max(P.ema_slow, P.atr_period) + 2} AS warmed_up FROM candles WHERE is_closed")
def _(spark, d):
    return candles.warm(made_candles(spark, d), P.ema_slow, P.atr_period)


@query("W1_W2_W3_atr", "symbol bucket|tr atr atr_pct", "atr", sql="SELECT * FROM atr")
def _(spark, d):
    return indicators.atr(made_candles(spark, d), P.atr_period)


@query("W4_ema", "symbol bucket|ema_9 ema_21 ema_55", "tr", sql=f"""SELECT a.symbol, a.bucket, a.y AS ema_9, b.y AS ema_21, c.y AS ema_55 FROM {ema_sql('close', 9, 'tr')} a JOIN {ema_sql('close', 21, 'tr')} b USING (symbol, idx)
  JOIN {ema_sql('close', 55, 'tr')} c USING (symbol, idx)""")  # fmt: skip
def _(spark, d):
    return indicators.ema_stack(made_candles(spark, d), P.ema_fast, P.ema_mid, P.ema_slow)


@query("W5_ema_slope", "symbol bucket ema_order|ema_slope", "tr", sql=f"""SELECT a.symbol, a.bucket, CASE WHEN a.y > b.y AND b.y > c.y THEN 'BULL' WHEN a.y < b.y AND b.y < c.y THEN 'BEAR' ELSE 'MIXED' END AS ema_order,
  coalesce(a.y / lag(a.y) OVER (PARTITION BY a.symbol ORDER BY a.bucket) - 1, 0.0) AS ema_slope FROM {ema_sql('close', 9, 'tr')} a JOIN {ema_sql('close', 21, 'tr')} b USING (symbol, idx) JOIN {ema_sql('close', 55, 'tr')} c USING (symbol, idx)""")  # fmt: skip
def _(spark, d):
    return indicators.ema_stack(made_candles(spark, d), P.ema_fast, P.ema_mid, P.ema_slow)


@query("W6_returns", "symbol bucket|ret_5 ret_15 ret_30", "candles", sql="SELECT symbol, bucket, " + ", ".join(f"close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS ret_{n}" for n in (5, 15, 30)) + " FROM candles")
def _(spark, d):
    return indicators.returns(made_candles(spark, d), (5, 15, 30))


def indexed_tape(spark, d):
    return scan.indexed(adapters.tape(spark, d), DAY)


@query("W7_tick_volatility", "symbol seq|tick_vol", "tape", sql="""SELECT symbol, seq, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tick_vol FROM (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY t, seq) - 1 AS r FROM tape)""")
def _(spark, d):
    return labels.tick_volatility(indexed_tape(spark, d), 20, size=500)


@query("W8_volume_z", "symbol bucket|volume_z", "candles", sql="""SELECT symbol, bucket, CASE WHEN s > 0 THEN (volume - m) / s ELSE 0.0 END AS volume_z FROM (SELECT *, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS s FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""")
def _(spark, d):
    return indicators.volume_z(made_candles(spark, d), 30)


@query("W9_atr_ratio", "symbol bucket|atr_ratio", "atr", sql=f"SELECT symbol, bucket, CASE WHEN m = 0 THEN 1.0 ELSE atr / m END AS atr_ratio FROM (SELECT *, avg(atr) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {P.atr_ratio_window - 1} PRECEDING AND CURRENT ROW) AS m FROM atr)")
def _(spark, d):
    return indicators.atr_ratio(indicators.atr(made_candles(spark, d), P.atr_period), P.atr_ratio_window)


@query("W10_rsi", "symbol bucket|rsi", "tr", sql="""WITH RECURSIVE c AS (SELECT symbol, bucket, idx, greatest(coalesce(close - prev, 0.0), 0.0) AS u, greatest(coalesce(prev - close, 0.0), 0.0) AS dn FROM tr),
  e AS (SELECT symbol, bucket, idx, CAST(u AS DOUBLE) AS au, CAST(dn AS DOUBLE) AS ad FROM c WHERE idx = 0 UNION ALL SELECT c.symbol, c.bucket, c.idx, e.au * (1 - 1 / 14.0) + c.u / 14.0, e.ad * (1 - 1 / 14.0) + c.dn / 14.0
  FROM e JOIN c ON c.symbol = e.symbol AND c.idx = e.idx + 1) SELECT symbol, bucket, CASE WHEN au + ad > 0 THEN 100 * au / (au + ad) ELSE 50.0 END AS rsi FROM e""")  # fmt: skip
def _(spark, d):
    return indicators.rsi(made_candles(spark, d))


@query("W11_rolling_delta", "symbol seq|delta", "tape", sql=f"SELECT symbol, seq, sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {P.delta_window} PRECEDING AND CURRENT ROW) AS delta FROM tape")
def _(spark, d):
    return orderflow.rolling_delta(adapters.tape(spark, d), P.delta_window)


def imbalances(spark, d):
    return orderflow.imbalance(adapters.depth(spark, d), 2).withColumn("seq", F.col("frame"))


@query("A3_A4_K2_imbalance", "symbol frame|bid_volume ask_volume imbalance", "imb", sql="SELECT * FROM imb")
def _(spark, d):
    return imbalances(spark, d)


@query("W12_average_imbalance", "symbol frame|avg_imbalance", "imb", sql=f"SELECT symbol, frame, avg(imbalance) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW) AS avg_imbalance FROM imb")
def _(spark, d):
    return orderflow.average_imbalance(imbalances(spark, d), 30 * DAY)


@query("A5_traded_volume", "symbol slot|buy sell delta", "tape", sql=f"""SELECT symbol, t // {P.delta_window} AS slot, sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS buy, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS sell,
  sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) AS delta FROM tape GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return orderflow.traded_volume(adapters.tape(spark, d), P.delta_window)


@query("W13_forward_return", "symbol seq|fwd_ret", "tape", sql=f"SELECT symbol, seq, lead(price, {P.horizon}) OVER (PARTITION BY symbol ORDER BY t, seq) / price - 1 AS fwd_ret FROM tape")
def _(spark, d):
    return labels.forward(indexed_tape(spark, d), P.horizon, size=500)


LABELS = f"""SELECT symbol, seq, price, fwd_ret, tick_vol, CASE WHEN fwd_ret IS NOT NULL THEN CAST(abs(fwd_ret) >= 0.05 AS INTEGER) END AS tp_hit, CASE WHEN fwd_ret IS NOT NULL AND tick_vol IS NOT NULL THEN CAST(abs(fwd_ret) <= tick_vol AS INTEGER) END AS noise
  FROM (SELECT *, lead(price, {P.horizon}) OVER (PARTITION BY symbol ORDER BY t, seq) / price - 1 AS fwd_ret, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tick_vol
  FROM (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY t, seq) - 1 AS r FROM tape))"""


def labelled(spark, d):
    return labels.outcome(labels.tick_volatility(labels.forward(indexed_tape(spark, d), P.horizon, size=500), 20, size=500), 0.05)


@query("W14_labels", "symbol seq tp_hit noise", "tape", sql=LABELS)
def _(spark, d):
    return labelled(spark, d)


@query("W18_expanding_z", "symbol seq|z", "tape", sql="""SELECT symbol, seq, CASE WHEN n < 2 THEN price ELSE (price - m) / CASE WHEN s < 1e-8 THEN 1.0 ELSE s END END AS z FROM (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS m, stddev_samp(price) OVER w AS s
  FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY t, seq))""")  # fmt: skip
def _(spark, d):
    return indicators.expanding_z(adapters.tape(spark, d), "price", DAY)


@query("W19_trend_scale", "symbol bucket|trend_scale", "tr", sql="""WITH RECURSIVE c AS (SELECT symbol, bucket, idx, greatest(abs(coalesce(close / prev - 1, 0.0)), 1e-6) AS m FROM tr),
  e AS (SELECT symbol, bucket, idx, 0.98 * CAST(0.0015 AS DOUBLE) + 0.02 * m AS s FROM c WHERE idx = 0 UNION ALL SELECT c.symbol, c.bucket, c.idx, 0.98 * e.s + 0.02 * c.m FROM e JOIN c ON c.symbol = e.symbol AND c.idx = e.idx + 1)
  SELECT symbol, bucket, s AS trend_scale FROM e""")  # fmt: skip
def _(spark, d):
    c = indicators.numbered(indicators.returns(made_candles(spark, d), (1,)))
    return indicators.trend_scale(c, "ret_1")


@query("W22_A19_feed_health", "symbol period messages gaps max_gap reconnects", "tape", sql=f"""SELECT symbol, period, sum(m) AS messages, sum(g) AS gaps, max(idle) AS max_gap, sum(r) AS reconnects FROM (SELECT symbol, t // {DAY} AS period, 1 AS m, CASE WHEN coalesce(idle, 0) > {HOUR} THEN 1 ELSE 0 END AS g, idle, 0 AS r
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY t, seq) AS idle FROM tape) UNION ALL SELECT 'S' || CAST(user_id % 4 AS VARCHAR), epoch_us(ts) // {DAY}, 0, 0, NULL, 1 FROM events WHERE event_type = 'error') GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    lost = table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), adapters.micros("ts").alias("t"))
    return stats.feed_health(adapters.tape(spark, d), DAY, HOUR, lost)


@query("W23_streak", "symbol seq confirmed", "tape", sql="SELECT symbol, seq, sum(CASE WHEN price > 102 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS confirmed FROM tape")
def _(spark, d):
    return labels.streak(indexed_tape(spark, d), F.col("price") > 102, 3, size=500)


@query("W24_T12_first_seen", "symbol seq t", "tape", sql="SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, arg_min(event_id, epoch_us(ts)) AS seq, min(epoch_us(ts)) AS t FROM events GROUP BY 1")
def _(spark, d):
    return labels.first_seen(adapters.tape(spark, d, wide=True), "symbol")


#: Book frames on the tape's time axis.
FRAME_T = "1704067200000000 + (frame * 1000003000) % 2592000000000"


@query("W12_imbalance_at_ticks", "symbol seq|avg_imbalance", "tape", "imb", sql=f"""SELECT l.symbol, l.seq, coalesce(l.mean, CASE WHEN l.t - b.t <= {P.depth_stale} THEN b.imbalance END, 0.0) AS avg_imbalance
  FROM (SELECT t.symbol, t.seq, t.t, avg(i.imbalance) AS mean FROM tape t LEFT JOIN (SELECT symbol, {FRAME_T} AS t, imbalance FROM imb) i ON i.symbol = t.symbol AND i.t BETWEEN t.t - {P.imbalance_window} AND t.t GROUP BY 1, 2, 3) l
  ASOF LEFT JOIN (SELECT symbol, {FRAME_T} AS t, arg_max(imbalance, frame) AS imbalance FROM imb GROUP BY 1, 2) b ON l.symbol = b.symbol AND l.t >= b.t""")  # fmt: skip
def _(spark, d):
    """The window's mean at decision ticks; where no frame fell into it, the last fresh one."""
    frames = imbalances(spark, d).select("symbol", F.expr(FRAME_T).alias("t"), "seq", "imbalance")
    return orderflow.imbalance_at(adapters.tape(spark, d), frames, P.imbalance_window, P.depth_stale, DAY)


@query("J6_T7_as_of", "symbol seq age_depth age_trade age_funding age_balance data_available|imbalance funding balance", "tape", "imb", sql=f"""SELECT l.symbol, l.seq, CASE WHEN l.t - b.t <= {P.depth_stale} THEN l.t - b.t END AS age_depth, CASE WHEN l.t - r.t <= {P.trade_stale} THEN l.t - r.t END AS age_trade,
  CASE WHEN l.t - f.t <= {8 * HOUR} THEN l.t - f.t END AS age_funding, CASE WHEN l.t - g.t <= {6 * HOUR} THEN l.t - g.t END AS age_balance, coalesce(l.t - b.t <= {P.depth_stale}, false) AND coalesce(l.t - r.t <= {P.trade_stale}, false) AS data_available,
  CASE WHEN l.t - b.t <= {P.depth_stale} THEN b.imbalance ELSE 0.0 END AS imbalance, CASE WHEN l.t - f.t <= {8 * HOUR} THEN f.price / 1000 END AS funding, CASE WHEN l.t - g.t <= {6 * HOUR} THEN g.price * 10 END AS balance
  FROM tape l ASOF LEFT JOIN (SELECT symbol, {FRAME_T} AS t, imbalance FROM imb) b ON l.symbol = b.symbol AND l.t >= b.t ASOF LEFT JOIN (SELECT * FROM tape WHERE seq % 3 = 0) r ON l.symbol = r.symbol AND l.t >= r.t
  ASOF LEFT JOIN (SELECT * FROM tape WHERE seq % 7 = 0) f ON l.symbol = f.symbol AND l.t >= f.t ASOF LEFT JOIN (SELECT * FROM tape WHERE seq % 11 = 0) g ON l.symbol = g.symbol AND l.t >= g.t""")  # fmt: skip
def _(spark, d):
    t = adapters.tape(spark, d)
    book = imbalances(spark, d).select("symbol", F.expr(FRAME_T).alias("t"), "imbalance")
    sides = {
        "depth": (book, ["imbalance"], P.depth_stale), "trade": (t.filter("seq % 3 = 0").select("symbol", "t", F.col("qty").alias("trade_qty")), ["trade_qty"], P.trade_stale),
        "funding": (t.filter("seq % 7 = 0").select("symbol", "t", (F.col("price") / 1000).alias("funding")), ["funding"], 8 * HOUR),
        "balance": (t.filter("seq % 11 = 0").select("symbol", "t", (F.col("price") * 10).alias("balance")), ["balance"], 6 * HOUR),
    }
    rows = joins.as_of_many(t, sides, chunk=DAY)
    return rows.withColumn("data_available", F.col("age_depth").isNotNull() & F.col("age_trade").isNotNull()).withColumn("imbalance", F.coalesce("imbalance", F.lit(0.0)))


@query("J8_reconnect_cooldown", "symbol seq allowed", "tape", sql=f"""SELECT l.symbol, l.seq, NOT coalesce(l.t - r.t < {P.reconnect_cooldown}, false) AS allowed FROM (SELECT * FROM tape WHERE seq % 7 <> 0) l
  ASOF LEFT JOIN (SELECT * FROM tape WHERE seq % 7 = 0) r ON l.symbol = r.symbol AND l.t >= r.t""")  # fmt: skip
def _(spark, d):
    t = adapters.tape(spark, d)
    rows = joins.latest_event_age(t.filter("seq % 7 <> 0"), t.filter("seq % 7 = 0"), P.reconnect_cooldown)
    return rows.withColumn("allowed", ~F.coalesce(F.col("since") < P.reconnect_cooldown, F.lit(False)))


@query("P17_dead_market", "symbol bucket blocked", "atr", sql="SELECT symbol, bucket, atr_pct > 0 AND atr_pct < 0.03 AS blocked FROM atr")
def _(spark, d):
    return indicators.atr(made_candles(spark, d), P.atr_period).withColumn("blocked", rules.dead_market(F.col("atr_pct"), 0.03))


@query("F35_regime", "symbol bucket regime", "tr", sql=f"""SELECT symbol, bucket, CASE WHEN ratio >= 1.6 THEN 'HIGH_VOL' WHEN ratio <= 0.6 THEN 'LOW_VOL' WHEN abs(slope) >= 0.0006 THEN 'STRONG_TREND' WHEN abs(slope) >= 0.0002 THEN 'WEAK_TREND' ELSE 'SIDEWAYS' END AS regime FROM (
  SELECT x.symbol, x.bucket, CASE WHEN m = 0 THEN 1.0 ELSE atr / m END AS ratio, slope FROM (SELECT *, avg(atr) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {P.atr_ratio_window - 1} PRECEDING AND CURRENT ROW) AS m FROM (
  SELECT *, coalesce(avg(tr) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {P.atr_period - 1} PRECEDING AND CURRENT ROW), 0.0) AS atr FROM tr)) x
  JOIN (SELECT symbol, bucket, coalesce(y / lag(y) OVER (PARTITION BY symbol ORDER BY bucket) - 1, 0.0) AS slope FROM {ema_sql('close', 9, 'tr')}) e USING (symbol, bucket))""")  # fmt: skip
def _(spark, d):
    c = indicators.atr_ratio(indicators.atr(made_candles(spark, d), P.atr_period), P.atr_ratio_window)
    return indicators.ema_stack(c, P.ema_fast, P.ema_mid, P.ema_slow).withColumn("regime", indicators.regime(F.col("atr_ratio"), F.col("ema_slope")))


def flagship(spark, d):
    """Per symbol and candle: OHLCV, volatility, trend, regime, rolling delta at its last tick, and the guard's verdict."""
    t = adapters.tape(spark, d)
    c = indicators.ema_stack(indicators.atr_ratio(indicators.atr(candles.candles(t, P.candle), P.atr_period), P.atr_ratio_window), P.ema_fast, P.ema_mid, P.ema_slow)
    c = c.withColumn("regime", indicators.regime(F.col("atr_ratio"), F.col("ema_slope")))
    flow = orderflow.rolling_delta(t, P.delta_window)
    last = flow.groupBy("symbol", F.floor(F.col("t") / P.candle).cast("long").alias("bucket")).agg(F.max_by("delta", F.struct("t", "seq")).alias("delta"))
    rows = c.join(last.hint("merge"), ["symbol", "bucket"]).withColumn("side", F.when(F.col("ema_slope") >= 0, "LONG").otherwise("SHORT"))
    imb = (F.col("buy_vol") - F.col("sell_vol")) / F.col("volume")
    verdict = rules.flow_guard(F.col("side"), imb, F.col("delta"), F.lit(True), F.lit(True), P.flow_threshold, P.flow_support, P.flow_delta_min, F.lit(True))
    return rows.withColumn("_v", verdict).select("symbol", "bucket", "open", "high", "low", "close", "volume", "atr_pct", "ema_9", "ema_21", "ema_55", "regime", "side", "delta", F.col("_v.blocked").alias("blocked"), F.col("_v.reason").alias("reason"))


@query("flagship", "symbol bucket regime side blocked reason|open high low close volume atr_pct ema_9 ema_21 ema_55 delta")
def _(spark, d):
    return flagship(spark, d)
