"""Fills to orders, positions, lifecycles and trades; running results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

TOLERANCE = 1e-9
#: Microseconds of history in a chunk of a symbol's running sums (90 days).
CHUNK = 90 * 86_400_000_000


def positions(fills: DataFrame, tolerance: float = TOLERANCE, hot: list | None = None) -> DataFrame:
    """Position after each fill (flat within the tolerance) and life, which counts up whenever the position leaves zero. A
    fill that crosses zero stays in its life. ``seq`` follows ``t``. A symbol's fills lie together once, and both are running sums there; only ``hot`` symbols
    (counted, if None) go by chunks of time."""
    few, many = scan.split_hot(fills, scan.hot_keys(fills) if hot is None else hot)

    def marked(rows: DataFrame, total) -> DataFrame:
        rows = total(rows, "_run", F.col("qty"))
        rows = rows.withColumn("position", F.when(F.abs("_run") < tolerance, 0.0).otherwise(F.col("_run")))
        starts = (F.abs(F.col("_run") - F.col("qty")) < tolerance).cast("long")
        return total(rows, "life", starts).drop("_run")

    so_far = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    made = marked(few, lambda rows, name, value: rows.withColumn(name, F.sum(value).over(so_far)))
    if many is None:
        return made
    return made.unionByName(marked(many, lambda rows, name, value: scan.running(rows, {name: value}, CHUNK, order=("seq",))))


def trades(fills: DataFrame, tolerance: float = TOLERANCE, hot: list | None = None) -> DataFrame:
    """One row for each closed lifecycle: side of its first fill, times, gross, fees, net, entry quantity and notional, adds
    (distinct entry orders less one), order ids, win; first_qty and first_price are what was known at entry."""
    rows = positions(fills, tolerance, hot)
    first = F.first("qty").over(Window.partitionBy("symbol", "life").orderBy("seq"))
    entry = F.col("qty") * F.signum(F.col("_first")) > 0
    made = rows.withColumn("_first", first).groupBy("symbol", "life").agg(
        F.when(F.min_by("qty", "seq") > 0, "LONG").otherwise("SHORT").alias("side"), F.min("t").alias("open_t"), F.max("t").alias("close_t"),
        F.sum("realized").alias("gross"), F.sum("commission").alias("fees"), F.count("*").alias("n_fills"),
        F.sum(F.when(entry, F.abs("qty")).otherwise(0.0)).alias("size"), F.sum(F.when(entry, F.abs("qty") * F.col("price")).otherwise(0.0)).alias("notional"),
        (F.countDistinct(F.when(entry, F.col("order_id"))) - 1).alias("dca_count"), F.collect_set("order_id").alias("order_ids"), F.sum("qty").alias("_left"),
        F.abs(F.min_by("qty", "seq")).alias("first_qty"), F.min_by("price", "seq").alias("first_price"),
    )
    net = F.col("gross") - F.col("fees")
    return made.filter(F.abs("_left") < tolerance).drop("_left").withColumn("net", net).withColumn("win", net > 0)


def open_lives(fills: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Lifecycles that end with a position: orphans, where the account is flat."""
    rows = positions(fills, tolerance)
    made = rows.groupBy("symbol", "life").agg(F.sum("qty").alias("left"), F.min("t").alias("open_t"), F.max("t").alias("last_t"), F.count("*").alias("n_fills"))
    return made.filter(F.abs("left") >= tolerance)


def orders(fills: DataFrame) -> DataFrame:
    """Fills of an order (per symbol) as one: quantity, mean price, commission, realised."""
    q = F.abs("qty")
    return fills.groupBy("symbol", "order_id").agg(
        F.sum(q).alias("qty"), (F.sum(F.col("price") * q) / F.sum(q)).alias("avg_price"), F.sum("commission").alias("commission"), F.sum("realized").alias("realized")
    )


def entry_prices(fills: DataFrame) -> DataFrame:
    """Average entry price so far within the lifecycle, and how far an add is from its anchor (the previous fill's
    price; the average entry for the first add)."""
    rows = positions(fills)
    w = Window.partitionBy("symbol", "life").orderBy("seq")
    first = F.first("qty").over(w)
    rows = rows.withColumn("is_entry", F.col("qty") * F.signum(first) > 0)
    q = F.when(F.col("is_entry"), F.abs("qty")).otherwise(0.0)
    rows = rows.withColumn("avg_entry", F.sum(q * F.col("price")).over(w) / F.sum(q).over(w))
    before = F.lag("price").over(w)
    n = F.sum(F.col("is_entry").cast("int")).over(w)
    anchor = F.when(n == 2, F.lag("avg_entry").over(w)).when(n > 2, before)
    away = F.when(first > 0, anchor - F.col("price")).otherwise(F.col("price") - anchor) / anchor
    return rows.withColumn("anchor_distance", F.when(F.col("is_entry"), away))


def running_results(trades: DataFrame, day: int = 86_400_000_000, hot: list | None = None) -> DataFrame:
    """Per symbol, net so far, net of its UTC day so far, and drawdown from the best so far (at least zero). ``hot`` symbols go by
    chunks of time, as all do if it is None."""
    at = {"by": "close_t", "order": ("close_t", "life")}
    rows = trades.withColumn("day", F.floor(F.col("close_t") / F.lit(day)).cast("long"))
    few, many = (None, rows) if hot is None else scan.split_hot(rows, hot)
    so_far = Window.partitionBy("symbol").orderBy("close_t", "life").rowsBetween(Window.unboundedPreceding, 0)

    def marked(rows: DataFrame, total) -> DataFrame:
        rows = total(rows, "cum_net", F.col("net"), "sum")
        rows = rows.withColumn("day_net", F.sum("net").over(Window.partitionBy("symbol", "day").orderBy("close_t", "life")))
        return total(rows, "_best", F.col("cum_net"), "max")

    made = [marked(few, lambda rows, n, v, f: rows.withColumn(n, getattr(F, f)(v).over(so_far)))] if few is not None else []
    made += [marked(many, lambda rows, n, v, f: scan.running(rows, {n: v}, CHUNK, **at, fold=f))] if many is not None else []
    whole = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    return whole.withColumn("drawdown", F.greatest("_best", F.lit(0.0)) - F.col("cum_net")).drop("_best")


def recent_win_rate(trades: DataFrame, n: int, hot: list | None = None, size: int = 65_536) -> DataFrame:
    """Share of wins among the last ``n`` trades before this one; infrastructure exits (P16) are no evidence either way. ``hot`` symbols (counted, if None) go by
    chunks of ``size`` trades that see the ``n`` before them."""
    few, many = scan.split_hot(trades, scan.hot_keys(trades) if hot is None else hot)
    won = F.avg(F.col("win").cast("double"))
    made = few.withColumn("recent_win_rate", won.over(Window.partitionBy("symbol").orderBy("close_t", "life").rowsBetween(-n, -1)))
    if many is None:
        return made
    rows = scan.indexed(many.withColumn("t", F.col("close_t")).withColumn("seq", F.col("life")), CHUNK)
    cut = scan.over_chunks(rows, max(size, n), lambda r, w: r.withColumn("recent_win_rate", won.over(w.rowsBetween(-n, -1))), back=n, by="idx")
    return made.unionByName(cut.drop("t", "seq", "idx"))


def after_cutoff(trades: DataFrame, cutoff: int) -> DataFrame:
    """P10: trades that closed at or after the cutoff."""
    return trades.filter(F.col("close_t") >= cutoff)


def accounting(trades: DataFrame, today: int, day: int = 86_400_000_000) -> DataFrame:
    """Trade count, realised total, today's total; an empty log gives zeros."""
    of_day = F.floor(F.col("close_t") / F.lit(day)) == today
    return trades.agg(
        F.count("*").alias("trade_count"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("realized"), F.coalesce(F.sum(F.when(of_day, F.col("net"))), F.lit(0.0)).alias("today")
    )


def clean_log(log: DataFrame) -> DataFrame:
    """net_pnl (string) as a number: null counts as zero; what is no finite number drops its row."""
    value = F.when(F.col("net_pnl").isNull(), F.lit(0.0)).otherwise(F.col("net_pnl").try_cast("double"))
    return log.withColumn("net", value).filter(F.col("net").isNotNull() & ~F.isnan("net") & (F.abs("net") < float("inf")))


def peak_pnl(ticks: DataFrame, activation: float | None = None) -> DataFrame:
    """The best net so far within a lifecycle; with ``activation``, the best since the lock was armed, which the first tick does whose net reaches it: null before."""
    best = F.max("net").over(Window.partitionBy("symbol", "life").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0))
    # what came before the arming tick lies under the activation, so the best since it is the best of all
    return ticks.withColumn("peak", best if activation is None else F.when(best >= activation, best))


def clamp_step(snapshots: DataFrame, most: int) -> DataFrame:
    """Step capped, and whether adding is therefore blocked."""
    return snapshots.withColumn("add_blocked", F.col("dca_step") >= most).withColumn("dca_step", F.least(F.col("dca_step"), F.lit(most)))


def match_fills(fills: DataFrame, registered: DataFrame) -> DataFrame:
    """Fills with their registered order, whichever came first; matched says whether there is one."""
    return fills.join(registered.dropDuplicates(["order_id"]).withColumn("matched", F.lit(True)), "order_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_once(fills: DataFrame, registered: DataFrame, ttl: int) -> DataFrame:
    """Each order (order_id, order_t) takes one fill (order_id, t, seq): the first that isn't over ``ttl`` older than it. outcome: matched, replayed (the fill
    came first and waited) or dropped (no order in time, or the order had taken another)."""
    once = registered.groupBy("order_id").agg(F.min("order_t").alias("order_t"))
    both = fills.join(once.hint("merge"), "order_id", "left")
    alive = F.coalesce(F.col("t") >= F.col("order_t") - ttl, F.lit(False))
    w = Window.partitionBy("order_id", "_alive").orderBy("t", "seq")
    taken = F.col("_alive") & (F.col("_n") == 1)
    outcome = F.when(~taken, "dropped").when(F.col("t") >= F.col("order_t"), "matched").otherwise("replayed")
    return both.withColumn("_alive", alive).withColumn("_n", F.row_number().over(w)).withColumn("outcome", outcome).drop("_alive", "_n", "order_t")


def account_events(events: DataFrame) -> DataFrame:
    """``events`` (account, held, ...) once for each symbol that their account holds: the symbols are gathered by account and joined, not sent to all."""
    held = events.select("account", F.col("held").alias("symbol")).distinct()
    return events.join(held.hint("merge"), "account")


def algo_outcome(algos: DataFrame, children: DataFrame) -> DataFrame:
    """Conditional orders with their child: FILLED, WORKING, or CANCELLED where one finished without a child."""
    joined = algos.join(children.select(F.col("order_id").alias("actual_order_id"), F.lit(True).alias("_child")).distinct(), "actual_order_id", "left")
    outcome = F.when((F.col("status") == "FINISHED") & F.col("_child"), "FILLED").when(F.col("status") == "FINISHED", "CANCELLED").otherwise("WORKING")
    return joined.withColumn("outcome", outcome).drop("_child")


def resolve(stream: DataFrame, rest: DataFrame) -> DataFrame:
    """One row for each order of two sources: the stream wins; FILLED advances, NEW and PARTIALLY_FILLED wait, else blocked."""
    both = stream.withColumn("source", F.lit("stream")).unionByName(rest.withColumn("source", F.lit("rest")))
    w = Window.partitionBy("order_id").orderBy(F.when(F.col("source") == "stream", 0).otherwise(1))
    one = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    action = F.when(F.col("status") == "FILLED", "ADVANCE").when(F.col("status").isin("NEW", "PARTIALLY_FILLED"), "WAIT").otherwise("BLOCKED")
    return one.withColumn("action", action)


def reconcile(local: DataFrame, exchange: DataFrame, tolerance: float = 1e-6, grace: int = 8_000_000) -> DataFrame:
    """Local and exchange positions (symbol, side, qty, avg_price; local also age) by symbol: SYNCED, LAGGING (differs, within the
    grace), REBUILD (differs), RESET (only local), ADOPT (only the exchange has one)."""
    a, b = local.filter("qty <> 0").alias("l"), exchange.filter("qty <> 0").alias("x")
    both = a.join(b, F.col("l.symbol") == F.col("x.symbol"), "full_outer")
    same = (F.col("l.side") == F.col("x.side")) & (F.abs(F.col("l.qty") - F.col("x.qty")) <= tolerance) & (F.abs(F.col("l.avg_price") - F.col("x.avg_price")) <= tolerance * F.col("x.avg_price"))
    young = F.col("l.age") < grace
    label = (
        F.when(F.col("l.symbol").isNull(), "ADOPT").when(F.col("x.symbol").isNull() & young, "LAGGING").when(F.col("x.symbol").isNull(), "RESET")
        .when(same, "SYNCED").when(young, "LAGGING").otherwise("REBUILD")
    )
    return both.select(F.coalesce("l.symbol", "x.symbol").alias("symbol"), label.alias("verdict"))


def stop_actions(positions: DataFrame, stops: DataFrame) -> DataFrame:
    """What to do with each open stop (owned or not) and with positions without one: ADOPT the first owned stop of an open
    position, CANCEL its others, PLACE one if there is none, CANCEL_STALE owned stops of flat symbols, LEAVE foreign ones. Where the stops of a symbol couldn't be
    listed (column listed of ``positions`` is false), its position is BLOCKed: nothing is placed, adopted or cancelled blind."""
    if "listed" in positions.columns:
        blind = positions.filter(~F.coalesce("listed", F.lit(False)))
        known = stop_actions(positions.filter("listed").drop("listed"), stops.join(blind.select("symbol").hint("merge"), "symbol", "left_anti"))
        return known.unionByName(blind.select("symbol", F.lit(None).cast("long").alias("stop_id"), F.lit("BLOCK").alias("action")))
    rn = F.row_number().over(Window.partitionBy("symbol", "owned").orderBy("stop_id"))
    both = positions.filter("is_open").select("symbol", F.lit(True).alias("open")).join(stops.withColumn("_n", rn).hint("merge"), "symbol", "full_outer")
    has = F.max(F.coalesce("owned", F.lit(False)).cast("int")).over(Window.partitionBy("symbol")) == 1
    both = both.withColumn("_has", has)
    action = (
        F.when(~F.coalesce("owned", F.lit(True)), "LEAVE").when(F.col("stop_id").isNull(), "PLACE").when(F.col("open").isNull(), "CANCEL_STALE")
        .when(F.col("_n") == 1, "ADOPT").otherwise("CANCEL")
    )
    left = both.select("symbol", "stop_id", action.alias("action"))
    place = both.filter("open AND NOT _has AND stop_id IS NOT NULL").select("symbol", F.lit(None).cast("long").alias("stop_id"), F.lit("PLACE").alias("action")).distinct()
    return left.unionByName(place)
