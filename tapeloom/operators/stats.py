"""Performance statistics, evidence tables, health of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from . import labels, scan


def performance(trades: DataFrame) -> DataFrame:
    """A10: overall, by side, by regime and by symbol group at once: trades, wins, win rate, profit factor (gains by losses, null without
    losses), expectancy (mean net). ``level`` names the grouping."""
    made = trades.groupingSets([[], [F.col("side")], [F.col("regime")], [F.col("bucket")]], F.col("side"), F.col("regime"), F.col("bucket")).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("trades"), F.sum(F.col("win").cast("long")).alias("wins"),
        F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)).alias("_up"), F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0.0)).alias("_down"), F.avg("net").alias("expectancy"),
    )
    level = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "side").when(F.col("_g") == 5, "regime").otherwise("bucket")
    return made.select(
        level.alias("level"), F.coalesce("side", "regime", F.col("bucket").cast("string"), F.lit("all")).alias("value"), "trades", "wins",
        (F.col("wins") / F.col("trades")).alias("win_rate"), F.when(F.col("_down") > 0, F.col("_up") / F.col("_down")).alias("profit_factor"), "expectancy",
    )


def bucket_evidence(rows: DataFrame, p: str = "p", net: str = "net") -> DataFrame:
    """By probability bucket (about 0, below and from a half, about 1): trades, wins, win share, net."""
    bucket = F.when(F.col(p) < 0.05, "~0").when(F.col(p) < 0.5, "<0.5").when(F.col(p) < 0.95, "0.5+").otherwise("~1")
    win = (F.col(net) > 0).cast("long")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("trades"), F.sum(win).alias("wins"), F.avg(win.cast("double")).alias("win_share"), F.sum(net).alias("net"))


def break_even(trades: DataFrame, fee: float) -> DataFrame:
    """The win rate at which trading breaks even: (mean loss + fee) by (mean win + mean loss), fee as a share of mean notional."""
    won, lost = F.avg(F.when(F.col("gross") > 0, F.col("gross"))), F.avg(F.when(F.col("gross") < 0, -F.col("gross")))
    return trades.agg(((lost + fee * F.avg("notional")) / (won + lost)).alias("break_even"), won.alias("avg_win"), lost.alias("avg_loss"))


def head_statistics(labels: DataFrame) -> DataFrame:
    """Per symbol and head: samples, positives, base rate (0 without samples), distinct classes."""
    made = labels.groupBy("symbol", "head").agg(F.count("label").alias("samples"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positives"), F.countDistinct("label").alias("classes"))
    return made.withColumn("base_rate", F.when(F.col("samples") > 0, F.col("positives") / F.col("samples")).otherwise(0.0))


def exit_breakdown(rows: DataFrame) -> DataFrame:
    """A17."""
    return rows.groupBy("exit_reason").agg(F.count("*").alias("trades"), F.avg("hold").alias("avg_hold"), F.sum("net").alias("net"))


def decile_lift(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """By decile of probability (the tenth in which the share of rows with a smaller one lies): rows, outcome rate, lift. Equal
    probabilities share a decile."""
    by = scan.below(rows, p, {"n": F.lit(1), "pos": F.col(y)})
    total = by.agg(F.sum("n").alias("_all"), F.sum("pos").alias("_pos"))
    of = by.crossJoin(F.broadcast(total)).withColumn("decile", F.floor(10 * F.col("below_n") / F.col("_all")).cast("int") + 1)  # one row
    rate = F.sum("pos") / F.sum("n")
    return of.groupBy("decile").agg(F.sum("n").alias("n"), rate.alias("rate"), (rate / (F.first("_pos") / F.first("_all"))).alias("lift"))


def auc(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the curve from counts by probability: pairs won, ties half."""
    by = scan.below(rows, p, {"pos": F.col(y).cast("double"), "neg": (1 - F.col(y)).cast("double")})
    won = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    return by.agg((F.sum(won) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def feed_health(tape: DataFrame, period: int, gap: int, reconnects: DataFrame | None = None) -> DataFrame:
    """Messages, gaps over the limit, the longest gap and reconnects (rows of symbol, t), by symbol and period; a period with
    reconnects alone counts too."""
    made = labels.over_rows(scan.indexed(tape, 86_400_000_000), 4096, lambda r, w: r.withColumn("idle", F.col("t") - F.lag("t").over(w)), back=1)
    slot = F.floor(F.col("t") / F.lit(period)).cast("long").alias("period")
    rows = made.select("symbol", slot, "idle", F.lit(1).alias("message"), F.lit(0).alias("reconnect"))
    if reconnects is not None:
        rows = rows.unionByName(reconnects.select("symbol", slot, F.lit(None).cast("long").alias("idle"), F.lit(0).alias("message"), F.lit(1).alias("reconnect")))
    return rows.groupBy("symbol", "period").agg(
        F.sum("message").alias("messages"), F.sum((F.coalesce("idle", F.lit(0)) > gap).cast("long")).alias("gaps"), F.max("idle").alias("max_gap"), F.sum("reconnect").alias("reconnects")
    )


def let_in(opened: list[int], closed: list[int], taken: list[int], most: int) -> tuple[list[bool], list[int]]:
    """First come, first served over rows in order: who gets a place, and the closing times that are held at the end. ``taken``: those held before."""
    import heapq

    taken, out = list(taken), []
    heapq.heapify(taken)
    for start, end in zip(opened, closed, strict=True):
        while taken and taken[0] <= start:
            heapq.heappop(taken)
        out.append(len(taken) < most)
        if out[-1]:
            heapq.heappush(taken, end)
    return out, sorted(taken)


def admitted(trades: DataFrame, most: int, key: str = "account", hot: list | None = None, chunk: int = 365 * 86_400_000_000) -> DataFrame:
    """K6: ``trades`` (open_t, close_t, symbol, life) with whether each gets one of ``most`` places of its account, first come, first served: a
    place is taken from opening to closing by those let in, and free again at the closing time. Openings are taken by (open_t, symbol, life).
    Accounts go in parallel; within one, rows stream by in order and only the closing times of at most ``most`` open positions are held.
    ``hot`` accounts (counted, if None) are cut into chunks of time as well: see ``_speculated``."""
    rows = trades.select(key, "symbol", "life", "open_t", "close_t")
    few, many = scan.split_hot(rows, scan.hot_keys(rows, key) if hot is None else hot, key)
    schema = f"{key} long, symbol string, life long, admitted boolean"

    def run(batches):
        import pandas as pd

        account, taken = None, []
        for pdf in batches:
            out: list[bool] = []
            for who, part in pdf.groupby((pdf[key] != pdf[key].shift()).cumsum(), sort=False):  # runs of one account
                if part[key].iloc[0] != account:
                    account, taken = part[key].iloc[0], []
                inside, taken = let_in(part["open_t"].tolist(), part["close_t"].tolist(), taken, most)
                out += inside
            yield pd.DataFrame({key: pdf[key], "symbol": pdf["symbol"], "life": pdf["life"], "admitted": out})

    made = few.repartition(key).sortWithinPartitions(key, "open_t", "symbol", "life").mapInPandas(run, schema)
    return made if many is None else made.unionByName(_speculated(many, most, key, schema, chunk))


def _speculated(trades: DataFrame, most: int, key: str, schema: str, chunk: int) -> DataFrame:
    """Admission of accounts with too many rows for one task. All chunks run at once, from an empty book. Then each chunk that would have begun with another
    book than it did, as the chunk before it has ended, runs again, until none does: a chunk forgets how it began once two runs of it hold the same closing
    times, so that what was wrong at its begin seldom reaches its end. The first chunk is right from the start, and with it the next, whatever the rest does."""
    rows = written(trades.withColumn("_chunk", F.floor(F.col("open_t") / F.lit(chunk)).cast("long")), "admission")

    def end(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["open_t", "symbol", "life"])
        _, taken = let_in(pdf["open_t"].tolist(), pdf["close_t"].tolist(), list(pdf["begin"].iloc[0]), most)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_chunk": [pdf["_chunk"].iloc[0]], "end": [taken]})

    def ends(of: DataFrame) -> DataFrame:
        return rows.join(of.hint("merge"), [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(end, f"{key} long, _chunk long, end array<long>")

    chunks = written(rows.groupBy(key, "_chunk").agg(F.min("open_t").alias("first")), "chunks")
    begins = chunks.select(key, "_chunk", F.array().cast("array<long>").alias("begin"))
    known = written(ends(begins).join(begins.hint("merge"), [key, "_chunk"]), "books")
    while True:  # at most as many rounds as an account has chunks; with chunks longer than what is forgotten, two or three
        before = F.lag("end").over(Window.partitionBy(key).orderBy("_chunk"))
        now = known.join(chunks.hint("merge"), [key, "_chunk"]).withColumn("now", F.filter(F.coalesce(before, F.array().cast("array<long>")), lambda x: x > F.col("first")))
        again = written(now.filter(F.col("now") != F.col("begin")).select(key, "_chunk", F.col("now").alias("begin")), "again")
        if again.isEmpty():
            break
        made = ends(again).join(again.hint("merge"), [key, "_chunk"])
        known = written(known.join(again.select(key, "_chunk").hint("merge"), [key, "_chunk"], "left_anti").unionByName(made), "books")

    def mark(pdf):
        pdf = pdf.sort_values(["open_t", "symbol", "life"])
        inside, _ = let_in(pdf["open_t"].tolist(), pdf["close_t"].tolist(), list(pdf["begin"].iloc[0]), most)
        return pdf.assign(admitted=inside)[[key, "symbol", "life", "admitted"]]

    return rows.join(known.select(key, "_chunk", "begin").hint("merge"), [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(mark, schema)


def overlap(trades: DataFrame, most: int) -> DataFrame:
    """K6: times at which more than ``most`` trades are open at once (a trade that closes frees its place first): a sweep over openings and
    closings. Counts of a time are summed first, from one pass over the trades, and written: prefixes go over days and read them twice."""
    ends = F.array(F.struct(F.col("open_t").alias("t"), F.lit(1).alias("d")), F.struct(F.col("close_t").alias("t"), F.lit(-1).alias("d")))
    by = trades.select(F.inline(ends)).groupBy("t").agg(F.sum("d").alias("d"))
    by = written(by.withColumn("day", F.floor(F.col("t") / F.lit(86_400_000_000)).cast("long")), "ends")
    days = by.groupBy("day").agg(F.sum("d").alias("_d"))
    before = days.select("day", F.coalesce(F.sum("_d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = by.join(before.hint("shuffle_hash"), "day")
    open_ = F.col("_before") + F.sum("d").over(Window.partitionBy("day").orderBy("t"))
    return rows.withColumn("open", open_).withColumn("over", F.col("open") > most).select("t", "open", "over")


def decimation(kept: DataFrame, all_: DataFrame, period: int) -> DataFrame:
    """Ticks seen, decisions run and the share skipped, by symbol and period; periods without ticks give no row."""
    at = lambda d, n: d.groupBy("symbol", F.floor(F.col("t") / F.lit(period)).cast("long").alias("period")).agg(F.count("*").alias(n))
    both = at(all_, "ticks").join(at(kept, "decisions").hint("merge"), ["symbol", "period"], "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))
    return both.withColumn("skipped_pct", 100 * (1 - F.col("decisions") / F.col("ticks")))


def pooled(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators: neighbouring blocks (lowest p, highest p, rows, positives) whose rates fall are pooled until rates rise."""
    out: list[tuple[float, float, float, float]] = []
    for block in blocks:
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            low, _, n, pos = out.pop()
            block = (low, block[1], n + block[2], pos + block[3])
        out.append(block)
    return out


def isotonic(rows: DataFrame, p: str = "p", y: str = "y", chunks: int = 64, fan: int = 8) -> DataFrame:
    """M5: low, high, n, pos, rate: the rising fit of the outcome rate over ``p`` (0 to 1), as blocks. Rows are counted by probability; chunks of probabilities pool
    their own, and chunks are merged up a tree, ``fan`` at a time: pooling what is pooled gives what pooling all at once does. Rates that rise strictly are
    few: of n rows some n ** (2 / 3) at most, so what reaches the root is small beside the rows."""
    by = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("low")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("pos"))
    made = by.select("low", F.col("low").alias("high"), "n", "pos", F.least(F.floor(F.col("low") * chunks), F.lit(chunks - 1)).cast("long").alias("node"))

    def pool(pdf):
        import pandas as pd

        pdf = pdf.sort_values("low")
        made = pooled(list(zip(*(pdf[c].tolist() for c in ("low", "high", "n", "pos")), strict=True)))
        return pd.DataFrame(made, columns=["low", "high", "n", "pos"]).assign(node=pdf["node"].iloc[0])

    schema = "low double, high double, n double, pos double, node long"
    while True:
        made = made.groupBy("node").applyInPandas(pool, schema)
        if chunks == 1:
            break
        chunks = -(-chunks // fan)
        made = made.withColumn("node", F.floor(F.col("node") / fan).cast("long"))
    return made.select("low", "high", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), (F.col("pos") / F.col("n")).alias("rate"))


def calibrated(rows: DataFrame, fit: DataFrame, p: str = "p") -> DataFrame:
    """M5: ``rows`` with the rate of the fit's block below or at their probability (the first block, where there is none)."""
    blocks = written(fit.select("low", "rate"), "fit")
    first = blocks.agg(F.min_by("rate", "low")).head()[0]
    edges = blocks.select(F.floor(F.col("low") * 4096).cast("long").alias("_b"), "low", "rate")
    by = written(rows.select(F.col(p).alias("_p")).distinct(), "probabilities").select("_p", F.floor(F.col("_p") * 4096).cast("long").alias("_b"))
    both = by.select("_b", F.col("_p").alias("x"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("rate")).unionByName(edges.select("_b", F.col("low").alias("x"), F.lit(0).alias("side"), "rate"))
    last = both.groupBy("_b").agg(F.max_by("rate", F.when(F.col("side") == 0, F.col("x"))).alias("_last"))
    carried = last.select("_b", F.last("_last", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # 4,096 rows
    inside = F.last("rate", ignorenulls=True).over(Window.partitionBy("_b").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.join(carried.hint("merge"), "_b").withColumn("calibrated", F.coalesce(inside, "_before", F.lit(first))).filter("side = 1").select(F.col("x").alias("_x"), "calibrated")
    return rows.join(found.hint("merge"), F.col(p) == F.col("_x"), "left").drop("_x")


def reliability(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """M5: by bin of probability: rows, mean probability, outcome rate, its gap to the probability, and its distance from the base rate."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    by = rows.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    base = rows.agg(F.avg(F.col(y).cast("double")).alias("base_rate"))  # one row
    return by.crossJoin(F.broadcast(base)).withColumn("gap", F.col("rate") - F.col("mean_p")).withColumn("over_base", F.col("rate") - F.col("base_rate"))
