"""Readers of wire formats: stream envelopes, history records, logs, snapshots. Fail-soft: a bad record never fails a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    return c.try_cast("double")


def field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def envelopes(raw: DataFrame, text: str = "raw") -> DataFrame:
    """With v (the parsed frame) and kind: book_ticker, agg_trade, depth, other, or malformed (for a quarantine)."""
    rows = raw.withColumn("v", F.try_parse_json(F.col(text)))
    stream = field(F.col("v"), "$.stream")
    kind = (
        F.when(stream.isNull(), "malformed").when(stream.endswith("@bookTicker"), "book_ticker").when(stream.endswith("@aggTrade"), "agg_trade")
        .when(stream.contains("@depth"), "depth").otherwise("other")
    )
    return rows.withColumn("kind", kind)


def fan_out(frames: DataFrame, path: str) -> dict[str, int]:
    """Frames (with kind) to a folder for each kind, malformed ones to a quarantine beside them; how many of each, counted as they are written: one scan for all."""
    kinds = ("book_ticker", "agg_trade", "depth", "other", "malformed")
    counts = Observation()
    counted = frames.drop("v").observe(counts, *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    counted.write.partitionBy("kind").parquet(path)
    return counts.get


def book_ticker(frames: DataFrame) -> DataFrame:
    """Missing numbers are 0; rows without bid or ask go."""
    rows = frames.filter("kind = 'book_ticker'")
    for name, path in (("bid", "b"), ("ask", "a"), ("bid_qty", "B"), ("ask_qty", "A")):
        rows = rows.withColumn(name, F.coalesce(number(field(F.col("v"), f"$.data.{path}")), F.lit(0.0)))
    return rows.filter("bid <> 0 AND ask <> 0").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def agg_trades(frames: DataFrame) -> DataFrame:
    """S3: quantity above 0, negative where the buyer is maker."""
    rows = frames.filter("kind = 'agg_trade'").withColumn("qty", number(field(F.col("v"), "$.data.q"))).withColumn("is_buyer_maker", F.coalesce(field(F.col("v"), "$.data.m", "boolean"), F.lit(False)))
    return rows.filter("qty > 0").withColumn("signed_qty", F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")))


def depth(frames: DataFrame) -> DataFrame:
    """B / a, or else bids / asks; frames without either side go. Levels keep their places; bad numbers are null."""
    rows = frames.filter("kind = 'depth'")

    def levels(short: str, long: str) -> Column:
        raw = F.coalesce(field(F.col("v"), f"$.data.{short}", "array<array<string>>"), field(F.col("v"), f"$.data.{long}", "array<array<string>>"))
        return F.transform(raw, lambda e: F.struct(number(F.get(e, F.lit(0))).alias("px"), number(F.get(e, F.lit(1))).alias("qty")))

    rows = rows.withColumn("bids", levels("b", "bids")).withColumn("asks", levels("a", "asks"))
    return rows.filter("coalesce(size(bids), 0) > 0 OR coalesce(size(asks), 0) > 0")


def klines(raw: DataFrame, limit: int, text: str = "raw") -> DataFrame:
    """Twelve-slot arrays, oldest first, at most 1..1500 of the latest: of each symbol, if there is such a column."""
    a = F.from_json(F.col(text), "array<string>")
    rows = raw.withColumn("a", a).filter(F.size("a") == 12)
    at = lambda i, kind="double": F.element_at("a", i).try_cast(kind)
    rest = [c for c in raw.columns if c != text]
    made = rows.select(*rest, at(1, "bigint").alias("open_ms"), at(2).alias("open"), at(3).alias("high"), at(4).alias("low"), at(5).alias("close"), at(6).alias("volume"), at(7, "bigint").alias("close_ms"), at(9, "bigint").alias("n"))
    most = max(1, min(1500, limit))
    if "symbol" in rest:  # a window with a limit: each task passes on no more than the latest of each symbol
        latest_first = Window.partitionBy("symbol").orderBy(F.desc("open_ms"))
        return made.withColumn("_rank", F.row_number().over(latest_first)).filter(F.col("_rank") <= most).drop("_rank").orderBy("symbol", "open_ms")
    return made.orderBy(F.desc("open_ms")).limit(most).orderBy("open_ms")


def fill_history(fills: DataFrame, order_id: int | None = None, from_id: int | None = None, start: int | None = None, page: int = 1000) -> DataFrame:
    """By order, else from an id on, else from a time on; the filter is pushed into the scan."""
    if order_id is not None:
        rows = fills.filter(F.col("order_id") == order_id)
    elif from_id is not None:
        rows = fills.filter(F.col("id") >= from_id)
    else:
        rows = fills.filter(F.col("t") >= (start or 0))
    return rows.orderBy("id").limit(min(page, 1000))


def latest(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


#: Fields of account snapshots: key, time, and what becomes a, b, c.
SNAPSHOTS = {
    "position": ("symbol", "updateTime", ("positionAmt", "entryPrice", "liquidationPrice")), "premium": ("symbol", "time", ("markPrice", "lastFundingRate")),
    "open_interest": ("symbol", "time", ("openInterest",)), "balance": ("asset", "updateTime", ("balance", "availableBalance")),
}


def account_snapshots(raw: DataFrame, kinds: dict[int, str], text: str = "raw") -> DataFrame:
    """Position-risk, premium-index, open-interest and balance responses (seq, k: which, raw), numbers from their strings: the latest of each
    kind and symbol (asset of a balance), as kind, symbol, t, seq, a, b, c."""
    rows = None
    for k, kind in kinds.items():
        key, at, fields = SNAPSHOTS[kind]
        v = F.from_json(F.col(text), f"struct<{key}:string,{at}:bigint,{','.join(f'{f}:string' for f in fields)}>")
        numbers = [v[f].try_cast("double").alias(n) for n, f in zip("abc", fields)] + [F.lit(None).cast("double").alias(n) for n in "abc"[len(fields) :]]
        own = raw.filter(F.col("k") == k).select(F.lit(kind).alias("kind"), v[key].alias("symbol"), v[at].alias("t"), "seq", *numbers).filter("symbol IS NOT NULL")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("kind", "symbol").agg(F.max_by(F.struct("t", "seq", "a", "b", "c"), F.struct("t", "seq")).alias("_r")).select("kind", "symbol", "_r.*")


def symbol_filters(raw: DataFrame, text: str = "raw") -> DataFrame:
    """tick_size, step_size, min_qty, min_notional by symbol; missing ones are 0."""
    kind = "struct<symbol:string,filters:array<struct<filterType:string,tickSize:string,stepSize:string,minQty:string,notional:string>>>"
    rows = raw.select(F.from_json(text, kind).alias("j")).filter("j.symbol IS NOT NULL")

    def pick(of: str, name: str) -> Column:
        return F.coalesce(number(F.get(F.filter("j.filters", lambda f: f["filterType"] == of), F.lit(0))[name]), F.lit(0.0))

    return rows.select(
        F.col("j.symbol").alias("symbol"), pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("LOT_SIZE", "stepSize").alias("step_size"),
        pick("LOT_SIZE", "minQty").alias("min_qty"), pick("MIN_NOTIONAL", "notional").alias("min_notional"),
    )


#: Filters up to which they are broadcast: five short columns each.
FEW = 100_000


def known_filters(symbols: DataFrame, filters: DataFrame) -> DataFrame:
    """Symbols with their filters; an unknown symbol is an error. The filters are broadcast if they are few (counted), else merged."""
    few = filters.limit(FEW + 1).count() <= FEW
    known = filters.withColumn("_known", F.lit(True))
    joined = symbols.join(F.broadcast(known) if few else known.hint("merge"), "symbol", "left")
    return joined.filter(F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("no filters for "), "symbol")).isNull()).drop("_known")


def user_events(raw: DataFrame, text: str = "raw") -> DataFrame:
    """With v and kind: order, algo, account or other."""
    rows = raw.withColumn("v", F.try_parse_json(F.col(text)))
    e = field(F.col("v"), "$.e")
    return rows.withColumn("kind", F.when(e == "ORDER_TRADE_UPDATE", "order").when(e == "ALGO_UPDATE", "algo").when(e == "ACCOUNT_UPDATE", "account").otherwise("other"))


def trade_log(lines: DataFrame, text: str = "raw") -> DataFrame:
    """V of the lines that are JSON objects; blank, broken, null, list, string and number lines go."""
    rows = lines.withColumn("v", F.try_parse_json(F.col(text)))
    return rows.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def additive(*versions: DataFrame) -> DataFrame:
    """Tables of the same log under older and newer headers as one; new columns are null in old rows."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def snapshots(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Snapshots with qty as total_qty (and original_qty) and dca_history as entries where the new names are missing."""
    kind = "struct<status:string,side:string,qty:double,total_qty:double,original_qty:double,avg_entry_price:double,dca_step:int,dca_history:array<array<double>>,entries:array<struct<px:double,qty:double>>>"
    rows = raw.withColumn("j", F.from_json(text, kind))
    entries = F.coalesce(F.col("j.entries"), F.transform("j.dca_history", lambda e: F.struct(F.get(e, F.lit(0)).alias("px"), F.get(e, F.lit(1)).alias("qty"))))
    total = F.coalesce("j.total_qty", "j.qty")
    return rows.select(*[c for c in raw.columns if c != text], "j.status", "j.side", total.alias("total_qty"), F.coalesce("j.original_qty", total).alias("original_qty"), "j.avg_entry_price", "j.dca_step", entries.alias("entries"))


def nested(raw: Column) -> Column:
    """The object values of a JSON object, as JSON texts in their order; null for anything else."""
    return F.filter(F.map_values(F.from_json(raw, "map<string,string>")), lambda x: F.ltrim(x).startswith("{"))


def event_symbol(raw: Column) -> Column:
    """The first non-blank s in o, a or the event itself, else the first nested object that carries s or symbol; upper case; null if
    none is there: a symbol is never guessed."""
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    of = lambda x: F.coalesce(clean(F.get_json_object(x, "$.s")), clean(F.get_json_object(x, "$.symbol")))
    known = [clean(F.get_json_object(raw, p)) for p in ("$.o.s", "$.a.s", "$.s")]
    return F.coalesce(*known, F.get(F.filter(F.transform(nested(raw), of), lambda x: x.isNotNull()), F.lit(0)))


def route(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """With routed: whether the event's symbol is watched. The watchlist is a hand-kept list."""
    return events.join(F.broadcast(watchlist.select("symbol").distinct().withColumn("routed", F.lit(True))), "symbol", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


#: Spellings of the fields of conditional-order events.
ALIASES = {"algo_id": ("algoId", "aid"), "client_algo_id": ("clientAlgoId", "caid"), "status": ("algoStatus", "X"), "actual_order_id": ("actualOrderId", "aoi")}


def algo_fields(raw: Column) -> list[Column]:
    """P5: each field under any of its names, in the event or in objects up to two levels down, whatever wraps them. An empty string stays
    empty. S is the side, never the status; ai is no id."""
    first = nested(raw)
    objects = F.concat(F.array(raw), F.coalesce(first, F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform(first, nested)), F.array().cast("array<string>")))

    def find(name: str) -> Column:
        return F.get(F.filter(F.transform(objects, lambda x: F.get_json_object(x, f"$.{name}")), lambda x: x.isNotNull()), F.lit(0))

    return [F.coalesce(*map(find, names)).alias(out) for out, names in ALIASES.items()]
