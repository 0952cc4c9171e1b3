"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, scan
from ..sources.sinks import scratch
from ..sources.sinks import written as table_of


#: Files of a micro-batch at most.
FILES = 64


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of ticks with event time ts (a true timestamp: watermarks need one)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file or a folder
    return rows.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))").alias("ts"),
        F.col("event_id").alias("seq"), (F.lit(100.0) + F.col("value") / 10).alias("price"), (F.lit(1) + F.get_json_object("props", "$.k").cast("int")).alias("qty"),
        F.col("event_type").isin("error", "signup").alias("is_buyer_maker"),
    )


#: Rows of a file of a replayed slice, and of a slice, at most (about: slices are cut at approximate quantiles).
FILE_ROWS, SLICE_ROWS = 1_000_000, 2_000_000


def replayed(rows: DataFrame, files: int, by: str = "t", at: str | None = None, most: int | None = None) -> DataFrame:
    """``rows`` as a stream that comes in slices of ``by``, one a micro-batch: a source that is limited in rate, so that what goes from batch to
    batch is used. ``files`` slices, or as many as hold ``most`` rows each, if that is more. A slice is written by many tasks, into the same number of files as any
    other. ``at``: a column of microseconds that becomes the event time ts."""
    spark = rows.sparkSession
    rows = table_of(rows, "rows")
    total = rows.count()
    files = max(files, -(-total // most)) if most else files
    edges = rows.approxQuantile(by, [i / files for i in range(1, files)], 0.1 / files) if files > 1 else []
    edges = F.array(*(F.lit(float(x)) for x in sorted(edges)))
    table, path = scratch(spark, "slices"), scratch(spark, "replay")
    part = F.size(F.filter(edges, lambda x: x < F.col(by))) if files > 1 else F.lit(0)
    rows.withColumn("_slice", part).write.partitionBy("_slice").parquet(table)
    sliced = spark.read.schema(rows.withColumn("_slice", F.lit(0)).schema).parquet(table)
    slices = sorted((r["_slice"], r["count"]) for r in sliced.groupBy("_slice").count().collect())  # a row for each micro-batch
    each = max(1, -(-max((n for _, n in slices), default=0) // FILE_ROWS))
    for i, n in slices or [(0, 0)]:  # a source takes files in the order in which they came
        sliced.filter(F.col("_slice") == i).drop("_slice").repartition(min(each, max(n, 1))).write.mode("append").parquet(f"{path}/n{i:06d}")
        made = len(spark.read.schema(rows.schema).parquet(f"{path}/n{i:06d}").inputFiles())
        for _ in range(each - made):  # so that the next slice begins with the next micro-batch
            rows.limit(0).write.mode("append").parquet(f"{path}/n{i:06d}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", "true").parquet(path)
    return stream if at is None else stream.withColumn("ts", F.timestamp_micros(at))


def interrupted(stream: DataFrame, after: int, rocks: bool = False) -> DataFrame:
    """Runs the stream up to batch ``after``, which fails once its output is written, and starts it again from its checkpoint to its end; all that it put out.
    What was done before the failure isn't done again, and the batch that failed counts once."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n{n}")
        if n == after:
            raise RuntimeError("interrupted")  # after the write, before the commit: the batch is repeated

    def run(f):
        with stores(spark, rocks):
            stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(f).start().awaitTermination()

    try:
        run(put)
    except StreamingQueryException as e:
        if "interrupted" not in str(e):
            raise
    run(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n{n}"))
    return written(spark, stream.schema, out)


def routed(stream: DataFrame, flag: str, rocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs the stream; what ``flag`` doesn't and does mark goes to two outputs, both written by the batch's number."""
    spark = stream.sparkSession
    ways = {False: scratch(spark, "stream"), True: scratch(spark, "late")}

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        for marked, path in ways.items():
            batch.filter(F.col(flag) == marked).drop(flag).write.mode("overwrite").parquet(f"{path}/n{n}")
        batch.unpersist()

    finished(stream, put=put, rocks=rocks)
    return tuple(written(spark, stream.drop(flag).schema, path) for path in ways.values())


def written(spark: SparkSession, schema, path: str) -> DataFrame:
    """What batches left under ``path``, each in a folder of its own."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/none")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


SHUFFLE = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def stores(spark: SparkSession, rocks: bool):
    """While a stream starts, its state is set to be kept by RocksDB, as stateful processors need, in at most two partitions a core (each is a Python worker);
    then the session's own settings hold again."""
    set_ = {PROVIDER: ROCKS, SHUFFLE: str(min(int(spark.conf.get(SHUFFLE)), 2 * spark.sparkContext.defaultParallelism))} if rocks else {}
    before = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def finished(stream: DataFrame, runs: int = 1, put=None, rocks: bool = False) -> DataFrame:
    """Runs the stream in append mode over what is there and returns all that it put out. Each batch writes a folder named by its number, so
    that a batch that is repeated after a failure is not written twice. With more ``runs`` it is started again from its checkpoint (T10): what
    was read before isn't read again."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")

    def plain(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n{n}")

    for _ in range(runs):
        with stores(spark, rocks):
            stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put or plain).start().awaitTermination()
    return written(spark, stream.schema, out)


def scanned(stream: DataFrame, make, result: str, last: str, key: str = "symbol") -> DataFrame:
    """``make(batch, before)`` over the micro-batches: an order-dependent batch operator that goes on from where each key was. It gives result
    rows (schema ``result``) and, by key, what goes into the next batch (schema ``last``). Both are written by the batch's number."""
    spark = stream.sparkSession
    out, states = scratch(spark, "stream"), scratch(spark, "carry")

    def put(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(last).parquet(f"{states}/n{n - 1}") if n else spark.createDataFrame([], last)
        rows, now = make(batch, before)
        rows.write.mode("overwrite").parquet(f"{out}/n{n}")
        now(spark.read.schema(result).parquet(f"{out}/n{n}")).write.mode("overwrite").parquet(f"{states}/n{n}")

    finished(stream, put=put)
    return written(spark, spark.createDataFrame([], result).schema, out)


def micros(c: str) -> F.Column:
    return F.unix_micros(c)


def candles(ticks: DataFrame, width: str) -> DataFrame:
    """Tumbling windows."""
    at, q = F.struct("ts", "seq"), F.col("qty").cast("double")
    made = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum(q).alias("volume"), F.count("*").alias("n")
    )
    return made.select("symbol", micros("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def sliding_delta(ticks: DataFrame, width: str, slide: str) -> DataFrame:
    """T4: signed quantity over sliding windows (range frames don't exist on streams)."""
    signed = F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")).cast("double")
    made = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.sum(signed).alias("delta"))
    return made.select("symbol", micros("w.start").alias("start"), "delta")


def sessions(ticks: DataFrame, gap: str) -> DataFrame:
    """T5: stretches without an outage."""
    made = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select("symbol", micros("w.start").alias("start"), micros("w.end").alias("end"), "n")


def exactly_once(events: DataFrame, key: str, delay: str = "30 days") -> DataFrame:
    """The first of repeated events within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def day_totals(ticks: DataFrame) -> DataFrame:
    """Totals that start anew each UTC day; a day comes out when the watermark has passed it."""
    made = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("qty").cast("double")).alias("volume"))
    return made.select("symbol", F.floor(micros("w.start") / F.lit(86_400_000_000)).cast("long").alias("day"), "n", "volume")


def decimated(ticks: DataFrame, interval: int) -> DataFrame:
    """Greedy rate limit over micro-batches, by the batch operator; a symbol's last decision goes into the next batch."""

    def make(batch, before):
        rows = labels.decimate(batch, interval, start=before)
        return rows, lambda kept: kept.select("symbol", F.col("t").alias("last")).unionByName(before).groupBy("symbol").agg(F.max("last").alias("last"))

    return scanned(ticks.select("symbol", "seq", F.unix_micros("ts").alias("t")), make, "symbol string, seq long, t long", "symbol string, last long")


#: From each status, which events move on, and where to.
MOVES = {
    ("FLAT", "ENTRY_SENT"): "ENTERING", ("ENTERING", "ENTRY_FILLED"): "OPEN", ("ENTERING", "ENTRY_CANCELED"): "FLAT", ("OPEN", "ADD_SENT"): "DCA_PENDING",
    ("DCA_PENDING", "ADD_FILLED"): "OPEN", ("DCA_PENDING", "ADD_CANCELED"): "OPEN", ("OPEN", "CLOSE_SENT"): "CLOSING", ("DCA_PENDING", "CLOSE_SENT"): "CLOSING", ("CLOSING", "CLOSE_FILLED"): "FLAT",
}


def advance(status: str, step: int, event: str, most: int) -> tuple[str, int]:
    """One move of the position machine: events that don't fit the status (repeated, late) change nothing; adds stop at the cap."""
    to = MOVES.get((status, event), status)
    if event == "ADD_SENT" and step >= most:
        return status, step
    if event == "ADD_FILLED" and status == "DCA_PENDING":
        step = min(most, step + 1)
    return (to, 0 if to == "FLAT" else step)


STATUSES = ("FLAT", "ENTERING", "OPEN", "DCA_PENDING", "CLOSING")
STATE = "symbol string, status string, step int, seen long"


def machine(updates: DataFrame, most: int = 1, start: DataFrame | None = None, chunk: int = 10_000) -> DataFrame:
    """Updates (symbol, seq, t, event) with the status and step after each. Repeated seq, and those at or before ``seen`` of ``start``, change
    nothing and are left out. A chunk of updates maps each of the few states to a state; these maps are folded in order, then chunks run
    in parallel from the state that comes in."""
    rows = updates.groupBy("symbol", "seq").agg(F.min_by("event", "t").alias("event"))
    if start is not None:
        rows = rows.join(start.select("symbol", "seen").hint("merge"), "symbol", "left").filter(F.col("seen").isNull() | (F.col("seq") > F.col("seen"))).drop("seen")

    def walk(events, status, step):
        for event in events:
            status, step = advance(status, step, event, most)
            yield status, step

    def summary(pdf):
        import pandas as pd

        events = pdf.sort_values("seq")["event"].tolist()
        ends = [(a, b, *list(walk(events, a, b))[-1]) for a in STATUSES for b in range(most + 1)]
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["_chunk"].iloc[0], *e) for e in ends], columns=["symbol", "_chunk", "a", "b", "c", "d"])

    def fold(pdf):
        import pandas as pd

        known = "status" in pdf and not pd.isna(pdf["status"].iloc[0])
        now, out = (pdf["status"].iloc[0], int(pdf["step"].iloc[0])) if known else ("FLAT", 0), []
        for part, maps in pdf.groupby("_chunk", sort=True):
            out.append((pdf["symbol"].iloc[0], part, *now))
            now = {(a, int(b)): (c, int(d)) for a, b, c, d in zip(maps["a"], maps["b"], maps["c"], maps["d"], strict=True)}[now]
        return pd.DataFrame(out, columns=["symbol", "_chunk", "status", "step"])

    def mark(pdf):
        pdf = pdf.sort_values("seq")
        states = list(walk(pdf["event"].tolist(), pdf["status"].iloc[0], int(pdf["step"].iloc[0])))
        return pdf.assign(status=[x for x, _ in states], step=[x for _, x in states])[["symbol", "seq", "event", "status", "step"]]

    part = F.floor(F.col("seq") / F.lit(chunk)).cast("long")
    return scan.carried(rows, part, summary, "a string, b int, c string, d int", fold, "status string, step int", mark, "symbol string, seq long, event string, status string, step int", start=start)


def position_states(updates: DataFrame, most: int = 1) -> DataFrame:
    """T2 over micro-batches, by the batch operator; a symbol's state goes into the next batch."""

    def make(batch, before):
        def now(made):
            ends = made.groupBy("symbol").agg(F.max_by("status", "seq").alias("status"), F.max_by("step", "seq").alias("step"), F.max("seq").alias("seen"))
            return ends.unionByName(before.join(ends.select("symbol").hint("merge"), "symbol", "left_anti"))

        return machine(batch, most, before), now

    return scanned(updates, make, "symbol string, seq long, event string, status string, step int", STATE)


def matched_fills(fills: DataFrame, orders: DataFrame, ttl: str) -> DataFrame:
    """Fills with their order, whichever comes first; fills whose order doesn't come within ``ttl`` come out unmatched."""
    f = fills.withWatermark("ts", ttl).alias("f")
    o = orders.withWatermark("order_ts", ttl).alias("o")
    near = F.expr(f"f.order_id = o.order_id AND o.order_ts BETWEEN f.ts - INTERVAL {ttl} AND f.ts + INTERVAL {ttl}")
    return f.join(o, near, "leftOuter").select(F.col("f.order_id").alias("order_id"), F.col("f.seq").alias("seq"), F.col("o.order_id").isNotNull().alias("matched"))


def liquidation_alerts(ticks: DataFrame, liquidation: float, band: float) -> DataFrame:
    """Ticks of a long position within ``band`` (a share of the price) of its liquidation price, or past it."""
    near = (F.col("price") - liquidation) / F.col("price") <= band
    return ticks.filter(near).select("symbol", micros("ts").alias("t"), F.lit("liquidation").alias("alert"))


def stale_alerts(ticks: DataFrame, limit: str) -> DataFrame:
    """Where a feed fell silent for longer than ``limit``: the end of each session, once the watermark has passed it."""
    return sessions(ticks, limit).select("symbol", F.col("end").alias("t"), F.lit("stale_feed").alias("alert"))


def unprotected_alerts(openings: DataFrame, stops: DataFrame, limit: str) -> DataFrame:
    """Positions (symbol, life, ts) for which no stop (life, stop_ts) came within ``limit``, once the watermark has passed it."""
    o, p = openings.withWatermark("ts", "1 hour").alias("o"), stops.withWatermark("stop_ts", "1 hour").alias("p")
    near = F.expr(f"o.life = p.life AND p.stop_ts BETWEEN o.ts AND o.ts + INTERVAL {limit}")
    made = o.join(p, near, "leftOuter").filter("p.life IS NULL")
    return made.select(F.col("o.symbol").alias("symbol"), micros("o.ts").alias("t"), F.lit("unprotected").alias("alert"))
