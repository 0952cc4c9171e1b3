"""Stateful processors: rules whose state goes on from row to row, over micro-batches and restarts.

Each is keyed, holds a few values (or a list that its timers keep short) in the state store, and takes a batch's rows of a key in event order.
Rows of later batches come later: a source that isn't in order of time goes through ``late`` first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .streams import STATUSES, advance


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """``processor`` over ``stream`` by ``key``. Its query is to be started with state kept by RocksDB (``streams.stores``)."""
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time)


def in_order(rows, *by: str) -> pd.DataFrame:
    """A key's rows of a micro-batch (bounded by the source's files of a trigger) in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class Desk(StatefulProcessor):
    """T1 and T2 on one state: order updates move the position's status, and the status of the moment sets the interval between decisions: ``flat`` while
    flat, else ``live``; 0 lets every tick run. The first tick runs. A repeated update (of a seq seen before) changes nothing."""

    SCHEMA = "symbol string, seq long, t long, decision boolean, status string, step int"

    def __init__(self, flat: int, live: int, most: int = 1):
        self.flat, self.live, self.most = flat, live, most

    def init(self, handle) -> None:
        self.state = handle.getValueState("desk", "status string, step int, seen long, last long")

    def handleInputRows(self, key, rows, timerValues):
        status, step, seen, last = self.state.get() if self.state.exists() else (STATUSES[0], 0, None, None)
        out = []
        table = in_order(rows, "t", "seq")
        for t, seq, event in zip(table["t"].tolist(), table["seq"].tolist(), table["event"].tolist(), strict=True):
            if isinstance(event, str):
                if seen is not None and seq <= seen:
                    continue
                seen = seq
                status, step = advance(status, step, event, self.most)
                out.append((key[0], seq, t, False, status, step))
            elif last is None or t - last >= (self.flat if status == STATUSES[0] else self.live):
                last = t
                out.append((key[0], seq, t, True, status, step))
        self.state.update((status, step, seen, last))
        yield pd.DataFrame(out, columns=["symbol", "seq", "t", "decision", "status", "step"])

    def close(self) -> None:
        pass


def desk(stream: DataFrame, flat: int, live: int, most: int = 1) -> DataFrame:
    """``stream`` (symbol, t, seq, event; null for a tick) to its decisions and moves, with status and step after each."""
    return keyed(stream.select("symbol", "t", "seq", "event"), "symbol", Desk(flat, live, most), Desk.SCHEMA)


class Matcher(StatefulProcessor):
    """One order takes one fill, whichever comes first. A fill without an order waits; when its order comes within ``ttl`` microseconds, it is
    replayed, else a timer drops it. A fill of an order that has taken one waits, and is dropped, in the same way. The key is a bucket of orders: a micro-batch costs a
    bucket one read and one write of its state, however many orders it holds, and one timer is set for it."""

    SCHEMA = "order_id long, seq long, outcome string"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        # orders seen, and whether each has taken a fill; waiting fills; and the timer that is set
        self.book = handle.getValueState("book", "orders array<long>, taken array<boolean>, ids array<long>, seqs array<long>, times array<long>, due long")

    def expiry(self, t: int) -> int:
        return -(-(t + self.ttl) // 1000) + 1

    def read(self) -> tuple[dict, dict, int | None]:
        known, waiting = self.book.get(), {}
        if known is None:
            return {}, {}, None
        for order, seq, t in zip(known[2], known[3], known[4], strict=True):
            waiting.setdefault(order, []).append((t, seq))
        return dict(zip(known[0], known[1], strict=True)), waiting, known[5]

    def keep(self, taken: dict, waiting: dict, due: int | None) -> None:
        left = [(order, seq, t) for order, fills in waiting.items() for t, seq in fills]
        first = self.expiry(min(t for _, _, t in left)) if left else None  # the others follow when it is over
        if first is not None and (due is None or first < due):
            if due is not None:
                self.handle.deleteTimer(due)
            due = first
            self.handle.registerTimer(due)
        self.book.update((list(taken), list(taken.values()), *([x[i] for x in left] for i in range(3)), due))

    def handleInputRows(self, key, rows, timerValues):
        taken, waiting, due = self.read()
        out = []
        table = in_order(rows, "t", "kind", "seq")
        for order, t, kind, seq in zip(*(table[c].tolist() for c in ("order_id", "t", "kind", "seq")), strict=True):
            if kind == 0 and order not in taken:  # takes the first fill that still waits
                first = min((x for x in waiting.get(order, ()) if t <= x[0] + self.ttl), default=None)
                taken[order] = first is not None
                if first is not None:
                    waiting[order].remove(first)
                    out.append((order, first[1], "replayed"))
            elif kind == 1 and taken.get(order) is False:
                taken[order] = True
                out.append((order, seq, "matched"))
            elif kind == 1:
                waiting.setdefault(order, []).append((t, seq))
        self.keep(taken, waiting, due)
        yield pd.DataFrame(out, columns=["order_id", "seq", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        taken, waiting, _ = self.read()
        gone = [(order, seq, "dropped") for order, fills in waiting.items() for t, seq in fills if self.expiry(t) <= now]
        self.keep(taken, {order: [x for x in fills if self.expiry(x[0]) > now] for order, fills in waiting.items()}, None)
        yield pd.DataFrame(gone, columns=["order_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def matched_once(stream: DataFrame, ttl: int, delay: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """``stream`` (order_id, ts, kind, seq; kind 0: an order, 1: a fill) to each fill's outcome: matched, replayed (it came before its order) or dropped.
    ``buckets`` of orders are the keys of the state; they stay as they are while a checkpoint lives."""
    rows = stream.withWatermark("ts", delay).select(F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket"), "order_id", "ts", F.unix_micros("ts").alias("t"), "kind", "seq")
    return keyed(rows, "bucket", Matcher(ttl), Matcher.SCHEMA, "EventTime")


class Lateness(StatefulProcessor):
    """A watermark of its own for each key: rows that lie further than ``delay`` behind the newest seen before them, in order of arrival, are late."""

    def __init__(self, delay: int, order: str, columns: list[str]):
        self.delay, self.order, self.columns = delay, order, columns

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "t long")

    def handleInputRows(self, key, rows, timerValues):
        table = in_order(rows, self.order, "seq")
        newest = table["t"].cummax()
        if self.newest.exists():
            newest = newest.clip(lower=self.newest.get()[0])
        self.newest.update((int(newest.iloc[-1]),))
        yield table.assign(late=table["t"] < newest - self.delay)[[*self.columns, "late"]]

    def close(self) -> None:
        pass


def late(stream: DataFrame, delay: int, order: str = "arrival", key: str = "symbol") -> DataFrame:
    """``stream`` (key, t, seq, order, ...) with late. No row is dropped; ``streams.routed`` sends the two kinds to outputs of their own."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return keyed(stream, key, Lateness(delay, order, stream.columns), f"{schema}, late boolean")


class StaleFeed(StatefulProcessor):
    """A feed that falls silent is reported once, ``limit`` milliseconds of processing time after its last tick, whether or not others go on."""

    SCHEMA = "symbol string, t long, alert string"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "t long, due long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(part["t"].max()) for part in rows)
        due = timerValues.getCurrentProcessingTimeInMs() + self.limit
        if self.state.exists():
            before = self.state.get()
            newest = max(newest, before[0])
            self.handle.deleteTimer(before[1])
        self.state.update((newest, due))
        self.handle.registerTimer(due)
        yield pd.DataFrame([], columns=["symbol", "t", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield pd.DataFrame([(key[0], self.state.get()[0], "stale_feed")], columns=["symbol", "t", "alert"])

    def close(self) -> None:
        pass


def stale_feeds(stream: DataFrame, limit: int) -> DataFrame:
    return keyed(stream.select("symbol", F.unix_micros("ts").alias("t")), "symbol", StaleFeed(limit), StaleFeed.SCHEMA, "ProcessingTime")
