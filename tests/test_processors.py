"""Stateful processors over micro-batches and restarts, hierarchies, speculation and calibration, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ledger, models, stats, tree
from tapeloom.sources import sinks
from tapeloom.streaming import processors, streams

MS = 1_000


def desk_loop(rows, flat, live, most):
    status, step, seen, last, out = "FLAT", 0, set(), None, []
    for t, seq, event in sorted(rows, key=lambda r: (r[0], r[1])):
        if event is not None:
            if seq not in seen:
                seen.add(seq)
                status, step = streams.advance(status, step, event, most)
                out.append((seq, t, False, status, step))
        elif last is None or t - last >= (flat if status == "FLAT" else live):
            last = t
            out.append((seq, t, True, status, step))
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_desk_goes_on_over_batches(spark, files):
    """180 messages a second; the interval follows the status of the moment, over one batch or five, one of which is repeated."""
    r, rows, names = random.Random(1), [], [e for _, e in streams.MOVES]
    for symbol in "AB":
        t = 1_000_000
        for i in range(1500):
            t += r.choice([0, r.randint(1, 11_000)])
            event = r.choice(names) if i % 30 == 7 else None
            rows += [(symbol, t, i, event)] * (2 if event and i % 60 == 7 else 1)
    stream = streams.replayed(spark.createDataFrame(rows, "symbol string, t long, seq long, event string"), files)
    made = processors.desk(stream, 250 * MS, 100 * MS)
    got = (streams.interrupted(made, 2, rocks=True) if files > 1 else streams.finished(made, rocks=True)).collect()
    for symbol in "AB":
        want = desk_loop([x[1:] for x in rows if x[0] == symbol], 250 * MS, 100 * MS, 1)
        assert sorted(tuple(x)[1:] for x in got if x["symbol"] == symbol) == sorted(want)
    live = [x for x in got if x["decision"] and x["status"] != "FLAT"]
    assert 0 < len(live) < len(got)


def test_a_fill_before_its_order_is_replayed(spark):
    """An early fill waits for its order; an order takes one fill; what no order claims is dropped when its time is up; an order before its fill is the common case."""
    minute = 60_000_000
    rows = [(1, 10, 1, 1), (1, 20, 0, 0), (1, 25, 1, 2), (2, 10, 0, 0), (2, 15, 1, 1), (2, 16, 1, 2), (3, 10, 1, 1), (4, 10, 1, 1), (4, 90, 0, 0), (4, 95, 1, 2), (9, 500, 0, 0)]
    df = spark.createDataFrame([(o, t * minute, k, s) for o, t, k, s in rows], "order_id long, t long, kind int, seq long")
    ttl = 60 * minute
    got = streams.finished(processors.matched_once(streams.replayed(df, 4, at="t"), ttl, "1 minute"), rocks=True).collect()
    want = {(1, 1): "replayed", (1, 2): "dropped", (2, 1): "matched", (2, 2): "dropped", (3, 1): "dropped", (4, 1): "dropped", (4, 2): "matched"}
    assert {(x["order_id"], x["seq"]): x["outcome"] for x in got} == want and len(got) == len(want)
    fills, orders = df.filter("kind = 1").select("order_id", "t", "seq"), df.filter("kind = 0").select("order_id", F.col("t").alias("order_t"))
    assert {(x["order_id"], x["seq"]): x["outcome"] for x in ledger.match_once(fills, orders.unionByName(orders), ttl).collect()} == want


def test_a_silent_feed_is_reported_alone(spark):
    """One symbol: no other feed moves the time on."""
    path = sinks.scratch(spark, "feed")
    spark.createDataFrame([("A", 5_000_000)], "symbol string, t long").write.parquet(path)
    stream = spark.readStream.schema("symbol string, t long").parquet(path).withColumn("ts", F.timestamp_micros("t"))
    out = []
    with streams.stores(spark, True):
        run = processors.stale_feeds(stream, 2_000).writeStream.outputMode("append").option("checkpointLocation", sinks.scratch(spark, "state")).trigger(processingTime="500 milliseconds").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).start()
    until = time.time() + 90
    while not out and time.time() < until:
        time.sleep(0.5)
    run.stop()
    assert out == [("A", 5_000_000, "stale_feed")]


def test_extremes_against_all_ticks(spark):
    r = random.Random(5)
    ticks = [(s, r.randint(0, 2_000), i, float(r.randint(0, 99))) for i in range(700) for s in "AB"]
    spans = [("A" if i % 3 else "B", i, a := r.randint(-50, 2_050), a + r.choice([0, 1, r.randint(0, 900), 3_000])) for i in range(300)] + [("C", 999, 1, 50)]
    t = spark.createDataFrame(ticks, "symbol string, t long, seq long, price double")
    s = spark.createDataFrame(spans, "symbol string, life long, open_t long, close_t long")
    got = {x["life"]: (x["n"], x["least"], x["greatest"]) for x in tree.extremes(s, t, base=3, width=100).collect()}
    for symbol, life, a, b in spans:
        inside = [p for x, at, _, p in ticks if x == symbol and a <= at <= b]
        assert got[life] == (len(inside), min(inside, default=None), max(inside, default=None))
    assert tree.extremes(s.limit(0), t).count() == 0 and tree.extremes(s, t.limit(0)).filter("n = 0").count() == len(spans)


@pytest.mark.parametrize("chunk", [40, 400])
def test_admission_of_a_hot_account_in_chunks(spark, chunk):
    """One account holds half of all rows; chunks shorter and longer than what is forgotten."""
    r, rows = random.Random(chunk), []
    for i in range(900):
        opened = r.randint(0, 4000)
        rows.append((0 if i % 2 else 1 + i % 3, f"S{i % 7}", i, opened, opened + r.choice([0, r.randint(1, 60), r.randint(1, 300)])))
    df = spark.createDataFrame(rows, "account long, symbol string, life long, open_t long, close_t long")
    got = {x["life"]: x["admitted"] for x in stats.admitted(df, 2, hot=[0], chunk=chunk).collect()}
    for account in range(4):
        own = sorted((x for x in rows if x[0] == account), key=lambda x: (x[3], x[1], x[2]))
        want, _ = stats.let_in([x[3] for x in own], [x[4] for x in own], [], 2)
        assert [got.pop(x[2]) for x in own] == want
    assert not got


def test_positions_of_hot_symbols(spark):
    r, rows = random.Random(6), []
    for symbol in "AB":
        left = 0.0
        for i in range(400):
            q = -left if left and r.random() < 0.4 else float(r.choice([-2, -1, 1, 2]))
            left += q
            rows.append((symbol, i, i * 3_600_000_000 * 50, q))
    df = spark.createDataFrame(rows, "symbol string, seq long, t long, qty double")
    plain, cut = (sorted(map(tuple, ledger.positions(df, hot=hot).select("symbol", "seq", "position", "life").collect())) for hot in ([], ["A"]))
    assert plain == cut and len(plain) == 800 and plain[-1][3] > 10


def plain_isotonic(pairs):
    fit = []
    points = sorted({p for p, _ in pairs})
    for p in points:
        mean = lambda a, b: sum(y for x, y in pairs if a <= x <= b) / sum(a <= x <= b for x, _ in pairs)
        fit.append(max(min(mean(a, b) for b in points if b >= p) for a in points if a <= p))
    return dict(zip(points, fit, strict=True))


def test_isotonic_fit_against_the_min_max_formula(spark):
    r = random.Random(7)
    pairs = [(p := r.randint(0, 40) / 40, int(r.random() < 0.2 + 0.6 * p)) for _ in range(250)]
    df = spark.createDataFrame([*pairs, (None, 1), (0.5, None)], "p double, y int")
    want = plain_isotonic(pairs)
    fit = stats.isotonic(df, chunks=16, fan=2)
    blocks = fit.orderBy("low").collect()
    assert all(a["rate"] < b["rate"] and a["high"] < b["low"] for a, b in zip(blocks, blocks[1:], strict=False)) and sum(b["n"] for b in blocks) == 250
    for x in stats.calibrated(df.filter("p IS NOT NULL"), fit).collect():
        assert x["calibrated"] == pytest.approx(want[x["p"]], abs=1e-12)
    assert stats.isotonic(df.limit(0)).count() == 0


def test_stops_that_could_not_be_listed_block(spark):
    positions = spark.createDataFrame([("A", True, False), ("B", True, True), ("C", False, False), ("D", True, None)], "symbol string, is_open boolean, listed boolean")
    stops = spark.createDataFrame([("A", 1, True), ("C", 2, True)], "symbol string, stop_id long, owned boolean")
    got = sorted(map(tuple, ledger.stop_actions(positions, stops).collect()))
    assert got == [("A", None, "BLOCK"), ("B", None, "PLACE"), ("C", None, "BLOCK"), ("D", None, "BLOCK")]


def test_entry_features_know_nothing_later(spark):
    r = random.Random(8)
    ticks = sorted((s, r.randint(0, 10_000), float(i)) for i in range(300) for s in "AB")
    trades = [("A" if i % 2 else "B", i, r.randint(0, 11_000)) for i in range(100)]
    t = spark.createDataFrame(ticks, "symbol string, t long, f double")
    x = spark.createDataFrame(trades, "symbol string, life long, open_t long")
    got = models.entry_features(x, t.withColumn("seen_t", F.col("t")), ["f", "seen_t"], 200).collect()
    assert len(got) == 100
    for row in got:
        before = [a for s, a, _ in ticks if s == row["symbol"] and row["open_t"] - 200 <= a <= row["open_t"]]
        assert row["seen_t"] == max(before, default=None) and (row["f"] is None) == (not before)


def test_rolling_origin_trains_on_what_had_closed(spark):
    r = random.Random(9)
    rows = [(i, a := 100 * i, a + r.choice([50, 5_000, 20_000]), x := r.gauss(0, 1), int(x + r.gauss(0, 0.3) > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "life long, open_t long, close_t long, f double, y int")
    got = models.rolling_origin(df, ["f"], "y", blocks=4).collect()
    by = {}
    for x in got:
        by.setdefault(x["block"], []).append(x)
    assert sorted(by) == [1, 2, 3]
    for part in by.values():
        begin = min(x["open_t"] for x in part)
        assert {x["n_train"] for x in part} == {sum(c < begin for _, _, c, _, _ in rows)} and len({x["life"] for x in part}) == len(part)
    assert sum((x["p"] > 0.5) == x["y"] for x in got) > 0.85 * len(got)


def test_win_rate_of_hot_symbols(spark):
    r = random.Random(10)
    df = spark.createDataFrame([(s, i, i * 10**13, r.random() < 0.5) for s in "AB" for i in range(150)], "symbol string, life long, close_t long, win boolean")
    plain, cut = (sorted(map(tuple, ledger.recent_win_rate(df, 7, hot, 20).select("symbol", "life", "recent_win_rate").collect()), key=str) for hot in ([], ["A"]))
    assert len(plain) == len(cut) == 300 and all(a[:2] == b[:2] and (a[2] == b[2] or abs(a[2] - b[2]) < 1e-12) for a, b in zip(plain, cut, strict=True))
