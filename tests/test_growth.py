"""Operators whose work must not grow faster than their rows: dense windows and long spans, against plain loops."""

import random
import threading

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tapeloom.operators import models, orderflow, stats, tree
from tapeloom.sources import adapters
from tapeloom.streaming import processors, streams


def test_first_hits_of_long_spans_meet_two_chunks(spark):
    """Every span covers most of the tape; what joins spans with ticks would make 4,000 rows for each."""
    r = random.Random(11)
    ticks = [(s, t, 100.0 + r.randint(-400, 400) / 100) for s in "AB" for t in range(0, 20_000, 5)]
    rows = [(r.choice("AB"), i, r.choice(["LONG", "SHORT"]), r.choice([a := r.randint(0, 3_000), 19_000]), a + r.choice([0, 4, 16_000]), r.choice([90.0, 96.6, 100.0, 103.4, 110.0])) for i in range(200)]
    t = spark.createDataFrame([*ticks, ("A", 7, None)], "symbol string, t long, price double")
    x = spark.createDataFrame([*rows, ("A", 900, "LONG", 0, 9, None), ("C", 901, "LONG", 0, 9, 200.0), ("A", 902, "LONG", None, 9, 200.0)], "symbol string, life long, side string, open_t long, close_t long, liquidation double")
    got = {a["life"]: a["t"] for a in tree.liquidation_alerts(x, t, 0.005, width=700).collect()}
    want = {}
    for symbol, life, side, a, b, liquidation in rows:
        hits = [at for s, at, p in ticks if s == symbol and a <= at <= b and (p * (1 - 0.005) <= liquidation if side == "LONG" else p * (1 + 0.005) >= liquidation)]
        if hits:
            want[life] = min(hits)
    assert got == want
    assert 20 < len(want) < 180
    found = {a["life"]: (a["n"], a["least"], a["greatest"]) for a in tree.extremes(x, t, width=700).collect()}
    for symbol, life, _, a, b, _ in rows:
        inside = [p for s, at, p in ticks if s == symbol and a <= at <= b]
        assert found[life] == (len(inside), min(inside, default=None), max(inside, default=None))
    assert {k: v for k, v in found.items() if k >= 901} == {901: (0, None, None), 902: (0, None, None)} and found[900][0] == 2  # the tick without a price doesn't count


def test_no_span_is_joined_with_its_ticks(spark, monkeypatch):
    from tapeloom.operators import joins

    monkeypatch.setattr(joins, "interval", None)
    t = spark.createDataFrame([("A", i, 100.0 - i) for i in range(50)], "symbol string, t long, price double")
    x = spark.createDataFrame([("A", 1, "LONG", 3, 40, 90.0)], "symbol string, life long, side string, open_t long, close_t long, liquidation double")
    assert [a["t"] for a in tree.liquidation_alerts(x, t, 0.0).collect()] == [10]


def test_windows_of_time_are_not_summed_anew(spark):
    """Dense ticks, ends of windows and equal times, against plain loops; no sliding frame is left in the plan."""
    r = random.Random(12)
    rows = [(s, r.randint(0, 900), i, r.randint(1, 9), r.random() < 0.5) for i in range(1_500) for s in "AB"]
    t = spark.createDataFrame(rows, "symbol string, t long, seq long, qty int, is_buyer_maker boolean")
    made = orderflow.rolling_delta(t, 60)
    assert {x["seq"]: x["delta"] for x in made.filter("symbol = 'A'").collect()} == {i: sum(-q if m else q for s, u, _, q, m in rows if s == "A" and at - 60 <= u <= at) for sy, at, i, _, _ in rows if sy == "A"}
    frames = [(s, r.randint(0, 300) * 3, i, r.uniform(-1, 1)) for i in range(40) for s in "ABC"]
    f = spark.createDataFrame(frames, "symbol string, t long, seq long, imbalance double")
    at = orderflow.imbalance_at(t, f, 20, 90, 50)
    for x in at.collect():
        own = sorted((u, i, v) for s, u, i, v in frames if s == x["symbol"] and x["t"] - 90 <= u <= x["t"])
        inside = [v for u, _, v in own if u >= x["t"] - 20]
        assert abs(x["avg_imbalance"] - (sum(inside) / len(inside) if inside else own[-1][2] if own else 0.0)) < 1e-12
    means = {(x["symbol"], x["seq"]): x["avg_imbalance"] for x in orderflow.average_imbalance(f, 100).collect()}
    for s, u, i, _ in frames:
        inside = [v for s2, u2, _, v in frames if s2 == s and u - 100 <= u2 <= u]
        assert abs(means[s, i] - sum(inside) / len(inside)) < 1e-12
    for df in (made, at, orderflow.average_imbalance(f, 100)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, unboundedpreceding" in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def test_a_bucket_of_orders_costs_one_read_and_one_write(spark):
    class Handle:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    h, m = Handle(), processors.Matcher(60_000)
    m.init(h)
    rows = pd.DataFrame([(o, 1_000 * o + k, k, o) for o in range(300) for k in (0, 1)] + [(900, 5_000, 1, 7), (901, 1_000, 1, 8)], columns=["order_id", "t", "kind", "seq"])
    out = pd.concat(m.handleInputRows((0,), iter([rows]), None))
    assert h.calls == ["get", "update"] and len(out) == 300 and set(out["outcome"]) == {"matched"} and h.timers == {62}
    late = pd.DataFrame([(900, 6_000, 0, 0), (902, 500, 1, 9)], columns=["order_id", "t", "kind", "seq"])
    assert pd.concat(m.handleInputRows((0,), iter([late]), None)).values.tolist() == [[900, 7, "replayed"]] and h.timers == {62}


def test_a_large_slice_is_many_files_and_one_batch(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    df = spark.createDataFrame([(i % 5, i) for i in range(1_000)], "k int, t long").repartition(7)
    stream = streams.replayed(df, 3, most=250)  # four slices of seven files, whatever the three
    batches = {}
    streams.finished(stream, put=lambda b, n: batches.update({n: sorted(x["t"] for x in b.collect())}))
    rows = [x for n in sorted(batches) for x in batches[n]]
    assert len(batches) == 4 and rows == list(range(1_000))


def test_heads_score_without_their_models(spark):
    """The same numbers as the fitted pipeline's own transform; no Python or ML function is left in the plan, however many heads there are."""
    r = random.Random(13)
    df = spark.createDataFrame([(x := r.gauss(3, 2), y := r.gauss(0, 9), 1.5, int(x + y / 9 > 3), 0.2 * x - y) for _ in range(300)], "a double, b double, c double, y int, z double")
    scored, plain = df, df
    for label, kind in (("y", "logistic"), ("z", "squaredError"), ("z", "huber")):
        model = models.fit_head(df, ["a", "b", "c"], label, kind, 1e-3)
        scored = models.score(model, scored, out=f"p_{kind}")
        made = model.transform(plain)
        p = vector_to_array("probability")[1] if kind == "logistic" else F.col("prediction")
        plain = made.select(*plain.columns, p.alias(f"p_{kind}"))
    for a, b in zip(scored.orderBy("a").collect(), plain.orderBy("a").collect(), strict=True):
        assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    assert "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_fills_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    assert adapters.fills(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 12


def test_overlap_computes_its_trades_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    r = random.Random(14)
    rows = [(a := r.randint(0, 400) * 10**10, a + r.randint(0, 30) * 10**10) for _ in range(300)]
    t = spark.createDataFrame(rows, "open_t long, close_t long")
    got = {x["t"]: (x["open"], x["over"]) for x in stats.overlap(t.mapInPandas(counted, t.schema), 12).collect()}
    assert got == {at: (n := sum(a <= at for a, _ in rows) - sum(b <= at for _, b in rows), n > 12) for at in {x for row in rows for x in row}}
    assert seen.value == 300


def test_fills_are_sorted_once(spark):
    """Number, opening quantity and cash come from one order; nulls are left out of the sums as before."""
    plan = adapters.fills(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line for line in plan.splitlines()) == 1
    x = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None), (None, None)], "a double, b double")
    assert [y[0] for y in x.select(adapters.added("a", "b")).collect()] == [3.0, 2.0, 1.0, None]


def test_hot_symbols_are_counted_by_part(spark, monkeypatch):
    lines = spark.createDataFrame([(7,)] * 40 + [(i,) for i in range(100, 160)] + [(None,)] * 50, "l_partkey long")
    monkeypatch.setattr(adapters, "table", lambda *_: lines)
    monkeypatch.setattr(adapters.scan.hot_keys, "__defaults__", ("symbol", 5, 10))
    assert adapters.hot_symbols(spark, "") == ["P7"]


def test_rolling_origin_counts_in_one_pass_and_fits_at_once(spark, monkeypatch):
    """Besides the fits, rows are read for the edges and for the counts, however many blocks there are; and a fit doesn't wait for another's end."""
    read, together, fit = spark.sparkContext.accumulator(0), threading.Barrier(4, timeout=60), models.fit_head
    r = random.Random(15)
    rows = [(100 * i, 100 * i + r.choice([50, 5_000]), r.gauss(0, 1), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "open_t long, close_t long, f double, y int")

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    def waiting(known, *rest):
        together.wait()
        return fit(df.filter("close_t < 9000"), *rest)

    monkeypatch.setattr(models, "fit_head", waiting)
    made = models.rolling_origin(df.mapInPandas(counted, df.schema), ["f"], "y")
    assert read.value == 800
    for x in made.groupBy("block", "n_train").agg(F.min("open_t").alias("begin")).collect():
        assert x["n_train"] == sum(c < x["begin"] for _, c, _, _ in rows)


def test_rolling_origin_of_no_rows_and_of_one_outcome(spark):
    schema = "open_t long, close_t long, f double, y int"
    none = models.rolling_origin(spark.createDataFrame([], schema), ["f"], "y")
    assert none.count() == 0 and none.columns == ["open_t", "close_t", "f", "y", "p", "block", "n_train"]
    one = models.rolling_origin(spark.createDataFrame([(i, i, 0.1 * i, 1) for i in range(50)], schema), ["f"], "y")
    assert {x["p"] for x in one.collect()} == {0.5} and one.columns == none.columns
