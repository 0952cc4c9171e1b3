"""Decisive points of rules and state machines, on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import rules, scalars
from tapeloom.operators import candles, labels, ledger, scan, stats
from tapeloom.sources import readers
from tapeloom.streaming import streams


def one(spark, column, **values):
    kinds = {float: "double", str: "string", bool: "boolean", int: "bigint"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items() if v is not None)
    df = spark.createDataFrame([tuple(v for v in values.values() if v is not None)], schema)
    for k, v in values.items():
        if v is None:
            df = df.withColumn(k, F.lit(None).cast("double"))
    return df.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("v,step,want", [(0.3, 0.1, 0.3), (-0.37, 0.1, -0.3), (5.0, 0.0, 5.0), (1.0, 0.3, 0.9)])
def test_round_step(spark, v, step, want):
    assert one(spark, scalars.round_step(F.col("v"), F.col("s")), v=v, s=step) == pytest.approx(want, abs=1e-12)


GUARD = [
    ("LONG", -0.25, 5.0, True, "orderbook_imbalance_against_long"), ("SHORT", 0.25, -5.0, True, "orderbook_imbalance_against_short"),
    ("LONG", 0.1, -1.0, True, "trade_delta_against_long"), ("SHORT", -0.1, 1.0, True, "trade_delta_against_short"),
    ("LONG", 0.0, 1.0, True, "no_orderbook_support"), ("LONG", 0.1, 0.0, True, "flow_delta_not_aligned"),
    ("LONG", 0.5, 5.0, True, None), ("SHORT", -0.5, -5.0, True, None), ("LONG", 0.5, 5.0, False, "orderflow_data_unavailable"), ("FLAT", -0.9, -5.0, True, None),
]


@pytest.mark.parametrize("side,imb,delta,data,reason", GUARD)
def test_flow_guard(spark, side, imb, delta, data, reason):
    c = rules.flow_guard(F.col("s"), F.col("i"), F.col("d"), F.col("a"), F.lit(True), 0.2, 0.0, 0.0, F.lit(True))
    got = one(spark, c, s=side, i=imb, d=delta, a=data)
    assert (got["blocked"], got["reason"], got["confirmed"]) == (reason is not None, reason, reason is None)


def test_stop_price_inverts_the_estimator(spark):
    for side in ("LONG", "SHORT"):
        df = spark.createDataFrame([(side, 82.43, 0.96, 0.0158, 0.5)], "s string, e double, q double, f double, b double")
        stop = scalars.stop_price(F.col("s"), F.col("e"), F.col("q"), F.col("f"), F.col("b"), 0.1, 0.0004, 1e-6)
        df = df.withColumn("p", stop)
        net = scalars.executable_net(F.col("s"), F.col("e"), F.col("q"), F.col("p"), F.col("p"), F.col("f"), 0.0004)
        assert df.select(net.alias("n")).head()["n"] == pytest.approx(-0.4, abs=0.01)


def test_executable_net_of_the_quoted_position(spark):
    c = scalars.executable_net(F.col("s"), F.col("e"), F.col("q"), F.col("b"), F.col("a"), F.col("f"), 0.0002)
    assert one(spark, c, s="LONG", e=82.43, q=0.96, b=82.47, a=82.48, f=0.0158) == pytest.approx(0.0384 - 0.0158 - 0.0002 * 0.96 * 82.47, abs=1e-9)


def test_profit_lock_unfirable(spark):
    got = one(spark, rules.profit_lock(F.col("n"), F.col("p"), F.lit(0.1), F.lit(10.0), F.col("f")), n=0.1, p=0.15, f=0.10)
    assert got["state"] == "UNFIRABLE" and got["required_peak"] == pytest.approx(0.2)


def test_fail_soft_log(spark):
    lines = ["", "null", "[1]", "3", '"s"', '{"net_pnl":', '{"net_pnl": 1.5}', '{"net_pnl": null}']
    kept = readers.trade_log(spark.createDataFrame([(x,) for x in lines], "raw string"))
    assert kept.count() == 2


def test_clean_log(spark):
    df = spark.createDataFrame([(None,), ("1.5",), ("NaN",), ("Infinity",), ("not-a-number",), ("-2",)], "net_pnl string")
    assert sorted(r["net"] for r in ledger.clean_log(df).collect()) == [-2.0, 0.0, 1.5]


def test_decimation_is_not_bucketing(spark):
    rows = [("S", t, i) for i, t in enumerate([0, 200, 260, 400, 520, 900, 1000])]
    df = spark.createDataFrame(rows, "symbol string, t long, seq long")
    assert sorted(r["t"] for r in labels.decimate(df, 250).collect()) == [0, 260, 520, 900]


def test_machine_ignores_repeats_and_caps_adds():
    state = ("FLAT", 0)
    for event in ("ENTRY_SENT", "ENTRY_FILLED", "ENTRY_FILLED", "ADD_SENT", "ADD_FILLED", "ADD_FILLED", "ADD_SENT", "ADD_FILLED"):
        state = streams.advance(*state, event, 1)
    assert state == ("OPEN", 1)
    for event in ("CLOSE_SENT", "CLOSE_FILLED", "CLOSE_FILLED"):
        state = streams.advance(*state, event, 1)
    assert state == ("FLAT", 0)


def test_decimation_batch_equals_stream(spark):
    from tapeloom.plans import registry

    q = registry.queries()
    a = {tuple(r) for r in q["T1_decimated_batch"](spark, "/root/testdata/sf0.001").collect()}
    b = {tuple(r) for r in q["T1_T12_stream_decimated"](spark, "/root/testdata/sf0.001").collect()}
    assert a == b and a


def test_scans_do_not_depend_on_chunks(spark):
    df = spark.range(1000).select(F.lit("S").alias("symbol"), F.col("id").alias("t"), F.col("id").alias("seq"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    for width in (7, 100, 5000):
        got = scan.indexed(df, width).filter("idx <> t").count()
        assert got == 0
        run = scan.running(df, {"s": F.col("x")}, width).orderBy("t").collect()
        total = 0.0
        for r in run:
            total += r["x"]
            assert r["s"] == pytest.approx(total)
    y, want = None, []
    for i in range(1000):
        x = float(i * 37 % 101)
        y = x if y is None else 0.8 * y + 0.2 * x
        want.append(y)
    for chunk in (9, 500):
        made = scan.affine_scan(df.withColumn("idx", F.col("t")), "x", "y", 0.8, chunk=chunk).orderBy("t").collect()
        assert [r["y"] for r in made] == pytest.approx(want)


def test_empty_tables(spark):
    tape = spark.createDataFrame([], "symbol string, t long, seq long, price double, qty int, is_buyer_maker boolean")
    assert candles.candles(tape, 60).count() == 0
    assert labels.decimate(tape, 10).count() == 0
    trades = spark.createDataFrame([], "symbol string, life long, open_t long, close_t long, net double")
    got = ledger.accounting(trades, 1).head()
    assert (got["trade_count"], got["realized"], got["today"]) == (0, 0.0, 0.0)
    assert stats.overlap(trades, 1).count() == 0


def test_break_even_of_the_quoted_inputs():
    assert (0.10 + 0.000732 * 40) / (0.10 + 0.0746) == pytest.approx(0.741, abs=0.01)


def test_symbols_and_algo_fields_in_any_wrapper(spark):
    raw = [
        '{"e":"X","o":{"s":" "},"zz":{"q":1,"symbol":"ethusdt"}}', '{"s":"btc"}', '{"o":{"i":1}}', "[1, 2", '{"a":{"s":"sol"},"s":"no"}',
        '{"w":{"u":{"aid":"7","X":"NEW","S":"BUY","ai":"9","caid":""}}}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    got = df.select("i", readers.event_symbol(F.col("raw")).alias("s"), *readers.algo_fields(F.col("raw"))).orderBy("i").collect()
    assert [r["s"] for r in got] == ["ETHUSDT", "BTC", None, None, "SOL", None]
    assert (got[5]["algo_id"], got[5]["client_algo_id"], got[5]["status"], got[5]["actual_order_id"]) == ("7", "", "NEW", None)
    assert got[3]["algo_id"] is None
