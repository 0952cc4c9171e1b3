"""Order-dependent operators that run in chunks, against plain loops."""

import heapq
import random

from pyspark.sql import functions as F

from tapeloom.operators import labels, scan, stats
from tapeloom.streaming import streams


def loop(rows, interval, last=None):
    kept = []
    for t, seq in sorted(rows):
        if last is None or t - last >= interval:
            kept.append(seq)
            last = t
    return kept


def test_rate_limit_on_a_busy_tape(spark):
    """180 messages a second and a decision every 250 ms: no pause ever reaches the interval, and chunks are far shorter than the tape."""
    r, rows = random.Random(1), []
    for symbol, rate in (("A", 180), ("B", 70), ("C", 3)):
        t = 1_000_000
        for i in range(4000 if symbol == "A" else 900):
            t += r.choice([0, r.randint(1, 2_000_000 // rate)])
            rows.append((symbol, t, i))
    df = spark.createDataFrame(rows, "symbol string, t long, seq long")
    for interval, start in ((250_000, None), (100_000, {"A": 1_600_000}), (0, None)):
        before = None if start is None else spark.createDataFrame(list(start.items()), "symbol string, last long")
        got = labels.decimate(df, interval, start=before, chunk=1_000_000).groupBy("symbol").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
        for x in got:
            own = [(t, seq) for s, t, seq in rows if s == x["symbol"]]
            assert x["s"] == sorted(loop(own, interval, (start or {}).get(x["symbol"]))), (x["symbol"], interval)
        assert len(got) == 3
    assert labels.decimate(df.limit(0), 250_000).count() == 0


def test_positions_by_chunks(spark):
    r, names = random.Random(2), [e for _, e in streams.MOVES]
    rows = [(s, i, i, r.choice(names)) for s in "AB" for i in range(700)]
    df = spark.createDataFrame(rows + rows[:50], "symbol string, seq long, t long, event string")  # some come twice
    start = spark.createDataFrame([("A", "OPEN", 1, 99)], streams.STATE)
    got = {(x["symbol"], x["seq"]): (x["status"], x["step"]) for x in streams.machine(df, 2, start, chunk=64).collect()}
    for symbol, status, step, seen in (("A", "OPEN", 1, 99), ("B", "FLAT", 0, -1)):
        for s, i, _, event in rows:
            if s == symbol and i > seen:
                status, step = streams.advance(status, step, event, 2)
                assert got.pop((s, i)) == (status, step)
    assert not got


def test_admission_first_come(spark):
    r, rows = random.Random(3), []
    for i in range(600):
        opened = r.randint(0, 3000)
        rows.append((i % 3, f"S{i % 7}", i, opened, opened + r.randint(0, 60)))
    df = spark.createDataFrame(rows, "account long, symbol string, life long, open_t long, close_t long")
    got = {x["life"]: x["admitted"] for x in stats.admitted(df, 2).collect()}
    for account in range(3):
        taken = []
        for _, symbol, life, opened, closed in sorted((x for x in rows if x[0] == account), key=lambda x: (x[3], x[1], x[2])):
            taken = [c for c in taken if c > opened]
            assert got[life] == (len(taken) < 2)
            if got[life]:
                heapq.heappush(taken, closed)
    assert 0 < sum(got.values()) < len(got) == 600


def test_affine_scan_over_many_chunks(spark):
    r = random.Random(4)
    xs = [r.uniform(-5, 5) for _ in range(900)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "symbol string, idx long, x double")
    for factor, seed in ((0.8, None), (0.98, 3.0), (0.5, 0.0)):
        got = [x["y"] for x in scan.affine_scan(df, "x", "y", factor, None if seed is None else F.lit(seed), chunk=7).orderBy("idx").collect()]
        y = seed
        for x, z in zip(xs, got, strict=True):
            y = x if y is None else factor * y + (1 - factor) * x
            assert abs(y - z) < 1e-9
