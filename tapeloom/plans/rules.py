"""Queries of scalar functions and rules over inputs derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..params import DEFAULTS as P
from ..sources import adapters
from ..sources.adapters import table
from .base import query

#: Inputs of the rules: one row per event, the same expressions in Spark and in the twins.
INPUTS = {
    "seq": "event_id", "k": "{k}", "side": "CASE WHEN user_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END", "entry": "1e2 + value / 1e1",
    "mark": "(1e2 + value / 1e1) * (1 + ((event_id * 7919) % 701 - 350) / 1e4)", "q": "1e0 + event_id % 20 / 1e1",
    "atr": "(event_id % 50) / 1e4", "imb": "((event_id * 31) % 201 - 100) / 1e2", "delta": "((event_id * 17) % 2001 - 1000) * 1e2",
    "age": "CAST((event_id * 13) % 40000 AS DOUBLE)", "step": "CAST(event_id % 3 AS INTEGER)", "momentum": "((event_id * 13) % 401 - 200) / 1e5",
    "z": "((event_id * 11) % 61) / 1e1 - 2", "p": "((event_id * 37) % 1001) / 1e3", "has_data": "event_id % 9 <> 0",
    "regime": "CASE event_id % 5 WHEN 0 THEN 'SIDEWAYS' WHEN 1 THEN 'WEAK_TREND' WHEN 2 THEN 'STRONG_TREND' WHEN 3 THEN 'HIGH_VOL' ELSE 'LOW_VOL' END",
    "fees": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE (1e2 + value / 1e1) * 5e-4 END", "signals": "CAST(event_id % 7 AS INTEGER)",
}
adapters.SQL["inputs"] = "base AS (SELECT " + ", ".join(f"{e.format(k=adapters_k)} AS {n}" for n, e in INPUTS.items() for adapters_k in ["CAST(json_extract_string(props, '$.k') AS INTEGER)"]) + " FROM events), inputs AS (SELECT *, mark - 0.01 AS bid, mark + 0.01 AS ask, entry * q AS notional FROM base)"
TAKER = P.taker_fee


def inputs(spark, d):
    rows = table(spark, d, "events").selectExpr(*(f"{e.format(k='''CAST(get_json_object(props, '$.k') AS INT)''')} AS {n}" for n, e in INPUTS.items()))
    for name in ("mark", "q", "atr", "imb", "delta", "momentum", "z", "p", "entry", "fees"):
        rows = rows.withColumn(name, F.col(name).cast("double"))
    return rows.withColumn("bid", F.col("mark") - 0.01).withColumn("ask", F.col("mark") + 0.01).withColumn("notional", F.col("entry") * F.col("q"))


C = F.col
GROSS = "CASE WHEN side = 'LONG' THEN {x} - {e} ELSE {e} - {x} END * {q}"
OUT = "CASE WHEN side = 'LONG' THEN bid ELSE ask END"
NET = f"({GROSS.format(x=OUT, e='entry', q='q')} - coalesce(fees, {TAKER} * q * entry) - {TAKER} * q * {OUT})"


def net():
    return S.executable_net(C("side"), C("entry"), C("q"), C("bid"), C("ask"), C("fees"), TAKER)


def rule(name: str, columns: str, sql: str, **made):
    """A query that adds columns to the inputs."""

    @query(name, columns, "inputs", sql=f"SELECT *, {sql} FROM inputs")
    def _(spark, d):
        return inputs(spark, d).withColumns({n: f() for n, f in made.items()})


rule("F1_round_step", "seq|down up_neg none", "trunc(CAST(entry AS DECIMAL(28,10)) / 0.5) * 0.5 AS down, -trunc(CAST(entry AS DECIMAL(28,10)) / 0.5) * 0.5 AS up_neg, entry AS none",
     down=lambda: S.round_step(C("entry"), F.lit(0.5)), up_neg=lambda: S.round_step(-C("entry"), F.lit(0.5)), none=lambda: S.round_step(C("entry"), F.lit(0.0)))
rule("F2_clamp_div", "seq|c d", "greatest(-1.0, least(1.0, z)) AS c, CASE WHEN k = 0 THEN -7.0 ELSE entry / k END AS d",
     c=lambda: S.clamp(C("z"), -1.0, 1.0), d=lambda: S.safe_div(C("entry"), C("k"), -7.0))
rule("F3_signed_qty", "seq|signed", "CASE WHEN side = 'SHORT' THEN -q ELSE q END AS signed", signed=lambda: S.signed_qty(C("q"), C("side") == "SHORT"))
rule("F4_F5_pnl", "seq|gross net", f"{GROSS.format(x='mark', e='entry', q='q')} AS gross, {GROSS.format(x='mark', e='entry', q='q')} - {TAKER} * q * (entry + mark) AS net",
     gross=lambda: S.gross_pnl(C("side"), C("entry"), C("mark"), C("q")), net=lambda: S.est_net_pnl(C("side"), C("entry"), C("mark"), C("q"), TAKER))
rule("F6_executable_net", "seq|net", f"{NET} AS net", net=net)
BLEND = "((entry * q + mark * 2.0) / (q + 2.0))"
rule("F7_net_after_add", "seq|net", f"{GROSS.format(x=OUT, e=BLEND, q='(q + 2.0)')} - (coalesce(fees, {TAKER} * q * entry) + {TAKER} * 2.0 * mark) - {TAKER} * (q + 2.0) * {OUT} AS net",
     net=lambda: S.net_after_add(C("side"), C("entry"), C("q"), C("mark"), F.lit(2.0), C("bid"), C("ask"), C("fees"), TAKER))
RAW = f"CASE WHEN side = 'LONG' THEN (-(z - 0.1) + 0.05 + entry * q) / (q * {1 - TAKER!r}) ELSE (entry * q - 0.05 + (z - 0.1)) / (q * {1 + TAKER!r}) END"
rule("F8_stop_price", "seq|stop", f"CASE WHEN z > 0 THEN CAST(trunc(CAST({RAW} AS DECIMAL(28,10)) / 0.01) AS DOUBLE) * 0.01 END AS stop",
     stop=lambda: S.stop_price(C("side"), C("entry"), C("q"), F.lit(0.05), C("z"), 0.1, TAKER, 0.01))
rule("F9_notional_for_step", "seq|made", "5.0 * pow(1.5, step) * CASE WHEN step = 0 THEN 1.0 ELSE p END * 20 AS made", made=lambda: S.notional_for_step(5.0, 1.5, C("step"), C("p"), 20))
rule("F10_notional_scaled", "seq|made", "CASE WHEN seq % 3 = 0 THEN 12.5 ELSE greatest(0.5, 0.01 * notional) END AS made",
     made=lambda: S.notional_scaled(F.lit(0.01), F.lit(0.5), C("notional"), F.when(C("seq") % 3 == 0, "12.5").when(C("seq") % 3 == 1, "twelve")))
rule("F11_take_profit", "seq|tp activation", f"greatest(0.0, p / 100 - {P.round_trip_fee}) AS tp, 0.65 * greatest(0.0, p / 100 - {P.round_trip_fee}) * notional AS activation",
     tp=lambda: S.net_take_profit(C("p") / 100, P.round_trip_fee), activation=lambda: 0.65 * S.net_take_profit(C("p") / 100, P.round_trip_fee) * C("notional"))
rule("F12_rr_stop", "seq|stop", f"CASE WHEN atr = 0 THEN 0.5 ELSE least(0.5, greatest(greatest(0.05, 1.5 * {P.round_trip_fee} * notional), 1.2 * atr * notional)) END AS stop",
     stop=lambda: S.rr_stop_usd(C("atr"), C("notional"), F.lit(0.5), 0.05, P.round_trip_fee, 1.2))
rule("F13_F14_take_profits", "seq|a b", "least(greatest(0.0035, 2.5 * atr), 0.01) AS a, CASE WHEN k >= 5 THEN 0.0035 + 0.0065 * greatest(0.0, least(1.0, (atr - 0.001) / 0.002)) ELSE 0.0035 END AS b",
     a=lambda: S.atr_scaled_tp(0.0035, C("atr"), 0.01), b=lambda: S.dynamic_tp(0.0035, 0.01, C("atr"), 0.001, 0.003, C("k")))
rule("F15_dca_distance", "seq|far", "CASE WHEN atr = 0 THEN 0.002 ELSE greatest(0.0015, least(0.02, 1.2 * atr)) END AS far", far=lambda: S.dca_distance(C("atr")))
rule("F16_F17_sizes", "seq|a b", "greatest(0.45, least(1.15, sqrt(150.0 / greatest(notional, 150.0)) * CASE WHEN regime = 'SIDEWAYS' THEN 0.9 WHEN regime LIKE '%\\_TREND' ESCAPE '\\' THEN 1.1 ELSE 1.0 END)) AS a, greatest(0.5, least(1.5, 0.6 + 0.8 * p - 0.4 * abs(imb) + CASE WHEN regime = 'STRONG_TREND' THEN 0.1 ELSE 0.0 END - 10 * atr)) AS b",
     a=lambda: S.adaptive_scale(C("notional"), 150.0, C("regime")), b=lambda: S.size_multiplier(C("p"), F.abs("imb"), C("regime"), C("atr")))
rule("F18_lock_floor", "seq|floor_usd", "greatest(0.05, 0.25 * atr * notional) AS floor_usd", floor_usd=lambda: S.profit_lock_floor(0.05, C("atr"), C("notional")))
rule("F19_profit_lock", "seq state|locked required_peak", "CASE WHEN NOT (p * 2 >= 0.5 AND age >= 4) THEN 'OFF' WHEN 0.3 > p THEN 'UNFIRABLE' WHEN z >= 0.3 AND z <= p THEN 'CLOSE' ELSE 'ARMED' END AS state, p AS locked, 0.6 AS required_peak",
     **{n: (lambda n=n: R.profit_lock(C("z"), C("p") * 2, F.lit(0.5), C("age"), F.lit(0.3))[n]) for n in ("state", "locked", "required_peak")})
W = "CASE WHEN side = 'LONG' THEN 1 ELSE -1 END"
REASON = f"""CASE WHEN NOT has_data THEN 'orderflow_data_unavailable' WHEN {W} * imb < -0.2 THEN 'orderbook_imbalance_against_' || lower(side) WHEN {W} * delta < 0 THEN 'trade_delta_against_' || lower(side)
  WHEN NOT ({W} * imb > 0) THEN 'no_orderbook_support' WHEN NOT ({W} * delta > 0) THEN 'flow_delta_not_aligned' END"""
rule("F20_flow_guard", "seq blocked reason", f"{REASON} IS NOT NULL AS blocked, {REASON} AS reason",
     **{n: (lambda n=n: R.flow_guard(C("side"), C("imb"), C("delta"), C("has_data"), F.lit(True), 0.2, 0.0, 0.0, F.lit(True))[n]) for n in ("blocked", "reason")})
rule("F21_supports_reversal", "seq ok", "CASE WHEN NOT has_data THEN false WHEN side = 'LONG' THEN imb > 0.1 ELSE imb < -0.1 END AS ok", ok=lambda: R.supports_reversal(C("side"), C("imb"), C("has_data"), F.lit(True), 0.1, F.lit(True)))
MOM = f"CASE WHEN sign(momentum) = {W} THEN least(1.0, abs(momentum) / 0.0015) ELSE 0.0 END"
rule("F22_momentum", "seq|m", f"{MOM} AS m", m=lambda: S.momentum_component(C("momentum"), C("side")))
rule("F23_F24_entry_score", "seq|score threshold", f"""0.30 * p + 0.20 * abs(imb) + 0.12 * greatest(0.0, least(1.0, z / 2)) + 0.10 * CASE WHEN regime = 'SIDEWAYS' THEN 0.4 ELSE 0.7 END + 0.13 * {MOM} + 0.10 * CASE WHEN regime = 'SIDEWAYS' THEN 0.5 ELSE 0.8 END - 0.05 * 0.3 AS score,
  CASE WHEN regime = 'LOW_VOL' THEN NULL WHEN regime = 'SIDEWAYS' THEN 0.68 ELSE 0.75 END AS threshold""",
     score=lambda: R.entry_score(C("p"), F.abs("imb"), C("z"), F.lit(0.7), C("momentum"), C("side"), F.lit(0.8), F.lit(0.3), C("regime")), threshold=lambda: R.entry_threshold(C("regime")))
rule("F25_F26_momentum_blocks", "seq counter exhausted", f"regime = 'SIDEWAYS' AND {MOM} = 0 AND least(1.0, abs(momentum) / 0.0015) >= 0.5 AS counter, abs(momentum) / 0.0015 >= 1 AND abs(delta) >= 50000 AS exhausted",
     counter=lambda: R.counter_momentum_block(C("regime"), C("momentum"), C("side")), exhausted=lambda: R.momentum_exhausted(C("momentum"), C("delta")))
rule("F27_tp_hit_veto", "seq veto", "has_data AND k * 200 >= 5000 AND 0.4 > 0 AND p < greatest(0.2, 0.1) AS veto", veto=lambda: R.tp_hit_veto(F.lit(True), C("has_data"), C("k") * 200, F.lit(0.4), C("p"), 0.1))
READY = f"has_data AND seq % 6 <> 0 AND {NET} <= -0.1 AND {NET} >= -3.0 AND {W} * imb <= -0.35 AND {W} * delta < 0"
rule("F28_orderflow_exit", "seq verdict", f"CASE WHEN {READY} AND age >= 50 THEN 'EXIT' WHEN {READY} THEN 'SUPPRESSED' END AS verdict", verdict=lambda: R.orderflow_exit(C("side"), C("imb"), C("delta"), C("has_data"), C("seq") % 6 != 0, C("age"), net(), 0.1, 3.0))
rule("F29_max_hold", "seq verdict", f"""CASE WHEN age >= 28800 THEN 'CLOSE' WHEN age < CASE WHEN step >= 1 THEN 7200 ELSE 14400 END THEN NULL WHEN step >= 1 THEN 'CLOSE' WHEN regime LIKE '%TREND' AND {NET} > 0 THEN 'DEFER' WHEN -{NET} / notional < 0.0015 THEN 'CLOSE' WHEN signals >= 2 THEN 'CLOSE' ELSE 'KEEP' END AS verdict""",
     verdict=lambda: R.max_hold(C("age"), C("step"), C("regime").endswith("TREND"), net() > 0, -net() / C("notional"), C("signals")))
HARD = "CASE WHEN side = 'LONG' THEN entry - mark ELSE mark - entry END / entry >= 0.02"
BUDGET = f"seq % 6 <> 0 AND {NET} <= -0.9"
rule("F30_F31_breaches", "seq budget hard", f"{BUDGET} AS budget, {HARD} AS hard", budget=lambda: R.loss_budget_breach(C("seq") % 6 != 0, F.lit(1.0), 0.1, net()), hard=lambda: R.hard_stop_breach(C("side"), C("entry"), C("mark")))
rule("F32_dca_block", "seq reason", "CASE WHEN step >= 2 THEN 'max_steps' WHEN NOT (abs(mark - entry) / entry >= 0.01) THEN 'distance' WHEN seq % 10 = 0 THEN 'blocked' WHEN seq % 11 = 0 THEN 'protection_unknown' WHEN NOT (p > 0.2) THEN 'budget' WHEN age >= 14400 THEN 'held_too_long' WHEN imb < 0.1 THEN 'no_book_support' END AS reason",
     reason=lambda: R.dca_block(C("step"), 2, F.abs(C("mark") - C("entry")) / C("entry") >= 0.01, C("seq") % 10 == 0, C("seq") % 11 != 0, C("p") > 0.2, C("age"), 14_400, C("imb")))


def cascade():
    flow = R.orderflow_exit(C("side"), C("imb"), C("delta"), C("has_data"), C("seq") % 6 != 0, C("age"), net(), 0.1, 3.0) == "EXIT"
    lock = R.profit_lock(C("z"), C("p") * 2, F.lit(0.5), C("age"), F.lit(0.3))["state"] == "CLOSE"
    stop = net() <= -S.rr_stop_usd(C("atr"), C("notional"), F.lit(0.5), 0.05, P.round_trip_fee, 1.2)
    budget = R.loss_budget_breach(C("seq") % 6 != 0, F.lit(1.0), 0.1, net())
    return R.exit_cascade(("hard_stop", R.hard_stop_breach(C("side"), C("entry"), C("mark"))), ("max_trade_net_loss", budget), ("rr_stop_loss", stop), ("orderflow_smart_exit", flow), ("profit_lock", lock))


rule("F33_exit_cascade", "seq exit_reason", f"""CASE WHEN {HARD} THEN 'hard_stop' WHEN {BUDGET} THEN 'max_trade_net_loss' WHEN {NET} <= -CASE WHEN atr = 0 THEN 0.5 ELSE least(0.5, greatest(greatest(0.05, 1.5 * {P.round_trip_fee} * notional), 1.2 * atr * notional)) END THEN 'rr_stop_loss'
  WHEN {READY} AND age >= 50 THEN 'orderflow_smart_exit' WHEN p * 2 >= 0.5 AND age >= 4 AND NOT (0.3 > p) AND z >= 0.3 AND z <= p THEN 'profit_lock' END AS exit_reason""", exit_reason=cascade)  # fmt: skip
rule("F34_smart_exit", "seq leave", f"signals >= CASE WHEN regime IN ('SIDEWAYS', 'WEAK_TREND') THEN 6 ELSE 5 END AND age >= 90 AND -{NET} / notional >= 0.001 AND NOT (step = 1) AS leave", leave=lambda: R.smart_exit(C("signals"), C("regime"), C("age"), -net() / C("notional"), C("step") == 1))
LIQ = "CASE WHEN k % 7 = 0 THEN 0.0 WHEN k % 7 = 1 THEN mark * 6 ELSE mark * (1 - k / 400.0) END"
rule("P9_F36_liquidation", "seq alert|liq distance", f"CASE WHEN {LIQ} > 0 AND {LIQ} / mark >= 0.2 AND {LIQ} / mark <= 5.0 THEN {LIQ} END AS liq, CASE WHEN {LIQ} > 0 AND {LIQ} / mark >= 0.2 AND {LIQ} / mark <= 5.0 THEN abs(mark - {LIQ}) / mark END AS distance, coalesce(CASE WHEN {LIQ} > 0 AND {LIQ} / mark >= 0.2 AND {LIQ} / mark <= 5.0 THEN abs(mark - {LIQ}) / mark END <= 0.15, false) AS alert",
     liq=lambda: S.liquidation(C("mark"), liq_input())[0], distance=lambda: S.liquidation(C("mark"), liq_input())[1], alert=lambda: F.coalesce(S.liquidation(C("mark"), liq_input())[1] <= 0.15, F.lit(False)))


def liq_input():
    return F.when(C("k") % 7 == 0, 0.0).when(C("k") % 7 == 1, C("mark") * 6).otherwise(C("mark") * (1 - C("k") / 400.0))


rule("F39_ban_until", "seq until", "CASE seq % 3 WHEN 0 THEN greatest(1700000000000 + seq, 1700000000000 + k * 1000) WHEN 1 THEN 1700000000000 + k * 1000 ELSE 1700000060000 END AS until",
     until=lambda: S.ban_until(F.when(C("seq") % 3 == 0, F.concat(F.lit("IP banned until "), (F.lit(1_700_000_000_000) + C("seq")).cast("string"))).otherwise("too many"), F.when(C("seq") % 3 != 2, C("k")), F.lit(1_700_000_000_000)))
rule("F40_cooled", "seq|cool", "CASE WHEN has_data THEN p ELSE 0.5 END AS cool", cool=lambda: S.cooled(C("p"), C("has_data")))
rule("F41_F42_targets", "seq|trail target", "CASE WHEN side = 'LONG' THEN mark - 2.0 * atr ELSE mark + 2.0 * atr END AS trail, CASE WHEN step >= 1 THEN 0.0005 * notional ELSE 0.2 END AS target",
     trail=lambda: R.trailing_stop(C("side"), C("mark"), C("atr"), 2.0), target=lambda: R.post_rescue_target(C("step"), C("notional"), F.lit(0.2)))
rule("F43_reward", "seq|reward", f"{NET} / notional - 0.5 * p / notional + 0.1 * CASE WHEN z > 0 THEN greatest(-1.0, least(1.0, {NET} / z)) ELSE 0.0 END AS reward", reward=lambda: R.reward(net(), C("notional"), C("p"), C("z")))
ODD = "CASE seq % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) ELSE z END"
rule("P8_finite", "seq keeps|scored", f"seq % 4 NOT IN (0, 1) AS keeps, CASE seq % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE z END AS scored", keeps=lambda: R.is_finite(odd()), scored=lambda: F.least(R.finite(odd()), F.when(C("seq") % 4 == 1, 1.0).otherwise(R.finite(odd()))))


def odd():
    return F.when(C("seq") % 4 == 0, float("nan")).when(C("seq") % 4 == 1, float("inf")).otherwise(C("z"))
