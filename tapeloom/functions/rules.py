"""Entry, risk and exit rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, momentum_component


def flow_guard(side: Column, imbalance: Column, delta: Column, available: Column, enabled: Column, thr: float, sup: float, dmin: float, require: Column) -> Column:
    """struct(blocked, reason, confirmed). A null ``available`` means that there is no snapshot. All comparisons are strict."""
    way = F.when(side == "LONG", 1.0).when(side == "SHORT", -1.0)
    with_imb, with_delta = way * imbalance, way * delta
    name = F.lower(side)
    reason = (
        F.when(~enabled | available.isNull() | way.isNull(), None)
        .when(~available & require, "orderflow_data_unavailable")
        .when(~available, None)
        .when(with_imb < -thr, F.concat(F.lit("orderbook_imbalance_against_"), name))
        .when(with_delta < 0, F.concat(F.lit("trade_delta_against_"), name))
        .when(~(with_imb > sup), "no_orderbook_support")
        .when(~(with_delta > dmin), "flow_delta_not_aligned")
    )
    return F.struct(reason.isNotNull().alias("blocked"), reason.alias("reason"), reason.isNull().alias("confirmed"))


def supports_reversal(side: Column, imbalance: Column, available: Column, enabled: Column, sup: float, require: Column) -> Column:
    """F21."""
    return (
        F.when(~enabled | available.isNull() | ~side.isin("LONG", "SHORT"), True)
        .when(~available, ~require)
        .when(side == "LONG", imbalance > sup)
        .otherwise(imbalance < -sup)
    )


def entry_score(brain: Column, trend: Column, z: Column, vol_fit: Column, momentum: Column, side: Column, regime_fit: Column, risk: Column, regime: Column) -> Column:
    """weighted components; sideways markets have fixed fits."""
    sideways = regime == "SIDEWAYS"
    return (
        0.30 * brain + 0.20 * trend + 0.12 * clamp(z / 2, 0.0, 1.0) + 0.10 * F.when(sideways, 0.40).otherwise(vol_fit)
        + 0.13 * momentum_component(momentum, side) + 0.10 * F.when(sideways, 0.50).otherwise(regime_fit) - 0.05 * risk
    )


def entry_threshold(regime: Column) -> Column:
    """null blocks (low volatility)."""
    return F.when(regime == "LOW_VOL", None).when(regime == "SIDEWAYS", 0.68).otherwise(0.75)


def counter_momentum_block(regime: Column, momentum: Column, side: Column) -> Column:
    """F25."""
    size = clamp(F.abs(momentum) / 0.0015, 0.0, 1.0)
    return (regime == "SIDEWAYS") & (momentum_component(momentum, side) == 0) & (size >= 0.5)


def momentum_exhausted(momentum: Column, flow_delta: Column) -> Column:
    """F26."""
    return (F.abs(momentum) / 0.0015 >= 1) & (F.abs(flow_delta) >= 50_000)


def tp_hit_veto(enabled: Column, ready: Column, samples: Column, base: Column, p: Column, min_prob: float, factor: float = 0.5) -> Column:
    """strictly under the larger of half the base rate and a floor, once the head is ready and well fed."""
    return enabled & ready & (samples >= 5000) & (base > 0) & (p < F.greatest(factor * base, F.lit(min_prob)))


def orderflow_exit(side: Column, imbalance: Column, delta: Column, available: Column, synced: Column, age: Column, net: Column, lo: float, hi: float, hold: float = 50.0) -> Column:
    """EXIT, SUPPRESSED (ready but held too briefly), or null."""
    way = F.when(side == "LONG", 1.0).otherwise(-1.0)
    ready = available & synced & (net <= -lo) & (net >= -hi) & (way * imbalance <= -0.35) & (way * delta < 0)
    return F.when(ready & (age >= hold), "EXIT").when(ready, "SUPPRESSED")


def max_hold(age: Column, step: Column, trending: Column, winning: Column, loss_pct: Column, signals: Column, soft: float = 14_400.0, hard: float = 28_800.0) -> Column:
    """CLOSE, DEFER, KEEP; null before the soft limit (halved after an add)."""
    limit = F.when(step >= 1, soft * 0.5).otherwise(soft)
    return (
        F.when(age >= hard, "CLOSE").when(age < limit, None).when(step >= 1, "CLOSE").when(trending & winning, "DEFER")
        .when(loss_pct < 0.0015, "CLOSE").when(signals >= 2, "CLOSE").otherwise("KEEP")
    )


def loss_budget_breach(synced: Column, budget: Column, buffer: float, net: Column) -> Column:
    """F30."""
    return synced & (budget > 0) & (net <= -(budget - buffer))


def hard_stop_breach(side: Column, entry: Column, mark: Column, share: float = 0.02) -> Column:
    """never gated by synchronisation."""
    return F.when(side == "LONG", entry - mark).otherwise(mark - entry) / entry >= share


def dca_block(step: Column, most: int, far: Column, blocked: Column, protected: Column, fits: Column, age: Column, cap: float, support: Column) -> Column:
    """F32: the first reason that forbids adding, or null."""
    return (
        F.when(step >= most, "max_steps").when(~far, "distance").when(blocked, "blocked").when(~protected, "protection_unknown")
        .when(~fits, "budget").when(age >= cap, "held_too_long").when(support < 0.10, "no_book_support")
    )


def exit_cascade(*rules: tuple[str, Column]) -> Column:
    """the name of the first rule that holds."""
    return F.coalesce(*(F.when(holds, name) for name, holds in rules))


def smart_exit(signals: Column, regime: Column, age: Column, loss_pct: Column, near_add: Column) -> Column:
    """five of six signals, all six in weak markets, after 90 s with a loss of 0.10 %, not close to an add."""
    need = F.when(regime.isin("SIDEWAYS", "WEAK_TREND"), 6).otherwise(5)
    return (signals >= need) & (age >= 90) & (loss_pct >= 0.001) & ~near_add


def profit_lock(net: Column, peak: Column, activation: Column, age: Column, floor: Column, share: float = 0.5) -> Column:
    """struct(state, locked, required_peak): OFF, ARMED, UNFIRABLE or CLOSE."""
    locked = share * peak
    armed = (peak >= activation) & (age >= 4)
    state = F.when(~armed, "OFF").when(floor > locked, "UNFIRABLE").when((net >= floor) & (net <= locked), "CLOSE").otherwise("ARMED")
    return F.struct(state.alias("state"), locked.alias("locked"), (floor / share).alias("required_peak"))


def trailing_stop(side: Column, peak_price: Column, atr: Column, k: float = 1.0) -> Column:
    """k true ranges behind the best price."""
    return F.when(side == "LONG", peak_price - k * atr).otherwise(peak_price + k * atr)


def post_rescue_target(step: Column, notional: Column, normal: Column) -> Column:
    """F42."""
    return F.when(step >= 1, 0.0005 * notional).otherwise(normal)


def reward(net: Column, notional: Column, drawdown: Column, mfe: Column) -> Column:
    """F43 (our weights): net share, less half the drawdown's, plus a tenth of the share of the best excursion that was kept."""
    kept = F.when(mfe > 0, clamp(net / mfe, -1.0, 1.0)).otherwise(0.0)
    return net / notional - 0.5 * drawdown / notional + 0.1 * kept


def dead_market(atr_pct: Column, least: float, enabled: bool = True) -> Column:
    """Volatility 0 means warm-up and never blocks."""
    return F.lit(enabled) & (atr_pct > 0) & (atr_pct < least)


def daily_lock(day_net: Column, loss: float, profit: float, continuous: bool) -> Column:
    """The reason that closes the day for entries, or null; a limit that isn't positive is off."""
    if continuous:
        return F.lit(None).cast("string")
    return F.when((F.lit(loss) > 0) & (day_net <= -loss), "loss_limit").when((F.lit(profit) > 0) & (day_net >= profit), "profit_target")


def finite(x: Column) -> Column:
    """P8, scoring: NaN to 0, infinities to the largest double."""
    big = F.lit(1.7976931348623157e308)
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), big).when(x == float("-inf"), -big).otherwise(x)


def is_finite(x: Column) -> Column:
    """P8, training: whether the row stays."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def owned(client_id: Column, prefix: str) -> Column:
    """Strictly the prefix and a dash; null isn't owned."""
    return F.coalesce(client_id.startswith(f"{prefix}-"), F.lit(False))


def protective(client_id: Column, prefix: str, type_: Column, close_position: Column) -> Column:
    """P7."""
    return owned(client_id, prefix) & (type_ == "STOP_MARKET") & F.coalesce(close_position, F.lit(False))


def snapshot_verdict(s: str = "s") -> Column:
    """struct(ok, reason) of a position snapshot (status, side, total_qty, avg_entry_price, dca_step, entries, step_size)."""
    c = lambda n: F.col(f"{s}.{n}")
    entries = F.coalesce(c("entries"), F.array().cast("array<struct<px:double,qty:double>>"))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["qty"])
    clear = c("side").isNull() & (F.coalesce(c("total_qty"), F.lit(0.0)) == 0) & (F.coalesce(c("avg_entry_price"), F.lit(0.0)) == 0) & (F.coalesce(c("dca_step"), F.lit(0)) == 0) & (F.size(entries) == 0)
    reason = (
        F.when(c("status") == "FLAT", F.when(~clear, "flat_with_position"))
        .when(~c("status").isin("OPEN", "DCA_PENDING", "CLOSING"), "unknown_status")
        .when(c("side").isNull() | ~c("side").isin("LONG", "SHORT"), "bad_side")
        .when(~(F.coalesce(c("avg_entry_price"), F.lit(0.0)) > 0), "bad_price")
        .when(~(F.coalesce(c("total_qty"), F.lit(0.0)) > 0), "bad_qty")
        .when(~F.forall(entries, lambda e: (e["px"] > 0) & (e["qty"] > 0)), "bad_entry")
        .when((F.size(entries) > 0) & (F.abs(total - c("total_qty")) > 2 * F.greatest(c("step_size"), F.lit(1e-9))), "entries_do_not_sum")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def readiness(fitted: Column, samples: Column, classes: Column) -> Column:
    """A13."""
    return F.when(~fitted, "WARMING_UP").when((samples >= 20) & (classes >= 2), "READY").otherwise("UNRELIABLE")
