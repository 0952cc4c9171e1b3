"""Scalar functions: column expressions without Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_step(v: Column, step: Column) -> Column:
    """towards zero to a multiple of ``step``, in decimals; a step that isn't positive leaves the value."""
    d = F.abs(v).cast("decimal(28,10)")
    s = F.when(step > 0, step).otherwise(1.0).cast("decimal(28,10)")
    whole = F.floor(d / s).cast("decimal(20,0)")
    return F.when(step > 0, F.signum(v) * (whole * s).cast("double")).otherwise(v)


def clamp(v: Column, lo, hi) -> Column:
    """F2."""
    return F.greatest(col(lo).cast("double"), F.least(col(hi).cast("double"), v))


def safe_div(a: Column, b: Column, default) -> Column:
    """``default`` where the divisor is 0."""
    return F.when(b == 0, col(default)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def signed_qty(qty: Column, is_buyer_maker: Column) -> Column:
    """a buyer who is maker means the taker sold."""
    return F.when(is_buyer_maker, -qty).otherwise(qty)


def gross_pnl(side: Column, entry: Column, exit_: Column, q: Column) -> Column:
    """F4."""
    return F.when(side == "LONG", exit_ - entry).otherwise(entry - exit_) * q


def est_net_pnl(side: Column, entry: Column, price: Column, q: Column, taker: float) -> Column:
    """taker fees on both legs."""
    return gross_pnl(side, entry, price, q) - F.lit(taker) * q * (entry + price)


def executable_net(side: Column, entry: Column, q: Column, bid: Column, ask: Column, fees: Column, taker: float) -> Column:
    """exit at the bid (long) or ask (short), less fees so far (estimated if null) and the exit fee."""
    out = F.when(side == "LONG", bid).otherwise(ask)
    return gross_pnl(side, entry, out, q) - F.coalesce(fees, F.lit(taker) * q * entry) - F.lit(taker) * q * out


def blended_entry(entry: Column, q: Column, add_price: Column, add_q: Column) -> Column:
    return (entry * q + add_price * add_q) / (q + add_q)


def net_after_add(side: Column, entry: Column, q: Column, add_price: Column, add_q: Column, bid: Column, ask: Column, fees: Column, taker: float) -> Column:
    """F6 after adding; the added leg pays a taker fee (ours)."""
    paid = F.coalesce(fees, F.lit(taker) * q * entry) + F.lit(taker) * add_q * add_price
    return executable_net(side, blended_entry(entry, q, add_price, add_q), q + add_q, bid, ask, paid, taker)


def stop_price(side: Column, entry: Column, q: Column, fees: Column, budget: Column, buffer: float, taker: float, tick: float) -> Column:
    """F8: where F6 comes to -(budget - buffer), down to the tick; null without a budget."""
    t = -(budget - buffer)
    raw = F.when(side == "LONG", (t + fees + entry * q) / (q * (1 - taker))).otherwise((entry * q - fees - t) / (q * (1 + taker)))
    return F.when(budget > 0, round_step(raw, F.lit(tick)))


def notional_for_step(base: float, mult: float, step: Column, size_mult: Column, leverage: float) -> Column:
    """step 0 is never scaled."""
    return F.lit(base) * F.pow(F.lit(mult), step) * F.when(step == 0, 1.0).otherwise(size_mult) * leverage


def notional_scaled(frac: Column, floor: Column, notional: Column, override: Column) -> Column:
    """an override that is a number wins."""
    return F.coalesce(override.try_cast("double"), F.greatest(floor, frac * notional))


def net_take_profit(tp: Column, fee: float) -> Column:
    """F11."""
    return F.greatest(F.lit(0.0), tp - fee)


def rr_stop_usd(atr: Column, notional: Column, cap: Column, sl_min: float, round_trip: float, factor: float) -> Column:
    """without volatility the cap."""
    lo = F.greatest(F.lit(sl_min), 1.5 * F.lit(round_trip) * notional)
    return F.when(atr == 0, cap).otherwise(F.least(cap, F.greatest(lo, factor * atr * notional)))


def atr_scaled_tp(base: float, atr: Column, most: float, k: float = 2.5) -> Column:
    """F13."""
    return F.least(F.greatest(F.lit(base), k * atr), F.lit(most))


def dynamic_tp(base: float, most: float, vol: Column, low: float, high: float, closed: Column) -> Column:
    """linear between two volatilities, once five candles closed."""
    share = clamp((vol - low) / (high - low), 0.0, 1.0)
    return F.when(closed >= 5, F.lit(base) + (most - base) * share).otherwise(F.lit(base))


def dca_distance(atr: Column, factor: float = 1.2, lo: float = 0.0015, hi: float = 0.02, fallback: float = 0.002) -> Column:
    """F15."""
    return F.when(atr.isNull() | (atr == 0), fallback).otherwise(clamp(factor * atr, lo, hi))


def adaptive_scale(notional: Column, base: float, regime: Column) -> Column:
    """F16 (our form): the root of base over notional, a tenth up in trends and down sideways, within [0.45, 1.15]."""
    way = F.when(regime == "SIDEWAYS", 0.9).when(regime.endswith("_TREND"), 1.1).otherwise(1.0)
    return clamp(F.sqrt(F.lit(base) / F.greatest(notional, F.lit(base))) * way, 0.45, 1.15)


def size_multiplier(confidence: Column, risk: Column, regime: Column, vol: Column) -> Column:
    """F17 (our weights), within [0.5, 1.5]."""
    return clamp(F.lit(0.6) + 0.8 * confidence - 0.4 * risk + F.when(regime == "STRONG_TREND", 0.1).otherwise(0.0) - 10 * vol, 0.5, 1.5)


def profit_lock_floor(least: float, atr: Column, notional: Column, k: float = 0.25) -> Column:
    """F18."""
    return F.greatest(F.lit(least), k * atr * notional)


def momentum_component(momentum: Column, side: Column, full: float = 0.0015) -> Column:
    """counts only with the side."""
    size = clamp(F.abs(momentum) / full, 0.0, 1.0)
    return F.when(F.signum(momentum) == F.when(side == "LONG", 1.0).otherwise(-1.0), size).otherwise(0.0)


def liquidation(mark: Column, liq: Column) -> tuple[Column, Column]:
    """The liquidation price if plausible (else null), and its distance from the mark."""
    fine = (mark > 0) & (liq > 0) & (liq / mark >= 0.2) & (liq / mark <= 5.0)
    return F.when(fine, liq), F.when(fine, F.abs(mark - liq) / mark)


def ban_until(message: Column, retry_after: Column, now: Column) -> Column:
    """F39, in milliseconds: the later of Retry-After and the time named in the message; a minute on, if neither is there."""
    named = F.regexp_extract(message, r"banned until (\d{10,})", 1).try_cast("bigint")
    waits = now + (retry_after * 1000).cast("bigint")
    return F.coalesce(F.greatest(named, waits), now + 60_000)


def cooled(p: Column, reliable: Column) -> Column:
    """F40."""
    return F.when(reliable, p).otherwise(0.5)
