"""Tunables of the analytics: one frozen set of values."""

from __future__ import annotations

from dataclasses import dataclass, replace

SECOND = 1_000_000


@dataclass(frozen=True)
class Params:
    """Production defaults. Times are microseconds, shares are fractions."""

    candle: int = 60 * SECOND
    delta_window: int = 10 * SECOND
    imbalance_window: int = 1 * SECOND
    depth_stale: int = 5 * SECOND
    trade_stale: int = 10 * SECOND
    gap: int = 20 * SECOND
    horizon: int = 10
    top_levels: int = 10
    keep_candles: int = 180
    atr_period: int = 14
    ema_fast: int = 9
    ema_mid: int = 21
    ema_slow: int = 55
    atr_ratio_window: int = 30
    take_profit: float = 0.0035
    round_trip_fee: float = 0.000732
    taker_fee: float = 0.0004
    flow_threshold: float = 0.20
    flow_support: float = 0.0
    flow_delta_min: float = 0.0
    dead_market_atr: float = 0.0008
    daily_loss: float = 5.0
    daily_profit: float = 10.0
    win_rate_window: int = 20
    cool_off: int = 15 * 60 * SECOND
    reconnect_cooldown: int = 3 * SECOND
    decision_interval_flat: int = 250_000
    decision_interval_open: int = 100_000
    confirmations: int = 5
    hard_stop: float = 0.02
    atr_stop_factor: float = 1.2
    profit_lock_share: float = 0.5
    max_positions: int = 3


DEFAULTS = Params()
#: The driver's fixture tape is sparse; times are scaled.
FIXTURE = replace(
    DEFAULTS, candle=3600 * SECOND, delta_window=6 * 3600 * SECOND, imbalance_window=3600 * SECOND, depth_stale=3 * 3600 * SECOND,
    trade_stale=3 * 3600 * SECOND, gap=12 * 3600 * SECOND, cool_off=6 * 3600 * SECOND, reconnect_cooldown=600 * SECOND,
    decision_interval_flat=3600 * SECOND, decision_interval_open=1800 * SECOND, max_positions=2,
)
