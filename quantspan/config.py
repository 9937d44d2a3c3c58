"""Parameters that change a measured result, kept together as frozen dataclasses.

Nothing here is data: each object becomes column literals on the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Instruments of the default universe.
INSTRUMENTS = (
    "EURUSD",
    "GBPUSD",
    "USDJPY",
    "AUDUSD",
    "USDCAD",
    "XAUUSD",
    "SPX500",
    "GER40",
    "JPN225",
)

# Universe name -> symbol used by the candle feed. BRENT keeps its mapping although it
# left the universe.
VENDOR_SYMBOLS = {
    "EURUSD": "EURUSD",
    "GBPUSD": "GBPUSD",
    "USDJPY": "USDJPY",
    "AUDUSD": "AUDUSD",
    "USDCAD": "USDCAD",
    "XAUUSD": "XAUUSD",
    "SPX500": "USA500IDXUSD",
    "GER40": "DEUIDXEUR",
    "JPN225": "JPNIDXJPY",
    "BRENT": "BRENTCMDUSD",
}

# Integer price units per quoted unit; instruments not listed use DEFAULT_POINT.
POINT_SCALES = {
    "EURUSD": 1e5,
    "GBPUSD": 1e5,
    "AUDUSD": 1e5,
    "USDCAD": 1e5,
    "USDJPY": 1e3,
    "XAUUSD": 1e3,
    "SPX500": 1e3,
    "GER40": 1e3,
    "JPN225": 1e3,
    "BRENT": 1e3,
}
DEFAULT_POINT = 1e5

# Header names accepted for the date column and for the close column.
DATE_HEADERS = ("date", "time", "timestamp", "datetime", "gmt time")
PRICE_HEADERS = ("open", "high", "low", "close")
CLOSE_HEADERS = ("close", "Close", "CLOSE", "adj_close", "Adj Close")

ANOMALY_SIGMA = 5.0
TRADING_DAYS_PER_YEAR = 252.0
DAYS_PER_YEAR = 365.25
MAX_GROSS = 4.0
EXPOSURE_TOLERANCE = 1e-9
HOLDOUT_START = dt.date(2023, 8, 17)  # inclusive
EULER_GAMMA = 0.5772156649
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class CostModel:
    """Trading costs as fractions of notional; `swap` is charged per bar held."""

    spread: float = 0.0001
    slippage: float = 0.00005
    impact: float = 0.0
    commission: float = 0.0
    swap: float = 0.00003

    @property
    def rate(self) -> float:
        """Cost per unit of weight traded."""
        return self.spread + self.slippage + self.impact + self.commission


@dataclass(frozen=True)
class BarrierRules:
    """Profit targets and loss limits, as fractions of the initial capital."""

    phase1_target: float = 0.10
    phase2_target: float = 0.05
    daily_loss_limit: float = 0.05
    max_drawdown: float = 0.10
    n_payouts: int = 4
    payout_interval_days: int = 21


@dataclass(frozen=True)
class ResamplingParams:
    """Size of a block bootstrap and the leverage grid evaluated on it."""

    block_size: int = 20
    n_paths: int = 10_000
    horizon_days: int = 756
    seed: int = 12345
    unresolved_threshold: float = 0.05
    leverage_min: float = 0.25
    leverage_max: float = 3.0
    leverage_step: float = 0.25

    def __post_init__(self):
        if self.block_size < 1:
            raise ValueError("block_size must be >= 1")

    @property
    def leverages(self) -> list[float]:
        steps = int((self.leverage_max - self.leverage_min) / self.leverage_step + 0.5)
        return [self.leverage_min + i * self.leverage_step for i in range(steps + 1)]


@dataclass(frozen=True)
class SharpeReference:
    """A published ratio that a gross buy-and-hold run has to land near."""

    instrument: str = "SPX500"
    value: float = 0.80
    tolerance: float = 0.10


@dataclass(frozen=True)
class StudyThresholds:
    """Pre-registered limits of a study; ratios are net and annualised."""

    success: float = 0.4
    falsifier: float = 0.2
    primary_swap_bp: float = 0.3
    swaps_bp: tuple[float, ...] = (0.0, 0.3, 1.0)
    lookbacks: tuple[int, ...] = (12, 6)  # primary first
