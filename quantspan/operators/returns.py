"""Returns and volatility of instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import DAYS_PER_YEAR, TRADING_DAYS_PER_YEAR
from quantspan.functions.scalars import finite_or_zero, ratio
from quantspan.operators import scans
from quantspan.operators.align import frame_ffill, own_days, price_frame, traded


def observed_bars_per_year(n: Column, first: Column, last: Column) -> Column:
    """Bars per year of a series with `n` bars between two dates; 252 when undefined."""
    years = F.datediff(last, first) / DAYS_PER_YEAR
    return F.when((n >= 2) & (years > 0), n / F.when(years > 0, years)).otherwise(
        F.lit(TRADING_DAYS_PER_YEAR)
    )


def own_calendar_returns(prices: DataFrame) -> DataFrame:
    """Change since the instrument's own previous bar; NULL on its first -> adds own_ret."""
    before = F.lag("close").over(own_days())
    return traded(prices).withColumn("own_ret", ratio(F.col("close"), before) - 1.0)


def traded_day_returns(prices: DataFrame) -> DataFrame:
    """Gap-safe return on the days an instrument traded; every other frame day earns 0.

    The move across a gap lands on the reopening day; an undefined return is 0.
    -> (panel, instrument, dt, ret)
    """
    return own_calendar_returns(prices).select(
        "panel", "instrument", "dt", finite_or_zero(F.col("own_ret")).alias("ret")
    )


def gap_safe_returns(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """`traded_day_returns` spread over the whole frame."""
    before = F.lag("filled").over(own_days())
    return price_frame(prices, calendar).select(
        "panel",
        "instrument",
        "dt",
        F.when(F.col("close").isNull(), F.lit(0.0))
        .otherwise(finite_or_zero(ratio(F.col("filled"), before) - 1.0))
        .alias("ret"),
    )


def own_volatility(
    prices: DataFrame,
    window: int = 63,
    periods_per_year: float | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Annualised rolling deviation of own-day returns, NULL until the window is full.

    Days without a trade take no part, so sparse calendars are not under-estimated.
    The instrument's own observed bars per year annualise it unless a fixed number is
    given (a fixed number also keeps past values untouched when later dates arrive).
    `also` names further window columns over own days to take along. Every frame shares
    one order, so all of it is two passes over one sort.
    -> prices plus (before_dt, own_ret, vol, *also)
    """
    days = own_days()
    rolling = days.rowsBetween(1 - window, 0)
    full = F.count("own_ret").over(rolling) == window
    if periods_per_year is None:
        whole = days.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        # A rise from zero is infinite: a bar of the calendar, but not a usable return.
        counted = F.col("before").isNotNull() & ~((F.col("before") == 0) & (F.col("close") == 0))
        dated = F.when(counted, F.col("dt"))
        per_year = observed_bars_per_year(
            F.count(dated).over(whole), F.min(dated).over(whole), F.max(dated).over(whole)
        )
    else:
        per_year = F.lit(float(periods_per_year))
    lagged = {"before": F.lag("close").over(days), "before_dt": F.lag("dt").over(days)}
    return (
        traded(prices)
        .withColumns({**lagged, **(also or {})})
        .withColumn("own_ret", ratio(F.col("close"), F.col("before")) - 1.0)
        .withColumn(
            "vol", F.when(full, F.stddev_samp("own_ret").over(rolling)) * F.sqrt(per_year)
        )
        .drop("before")
    )


def rolling_vol(
    prices: DataFrame,
    window: int = 63,
    periods_per_year: float | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """`own_volatility` on the frame of the panel, carried over days without a trade.

    In quarters and blocks (`scans`), so one long series is spread over tasks and a row costs the
    same for any window.
    """
    by = ["panel", "instrument"]
    known = traded(prices).select(*by, "dt", "close")
    lagged = scans.lagged(known, by, ["dt"], "close", "before", scans.quarter_of(F.col("dt")))
    moves = lagged.withColumn("own_ret", ratio(F.col("close"), F.col("before")) - 1.0)
    found = scans.rolling_deviation(moves, by, ["dt"], "own_ret", window, "deviation", scans.quarter_of(F.col("dt")))
    if periods_per_year is None:
        counted = F.col("before").isNotNull() & ~((F.col("before") == 0) & (F.col("close") == 0))
        dated = F.when(counted, F.col("dt"))
        years = lagged.groupBy(*by).agg(observed_bars_per_year(F.count(dated), F.min(dated), F.max(dated)).alias("per_year"))
        found = found.join(years, by)
    else:
        found = found.withColumn("per_year", F.lit(float(periods_per_year)))
    own = found.withColumn("vol", F.col("deviation") * F.sqrt("per_year"))
    return frame_ffill(prices, own, "vol", calendar)
