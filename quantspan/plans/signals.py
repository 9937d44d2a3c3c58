"""Signals: prices -> target weights.

A signal is any `Callable[[DataFrame, ...], DataFrame]` taking prices(panel, instrument,
dt, close) and returning weights(panel, instrument, dt, w), used with `prices.transform`.
Weights may be sparse: a missing cell is a flat position (`align.align_weights` writes the
zeros out).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import MAX_GROSS
from quantspan.functions.scalars import direction_sign, hashed_draw, ratio
from quantspan.operators.align import own_days, past_close, price_frame
from quantspan.operators.calendars import frame_calendar, rebalance_calendar
from quantspan.operators.returns import gap_safe_returns, observed_bars_per_year, own_volatility
from quantspan.session import materialize


class Signal(Protocol):
    """A weight may depend on nothing after its own date: see `signal_contract`."""

    def __call__(self, prices: DataFrame, **params) -> DataFrame: ...


def cut_dates(prices: DataFrame, n_cuts: int = 3, seed: int = 12345) -> DataFrame:
    """Hashed frame dates in the later half of each panel, never its last -> (panel, cut, last_dt)

    A panel needs three dates to be cut.
    """
    calendar = frame_calendar(prices)
    half = F.floor(F.col("n_dates") / 2)
    at = half + hashed_draw(F.col("n_dates") - half - 1, F.lit(seed), F.col("panel"), F.col("cut"))
    cuts = calendar.where("pos = 0 AND n_dates > 2").withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(n_cuts - 1))))
    return cuts.select("panel", "cut", at.alias("pos")).join(calendar, ["panel", "pos"]).select("panel", "cut", F.col("dt").alias("last_dt"))


def signal_contract(signal: Signal, prices: DataFrame, n_cuts: int = 3, seed: int = 12345, tolerance: float = 1e-9) -> DataFrame:
    """Whether a signal's past stays as it was when later prices are taken away.

    The signal runs once over the panels and, under names of their own, copies that end at hashed
    dates; weights up to the cut are compared, a missing one being flat. A signal keeps the
    contract where nothing has changed and no weight stands for a day or an instrument that the
    panel does not have. A cheat changes just before the cut; sizing by what the whole sample
    says, as an annualisation by observed bars, changes all of the past.
    -> (panel, cut, last_dt, n_cells, n_changed, first_changed, largest_change, n_strays)
    """
    name = F.concat_ws("#", "panel", F.col("cut").cast("string"))
    cuts = materialize(cut_dates(prices, n_cuts, seed).withColumn("copy", name), "cuts")
    ended = prices.join(cuts, "panel").where(F.col("dt") <= F.col("last_dt"))
    copies = ended.drop("panel", "cut", "last_dt").withColumnRenamed("copy", "panel").select(prices.columns)
    weights = materialize(signal(prices.unionByName(copies)).select("panel", "instrument", "dt", "w"), "weights")
    key = ["panel", "cut", "instrument", "dt"]
    before = weights.join(cuts, "panel").where(F.col("dt") <= F.col("last_dt")).select(*key, F.col("w").alias("whole"))
    after = weights.withColumnRenamed("panel", "copy").join(cuts, "copy").select(*key, F.col("w").alias("part"))
    change = F.abs(F.coalesce("whole", F.lit(0.0)) - F.coalesce("part", F.lit(0.0)))
    compared = before.join(after, key, "full").withColumn("change", change)
    days = ended.select("panel", "cut", "dt", F.lit(True).alias("known_day")).distinct()
    members = ended.select("panel", "cut", "instrument", F.lit(True).alias("known_member")).distinct()
    stray = F.col("known_day").isNull() | F.col("known_member").isNull()
    moved = F.col("change") > tolerance
    found = (
        compared.join(days, ["panel", "cut", "dt"], "left")
        .join(members, ["panel", "cut", "instrument"], "left")
        .groupBy("panel", "cut")
        .agg(
            F.count("*").alias("n_cells"),
            F.count_if(moved).alias("n_changed"),
            F.min(F.when(moved, F.col("dt"))).alias("first_changed"),
            F.max("change").alias("largest_change"),
            # A copy may lack an instrument that starts after its cut; that is no stray of the whole.
            F.count_if(stray & F.col("part").isNotNull()).alias("n_strays"),
        )
    )
    return cuts.select("panel", "cut", "last_dt").join(found, ["panel", "cut"])


def buy_and_hold(
    prices: DataFrame, weight: float = 1.0, calendar: DataFrame | None = None
) -> DataFrame:
    """The same share of `weight` for every instrument on every frame date."""
    members = prices.select("panel", "instrument").distinct().groupBy("panel").agg(
        F.count("*").alias("members")
    )
    return price_frame(prices, calendar).join(members, "panel").select(
        "panel", "instrument", "dt", (F.lit(weight) / F.col("members")).alias("w")
    )


def sign_of_next_return(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """A cheat that looks one frame day ahead; it exists to prove a guard catches it."""
    ahead = F.coalesce(direction_sign(F.lead("ret").over(own_days())), F.lit(0.0))
    return gap_safe_returns(prices, calendar).select("panel", "instrument", "dt", ahead.alias("w"))


def sign_of_last_return(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """The honest counterpart: sign of the previous frame day's return."""
    behind = F.coalesce(direction_sign(F.lag("ret").over(own_days())), F.lit(0.0))
    return gap_safe_returns(prices, calendar).select("panel", "instrument", "dt", behind.alias("w"))


# --- inverse-volatility sizing, shared by the momentum and the turn-of-month signals ---


def inverse_vol(rows: DataFrame, variant: str, directions: dict) -> DataFrame:
    """raw = direction / vol on own days, one row per variant of the direction.

    rows(panel, instrument, dt, before_dt, own_ret, vol); `directions` maps a variant's key to its
    direction column. All variants share one window pass, so more of them add no shuffle.
    -> (panel, instrument, dt, before_dt, <variant>, raw, carried) where `carried` is the
    previous own day's raw times the return since.
    """
    # A window with an undefined return, as after a zero price, keeps the last deviation.
    known = F.last("vol", ignorenulls=True).over(own_days().rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("vol", known)
    raws = {
        f"raw_{i}": F.coalesce(ratio(direction, F.col("vol")), F.lit(0.0))
        for i, direction in enumerate(directions.values())
    }
    moved = {
        f"carried_{i}": F.lag(f"raw_{i}").over(own_days()) * F.coalesce("own_ret", F.lit(0.0))
        for i in range(len(raws))
    }
    choices = [
        F.struct(
            F.lit(key).alias(variant),
            F.col(f"raw_{i}").alias("raw"),
            F.col(f"carried_{i}").alias("carried"),
        )
        for i, key in enumerate(directions)
    ]
    return (
        rows.withColumns(raws)
        .withColumns(moved)
        .select("panel", "instrument", "dt", "before_dt", F.inline(F.array(*choices)))
    )


def capped_scalar(max_gross: float) -> Column:
    """The scalar, at most `max_gross`; NULL stays NULL (`least` alone would skip it)."""
    return F.when(F.col("scalar") > max_gross, F.lit(max_gross)).otherwise(F.col("scalar"))


def daily_scale(
    sized: DataFrame,
    by: list[str],
    vol_window: int = 63,
    vol_target: float = 0.08,
    max_gross: float = MAX_GROSS,
    periods_per_year: float | None = None,
) -> DataFrame:
    """Factor that turns the raw weights of a date into final ones.

    Relative weights are raw / sum|raw|, so the unscaled portfolio return of a date is
    sum(previous raw * return) / previous sum|raw|: one aggregation, no join back.
    `carried` counts only where the previous own day is the previous frame day; that is
    settled after grouping by (dt, before_dt), since the grouped rows hold every frame
    date. The scalar uses deviations up to the day before. Relative weights sum to one in
    size, so capping the gross exposure means capping the scalar.
    -> (*by, dt, gross, port_ret, port_vol, scalar, scale, capped)
    """
    series = W.partitionBy(*by).orderBy("dt")
    rolling = series.rowsBetween(1 - vol_window, 0)
    full = F.count("port_ret").over(rolling) == vol_window
    if periods_per_year is None:
        whole = W.partitionBy(*by)
        per_year = observed_bars_per_year(
            F.count("*").over(whole), F.min("dt").over(whole), F.max("dt").over(whole)
        )
    else:
        per_year = F.lit(float(periods_per_year))
    contiguous = F.filter("moves", lambda m: m["before_dt"] == F.col("prev_dt"))
    moved = F.get(contiguous, F.lit(0))["carried"]
    return (
        sized.groupBy(*by, "dt", "before_dt")
        .agg(F.sum(F.abs("raw")).alias("gross"), F.sum("carried").alias("carried"))
        .groupBy(*by, "dt")
        .agg(
            F.sum("gross").alias("gross"),
            F.collect_list(F.struct("before_dt", "carried")).alias("moves"),
        )
        .withColumns(
            {"prev_dt": F.lag("dt").over(series), "prev_gross": F.lag("gross").over(series)}
        )
        .withColumn("port_ret", F.coalesce(ratio(moved, F.col("prev_gross")), F.lit(0.0)))
        .withColumn("vol", F.when(full, F.stddev_samp("port_ret").over(rolling)) * F.sqrt(per_year))
        .withColumn("port_vol", F.lag("vol").over(series))
        .withColumn("scalar", ratio(F.lit(vol_target), F.col("port_vol")))
        .select(
            *by,
            "dt",
            "gross",
            "port_ret",
            "port_vol",
            "scalar",
            ratio(capped_scalar(max_gross), F.col("gross")).alias("scale"),
            F.coalesce((F.col("scalar") > max_gross) & (F.col("gross") > 0), F.lit(False)).alias("capped"),
        )
    )


def scaled_weights(sized: DataFrame, scale: DataFrame, by: list[str], *also: str) -> DataFrame:
    """Final weights of the dates in `scale` -> (*by, instrument, dt, w, *also)"""
    factors = scale.select(*by, "dt", "scale", *also).where(F.col("scale").isNotNull())
    return (
        sized.where(F.col("raw") != 0)
        .select(*by, "instrument", "dt", "raw")
        .join(factors, [*by, "dt"])
        .select(*by, "instrument", "dt", (F.col("raw") * F.col("scale")).alias("w"), *also)
    )


def hold_between_rebalances(
    sized: DataFrame, scale: DataFrame, calendar: DataFrame, by: list[str], rebalance: str = "BMS"
) -> DataFrame:
    """Sample the scaled weights on each rebalance and hold them until the next.

    The held dates travel as a short list beside the scale of each sampled date, so the
    per-instrument rows meet one small table and only the sampled dates' cross-sections,
    one date in about twenty, leave that stage. -> (*by, instrument, dt, w)
    """
    held = (
        rebalance_calendar(calendar, rebalance)
        .where(F.col("source_dt").isNotNull())
        .groupBy("panel", F.col("source_dt").alias("dt"))
        .agg(F.collect_list("dt").alias("held_days"))
    )
    return scaled_weights(sized, scale.join(held, ["panel", "dt"]), by, "held_days").select(
        *by, "instrument", F.explode("held_days").alias("dt"), "w"
    )


def momentum_raw(
    prices: DataFrame,
    lookbacks: tuple[int, ...],
    vol_window: int = 63,
    periods_per_year: float | None = None,
) -> DataFrame:
    """Direction by calendar-month lookback over own-day volatility, one row per lookback."""
    pasts = {f"past_{m}": past_close(m) for m in lookbacks}
    rows = own_volatility(prices, vol_window, periods_per_year, pasts)
    close = F.col("close")
    directions = {
        # From zero every price has risen.
        int(m): F.when((F.col(f"past_{m}") == 0) & (close > 0), 1.0).otherwise(
            direction_sign(ratio(close, F.col(f"past_{m}")) - 1.0)
        )
        for m in lookbacks
    }
    return inverse_vol(rows, "lookback", directions)


def momentum_grid(
    prices: DataFrame,
    lookbacks: tuple[int, ...] = (12,),
    vol_window: int = 63,
    vol_target: float = 0.08,
    max_gross: float = MAX_GROSS,
    periods_per_year: float | None = None,
    calendar: DataFrame | None = None,
    rebalance: str = "BMS",
) -> DataFrame:
    """Time-series momentum for several lookbacks -> (panel, lookback, instrument, dt, w)"""
    by = ["panel", "lookback"]
    calendar = frame_calendar(prices) if calendar is None else calendar
    sized = momentum_raw(prices, lookbacks, vol_window, periods_per_year)
    scale = daily_scale(sized, by, vol_window, vol_target, max_gross, periods_per_year)
    return hold_between_rebalances(sized, scale, calendar, by, rebalance)


def tsmom(prices: DataFrame, lookback_months: int = 12, **params) -> DataFrame:
    """Time-series momentum, inverse-vol sized to a portfolio target, rebalanced by month or as
    `rebalance` says (see `calendars.rebalance_calendar`).

    `periods_per_year=None` annualises with the bars observed in the whole input; pass a
    number for weights that later data cannot move.
    """
    return momentum_grid(prices, (lookback_months,), **params).drop("lookback")
