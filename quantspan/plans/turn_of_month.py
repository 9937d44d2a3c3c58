"""Turn-of-month strategy, its window variant and the random-day benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import MAX_GROSS, CostModel
from quantspan.functions.scalars import ratio
from quantspan.operators import metrics as M
from quantspan.operators.backtest import active_days, daily_breakdown, net_of_costs
from quantspan.operators.calendars import frame_calendar
from quantspan.operators.returns import observed_bars_per_year, own_volatility
from quantspan.operators.seasonality import random_days, tom_flag
from quantspan.operators.trials import deflated_sharpe
from quantspan.plans.signals import capped_scalar, daily_scale, inverse_vol, scaled_weights
from quantspan.session import join_side, materialize

VARIANT = ["panel", "after"]


def tom_weights(
    prices: DataFrame,
    afters: tuple[int, ...] = (3,),
    vol_window: int = 63,
    vol_target: float = 0.08,
    max_gross: float = MAX_GROSS,
    periods_per_year: float | None = None,
) -> DataFrame:
    """Long in the window [-1, +after], flat outside -> (panel, after, instrument, dt, w, capped)

    `capped` marks weights that ran into the exposure cap, which this strategy should
    never do: a true value points at a sizing fault.
    """
    rows = own_volatility(prices, vol_window, periods_per_year)
    for after in afters:
        rows = tom_flag(rows, 1, after).withColumnRenamed("tom", f"tom_{after}")
    directions = {int(a): F.col(f"tom_{a}").cast("double") for a in afters}
    sized = inverse_vol(rows, "after", directions)
    scale = daily_scale(sized, VARIANT, vol_window, vol_target, max_gross, periods_per_year)
    return scaled_weights(sized, scale, VARIANT, "capped")


def tom_returns(
    prices: DataFrame,
    afters: tuple[int, ...] = (3,),
    costs: CostModel | None = None,
    calendar: DataFrame | None = None,
    **sizing,
) -> DataFrame:
    """-> (panel, after, dt, ret), net"""
    calendar = frame_calendar(prices) if calendar is None else calendar
    specs = calendar.select("panel").distinct().withColumn(
        "after", F.explode(F.array(*[F.lit(int(a)) for a in afters]))
    )
    weights = tom_weights(prices, afters, **sizing)
    daily = daily_breakdown(prices, weights, costs, tuple(VARIANT), calendar, specs)
    return daily.select(*VARIANT, "dt", net_of_costs().alias("ret"))


def null_benchmark(
    prices: DataFrame,
    n_resamples: int = 1000,
    per_month: int = 4,
    seed: int = 12345,
    vol_window: int = 63,
    vol_target: float = 0.08,
    max_gross: float = MAX_GROSS,
    costs: CostModel | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Ratio of the same sizing on random days, per resample -> (panel, resample, sharpe)

    The relative weights of a date are the same in every resample, so the panel is sized
    once; a resample only decides which days' portfolio returns are earned, which is a
    matter of the daily series. Instrument rows are multiplied only for the chosen days.
    """
    by = ["panel", "resample"]
    calendar = materialize(frame_calendar(prices), "calendar") if calendar is None else calendar
    sized = inverse_vol(own_volatility(prices, vol_window), "always", {1: F.lit(1.0)})
    spans = calendar.groupBy("panel").agg(
        observed_bars_per_year(F.count("*"), F.min("dt"), F.max("dt")).alias("per_year")
    )
    days = materialize(
        daily_scale(sized, ["panel", "always"], vol_window, vol_target, max_gross)
        .select("panel", "dt", "port_ret", "gross")
        .join(calendar.select("panel", "dt", "pos"), ["panel", "dt"])
        .join(spans, "panel"),
        "portfolio",
    )
    # A resample earns something on few days, and zeros add nothing to a sum: the rolling
    # deviation is taken over the other days by position, up to the day before.
    series = W.partitionBy(*by).orderBy("pos")
    recent = series.rangeBetween(-vol_window, -1)
    total, squares = F.sum("earned").over(recent), F.sum(F.col("earned") * F.col("earned")).over(recent)
    variance = (squares - total * total / vol_window) / (vol_window - 1)
    # A chosen day earns on the next; days that are both chosen and earned on are one row.
    marks = F.array(
        F.struct(F.col("pos").alias("pos"), F.lit(True).alias("chosen")),
        F.struct((F.col("pos") + 1).alias("pos"), F.lit(False).alias("chosen")),
    )
    scale = materialize(
        random_days(days, n_resamples, per_month, seed)
        .select(*by, F.inline(marks))
        .groupBy(*by, "pos")
        .agg(F.bool_or("chosen").alias("chosen"), F.bool_or(~F.col("chosen")).alias("earns"))
        .join(join_side(days), ["panel", "pos"])
        .withColumn("earned", F.when(F.col("earns"), F.col("port_ret")).otherwise(0.0))
        .withColumn("variance", variance)
        .where(F.col("chosen") & (F.col("variance") > 0) & (F.col("pos") >= vol_window))
        .withColumn("scalar", vol_target / F.sqrt(F.col("variance") * F.col("per_year")))
        .select(*by, "dt", ratio(capped_scalar(max_gross), F.col("gross")).alias("scale"))
        .where(F.col("scale").isNotNull()),
        "random-days",
    )
    weights = (
        sized.where(F.col("raw") != 0)
        .select("panel", "instrument", "dt", "raw")
        .join(scale, ["panel", "dt"])
        .select(*by, "instrument", "dt", (F.col("raw") * F.col("scale")).alias("w"))
    )
    resamples = F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)))
    strategies = M.frame_lengths(calendar).withColumn("resample", resamples)
    active = active_days(prices, weights, costs, tuple(by), calendar).select(*by, "dt", net_of_costs().alias("ret"))
    return M.sparse_sharpe(active, strategies, tuple(by))


def variant_verdict(prices: DataFrame, calendar: DataFrame, n_resamples: int = 1000, after: int = 4, **sizing) -> DataFrame:
    """The window and its one variant, deflated for two trials, against a benchmark of its own.

    The benchmark draws as many days a month as the variant's window has: one before the turn of
    the month, `after` after it. -> (panel, n_trials, best, expected_max, deflated, null_p95, promote)
    """
    earned = tom_returns(prices, (3, after), calendar=calendar, **sizing)
    deflated = deflated_sharpe(M.sharpe(earned, ("panel", "after")), ("panel",))
    null = null_benchmark(prices, n_resamples, per_month=after + 1, calendar=calendar, **sizing)
    limit = null.groupBy("panel").agg(F.percentile("sharpe", F.lit(0.95)).alias("null_p95"))
    return deflated.join(limit, "panel").withColumn("promote", F.col("deflated") > F.col("null_p95"))
