"""Weights to portfolio returns net of costs.

A weight decided on one frame date earns the return of the next. Only non-zero weights
are processed: a missing cell and a zero are the same flat position. Each weight gives
at most two contributions, one on its own date (the trade) and one on the next (the
return, the holding charge and, if nothing follows, the exit), and those are summed per
date with map-side partial aggregation, so nothing is ever as wide as the universe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import CostModel
from quantspan.operators.calendars import frame_calendar
from quantspan.operators.returns import traded_day_returns

COST_PARTS = ("spread", "slippage", "impact", "commission")
DAILY = ("gross", "turnover", "turnover_cost", "held", "swap_cost")


def cost_rate(costs: DataFrame) -> DataFrame:
    """Cost per unit traded -> (instrument, rate, swap)."""
    parts = [F.col(c) for c in COST_PARTS]
    return costs.select("instrument", sum(parts[1:], parts[0]).alias("rate"), "swap")


def swap_override(costs: DataFrame, swaps_bp: tuple[float, ...]) -> DataFrame:
    """One copy of the cost table per holding charge, given in basis points per bar."""
    levels = F.explode(F.array(*[F.lit(float(s)) for s in swaps_bp]))
    return costs.withColumn("swap_bp", levels).withColumn("swap", F.col("swap_bp") * 1e-4)


def cost_lookup(df: DataFrame, costs: DataFrame | CostModel | None) -> DataFrame:
    """Adds (rate, swap) per instrument; the default model where none is listed."""
    if isinstance(costs, DataFrame):
        default = CostModel()
        return df.join(cost_rate(costs), "instrument", "left").withColumns(
            {
                "rate": F.coalesce("rate", F.lit(default.rate)),
                "swap": F.coalesce("swap", F.lit(default.swap)),
            }
        )
    model = costs or CostModel()
    return df.withColumns({"rate": F.lit(model.rate), "swap": F.lit(model.swap)})


def active_days(
    prices: DataFrame,
    weights: DataFrame,
    costs: DataFrame | CostModel | None = None,
    by: tuple[str, ...] = ("panel",),
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Daily totals of a set of strategies, for the days on which one holds or trades anything.

    `by` names the columns that identify a strategy; it includes `panel`, which says whose
    prices it trades. Weights of instruments without any price in the panel are left out. All
    other frame dates are zeros, which `metrics.sparse_metrics` counts by their number.
    -> (*by, dt, gross, turnover, turnover_cost, held, swap_cost)
    """
    by = list(by)
    calendar = frame_calendar(prices) if calendar is None else calendar
    order = W.partitionBy(*by, "instrument").orderBy("dt")
    priced = prices.select("panel", "instrument").distinct()
    positions = (
        weights.where(F.col("w") != 0)
        .join(priced, ["panel", "instrument"], "left_semi")
        .select(*by, "instrument", "dt", "w")
        .join(calendar.select("panel", "dt", "prev_dt", "next_dt"), ["panel", "dt"])
        .withColumns(
            {
                "before": F.when(F.lag("dt").over(order) == F.col("prev_dt"), F.lag("w").over(order)),
                "continues": F.coalesce(F.lead("dt").over(order) == F.col("next_dt"), F.lit(False)),
            }
        )
    )
    next_returns = traded_day_returns(prices).withColumnRenamed("dt", "next_dt")
    earned = cost_lookup(
        positions.join(next_returns, ["panel", "instrument", "next_dt"], "left"), costs
    )
    zero = F.lit(0.0)
    size = F.abs("w")
    traded = F.abs(F.col("w") - F.coalesce("before", zero))
    exited = F.when(F.col("continues"), zero).otherwise(size)

    def leg(day, gross, turned, held):
        return F.struct(
            day.alias("dt"),
            gross.alias("gross"),
            turned.alias("turnover"),
            (turned * F.col("rate")).alias("turnover_cost"),
            held.alias("held"),
            (held * F.col("swap")).alias("swap_cost"),
        )

    legs = F.array(
        leg(F.col("dt"), zero, traded, zero),
        leg(F.col("next_dt"), F.col("w") * F.coalesce("ret", zero), exited, size),
    )
    return (
        earned.select(*by, F.inline(legs))
        .where(F.col("dt").isNotNull())
        .groupBy(*by, "dt")
        .agg(*[F.sum(c).alias(c) for c in DAILY])
    )


def daily_breakdown(
    prices: DataFrame,
    weights: DataFrame,
    costs: DataFrame | CostModel | None = None,
    by: tuple[str, ...] = ("panel",),
    calendar: DataFrame | None = None,
    specs: DataFrame | None = None,
) -> DataFrame:
    """`active_days` with a row per frame date, zeros where nothing is held or traded.

    `specs` lists the strategies where that is known without reading the weights.
    """
    by = list(by)
    calendar = frame_calendar(prices) if calendar is None else calendar
    zero = F.lit(0.0)
    totals = active_days(prices, weights, costs, tuple(by), calendar)
    days = calendar.select("panel", "dt")
    if by != ["panel"]:
        days = days.join(weights.select(*by).distinct() if specs is None else specs, "panel")
    return days.join(totals, [*by, "dt"], "left").select(
        *by, "dt", *[F.coalesce(c, zero).alias(c) for c in DAILY]
    )


def net_of_costs() -> Column:
    return F.col("gross") - F.col("turnover_cost") - F.col("swap_cost")


def backtest(
    prices: DataFrame,
    weights: DataFrame,
    costs: DataFrame | CostModel | None = None,
    apply_costs: bool = True,
    by: tuple[str, ...] = ("panel",),
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Portfolio return per frame date, net of costs unless told otherwise -> (*by, dt, ret)"""
    daily = daily_breakdown(prices, weights, costs, by, calendar)
    return daily.select(*by, "dt", (net_of_costs() if apply_costs else F.col("gross")).alias("ret"))
