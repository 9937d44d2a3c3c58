"""Calendars: month spines, the frame of a panel, missing weekdays, rebalance dates.

A calendar holds one row per (panel, date). Dates are days, so a century is at most
36,525 rows per panel whatever the number of instruments; windows over a calendar are
bounded by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.functions.scalars import business_month_start, is_weekday


def month_spine(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per month from `start` to `end`, both inclusive."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return spans.withColumn("month", F.explode(months))


def frame_calendar(prices: DataFrame) -> DataFrame:
    """Union of the dates of a panel, with position, neighbours and frame length.

    prices(panel, dt, ...) -> (panel, dt, pos, prev_dt, next_dt, n_dates)
    """
    order = W.partitionBy("panel").orderBy("dt")
    return (
        prices.select("panel", "dt")
        .distinct()
        .select(
            "panel",
            "dt",
            (F.row_number().over(order) - 1).alias("pos"),
            F.lag("dt").over(order).alias("prev_dt"),
            F.lead("dt").over(order).alias("next_dt"),
            F.count("*").over(W.partitionBy("panel")).alias("n_dates"),
        )
    )


def missing_weekdays(bars: DataFrame) -> DataFrame:
    """Mondays to Fridays between the first and last bar of an instrument with no bar.

    Each bar emits the hole up to the next bar, so no calendar is generated and joined.
    """
    after = F.lead("dt").over(W.partitionBy("instrument").orderBy("dt"))
    hole = F.sequence(F.date_add("dt", 1), F.date_sub("next_dt", 1))
    return (
        bars.select("instrument", "dt")
        .distinct()
        .withColumn("next_dt", after)
        .where(F.datediff("next_dt", "dt") > 1)
        .select("instrument", F.explode(hole).alias("dt"))
        .where(is_weekday(F.col("dt")))
    )


# Months between rebalances that fall on the first weekday of a month.
REBALANCE_MONTHS = {"BMS": 1, "BQS": 3, "BYS": 12}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI")


def _due_days(rebalance: str) -> tuple[Column, Callable[[Column], Column]]:
    """The rebalance days from a frame date to the next, and whether one day is such a day."""
    if rebalance in REBALANCE_MONTHS:
        every = REBALANCE_MONTHS[rebalance]
        months = F.sequence(F.trunc("dt", "MM"), F.trunc("next_dt", "MM"), F.expr("interval 1 month"))
        turning = F.filter(months, lambda m: (F.month(m) - 1) % every == 0)
        return F.transform(turning, business_month_start), lambda day: (business_month_start(day) == day) & ((F.month(day) - 1) % every == 0)
    if rebalance == "B":
        wanted = is_weekday
    elif rebalance.startswith("W-") and rebalance[2:] in WEEKDAYS:
        wanted = lambda day: F.weekday(day) == WEEKDAYS.index(rebalance[2:])
    else:
        raise ValueError(f"{rebalance}: known are {', '.join(REBALANCE_MONTHS)}, B and W-MON to W-FRI")
    return F.filter(F.sequence("dt", "next_dt"), wanted), wanted


def rebalance_calendar(calendar: DataFrame, rebalance: str = "BMS") -> DataFrame:
    """For each frame date: the rebalance in force and the frame date it samples.

    Rebalances fall inside the frame's span on the first weekday of each month (BMS), quarter
    (BQS) or year (BYS), on a weekday of each week (W-MON to W-FRI) or on all weekdays (B). One takes
    the last frame date on or before it. A date announces the latest rebalance up to the
    next date; what is in force is the running maximum of earlier announcements (both
    columns only ever grow), so one window over the calendar settles it.
    -> (panel, dt, rebalance_dt, source_dt), both NULL before the first rebalance.
    """
    days, falls_on = _due_days(rebalance)
    due = F.filter(days, lambda day: (day > F.col("dt")) & (day <= F.col("next_dt")))
    opening = F.col("prev_dt").isNull() & falls_on(F.col("dt"))
    order = W.partitionBy("panel").orderBy("dt")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return (
        calendar.select("panel", "dt", "prev_dt", "next_dt")
        .withColumn("due", F.array_max(due))
        .withColumn("sampled", F.when(F.col("due") == F.col("next_dt"), F.col("due"))
                    .when(F.col("due").isNotNull(), F.col("dt")))
        .withColumn("opening", F.when(opening, F.col("dt")))
        .select(
            "panel",
            "dt",
            F.greatest(F.max("due").over(earlier), F.max("opening").over(upto)).alias("rebalance_dt"),
            F.greatest(F.max("sampled").over(earlier), F.max("opening").over(upto)).alias("source_dt"),
        )
    )
