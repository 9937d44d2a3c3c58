"""Alignment of instruments that trade on different days.

Tables stay long and sparse: a missing row means "did not trade". The dense frame
(every date of the panel for every instrument) is built only where a result has to
have it, by letting each price fill the run of dates up to the next price; there is no
join of all dates with all instruments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.functions.scalars import months_before
from quantspan.operators.calendars import frame_calendar
from quantspan.operators.scans import asof_join


def own_days():
    """The days of one instrument, in order."""
    return W.partitionBy("panel", "instrument").orderBy("dt")



def universe_filter(prices: DataFrame, samples: DataFrame) -> DataFrame:
    """One panel per sample, restricted to its instruments.

    Runs before any frame is built: the union calendar of a sample comes from its own
    members. samples(panel, instrument); the prices' own panel, if any, is replaced.
    """
    return prices.drop("panel").join(samples.select("panel", "instrument"), "instrument")


def traded(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("close").isNotNull())


def price_frame(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Full frame of a panel.

    -> (panel, instrument, dt, pos, close, filled): `close` is NULL on days without a
    trade, `filled` carries the last one forward and is NULL before the first.
    """
    calendar = frame_calendar(prices) if calendar is None else calendar
    where = calendar.select("panel", "dt", "pos", "n_dates")
    order = W.partitionBy("panel", "instrument").orderBy("pos")
    placed = (
        traded(prices)
        .select("panel", "instrument", "dt", "close")
        .join(where, ["panel", "dt"])
        .withColumn("is_first", F.lag("pos").over(order).isNull())
        .withColumn("until", F.coalesce(F.lead("pos").over(order), F.col("n_dates")) - 1)
    )
    begin = F.when(F.col("is_first"), F.lit(0)).otherwise(F.col("pos"))
    runs = placed.select(
        "panel",
        "instrument",
        F.col("pos").alias("traded_pos"),
        F.col("close").alias("price"),
        F.explode(F.sequence(begin, F.col("until").cast("int"))).alias("pos"),
    )
    return runs.join(where.select("panel", "pos", "dt"), ["panel", "pos"]).select(
        "panel",
        "instrument",
        "dt",
        "pos",
        F.when(F.col("pos") == F.col("traded_pos"), F.col("price")).alias("close"),
        F.when(F.col("pos") >= F.col("traded_pos"), F.col("price")).alias("filled"),
    )


def align_weights(
    prices: DataFrame, weights: DataFrame, calendar: DataFrame | None = None
) -> DataFrame:
    """Weights on every frame cell; a missing cell is flat, not held."""
    cells = price_frame(prices, calendar).select("panel", "instrument", "dt")
    return cells.join(weights, ["panel", "instrument", "dt"], "left").select(
        "panel", "instrument", "dt", F.coalesce("w", F.lit(0.0)).alias("w")
    )


def frame_ffill(
    prices: DataFrame, series: DataFrame, value: str, calendar: DataFrame | None = None
) -> DataFrame:
    """Put a per-instrument series on the frame and carry its last value forward."""
    on_frame = price_frame(prices, calendar).select("panel", "instrument", "dt")
    carried = F.last(value, ignorenulls=True).over(own_days().rowsBetween(W.unboundedPreceding, 0))
    return on_frame.join(
        series.select("panel", "instrument", "dt", value), ["panel", "instrument", "dt"], "left"
    ).select("panel", "instrument", "dt", carried.alias(value))


def asof_lookback(prices: DataFrame, months: int) -> DataFrame:
    """Adds `past`: the instrument's last price on or before `months` calendar months ago.

    By slices of time (`scans.asof_join`), so one long series is not one task.
    """
    known = traded(prices)
    asked = known.withColumn("probe", months_before(F.col("dt"), months))
    found = asof_join(asked, known, ["panel", "instrument"], "probe", "dt", {"past": "close"})
    return found.drop("probe")


def past_close(months: int) -> Column:
    """`asof_lookback` as a window column, for plans that sort own days anyway.

    A RANGE frame ending `months` before the current date: no second copy of the prices.
    """
    return F.expr(
        "last_value(close) over (partition by panel, instrument order by dt "
        f"range between unbounded preceding and interval '{int(months)}' month preceding)"
    )
