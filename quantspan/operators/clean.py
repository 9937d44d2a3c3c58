"""Raw bars to clean bars: one bar per instrument and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.config import HOLDOUT_START
from quantspan.functions.scalars import is_weekday


def weekday_filter(bars: DataFrame) -> DataFrame:
    """Keep Monday to Friday; a NULL date is dropped."""
    return bars.where(is_weekday(F.col("dt")))


def dedup_keep_last(bars: DataFrame, order: str = "ord") -> DataFrame:
    """One bar per (instrument, dt): the one with the highest `order`.

    Of rows with equal `order` one is taken whole, the greatest by its values. The maximum
    merges map-side, so an instrument, or a single date of one, that holds most of the rows
    costs one partial row per task.
    """
    values = [c for c in bars.columns if c not in ("instrument", "dt", order)]
    last = F.max(F.struct(order, *values)).alias("last")
    return bars.groupBy("instrument", "dt").agg(last).select("instrument", "dt", *[F.col(f"last.{c}").alias(c) for c in (*values, order)])


def clean_bars(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Weekdays only, last bar of each date. The filter runs before the shuffle."""
    return dedup_keep_last(weekday_filter(raw), order)


def duplicate_dates(raw: DataFrame) -> DataFrame:
    """Whether an instrument has a date more than once in its raw rows.

    Unparsed dates are NULL and repeat each other. -> (instrument, has_duplicates)
    """
    per_day = raw.groupBy("instrument", "dt").count()
    return per_day.groupBy("instrument").agg((F.max("count") > 1).alias("has_duplicates"))


def merge_batches(*batches: DataFrame, order: str = "ord") -> DataFrame:
    """Append batches of bars; where a date comes twice the later batch wins."""
    merged = None
    for number, batch in enumerate(batches):
        tagged = dedup_keep_last(batch, order).withColumn("batch", F.lit(number))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return dedup_keep_last(merged, "batch").drop("batch")


def before_holdout(df: DataFrame, start=HOLDOUT_START) -> DataFrame:
    """Drop the reserved period; `start` is its first day."""
    return df.where(F.col("dt") < F.lit(start))


def from_date(df: DataFrame, start) -> DataFrame:
    return df.where(F.col("dt") >= F.lit(start).cast("date"))


def split_period(df: DataFrame, split) -> DataFrame:
    """Tag rows `early` (up to and including `split`) or `late`."""
    return df.withColumn(
        "period", F.when(F.col("dt") <= F.lit(split).cast("date"), "early").otherwise("late")
    )
