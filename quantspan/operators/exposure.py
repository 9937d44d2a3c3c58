"""Checks and rescaling of target weights.

Sums over the instruments of a date are grouped and joined back rather than windowed: a
date's cross-section grows with the universe, and a window would hold all of it in one
task. The grouped side has one row per (panel, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import EXPOSURE_TOLERANCE, MAX_GROSS
from quantspan.functions.scalars import ratio
from quantspan.operators import scans
from quantspan.operators.align import own_days


def gross_exposure(weights: DataFrame) -> DataFrame:
    return weights.groupBy("panel", "dt").agg(F.sum(F.abs("w")).alias("gross"))


def exposure_violations(
    weights: DataFrame, max_gross: float = MAX_GROSS, tolerance: float = EXPOSURE_TOLERANCE
) -> DataFrame:
    """Dates whose summed absolute weight is above the cap."""
    return gross_exposure(weights).where(F.col("gross") > max_gross + tolerance)


def validate_weights(
    weights: DataFrame, max_gross: float = MAX_GROSS, tolerance: float = EXPOSURE_TOLERANCE
) -> None:
    """Raise with the number of violating dates and the first five of them."""
    bad = exposure_violations(weights, max_gross, tolerance)
    n = bad.count()
    if n:
        first = [f"{r.panel} {r.dt}" for r in bad.orderBy("dt", "panel").limit(5).collect()]
        raise ValueError(f"gross exposure above {max_gross} on {n} date(s): {first}")


def cross_section_normalise(weights: DataFrame) -> DataFrame:
    """Divide by the date's gross exposure; 0 where that is 0."""
    return weights.join(gross_exposure(weights), ["panel", "dt"]).withColumn(
        "w", F.coalesce(ratio(F.col("w"), F.col("gross")), F.lit(0.0))
    ).drop("gross")


def gross_cap(weights: DataFrame, max_gross: float = MAX_GROSS) -> DataFrame:
    """Shrink the weights of a date so that their gross stays within the cap."""
    factor = F.when(F.col("gross") > max_gross, max_gross / F.col("gross")).otherwise(1.0)
    return weights.join(gross_exposure(weights), ["panel", "dt"]).withColumn(
        "w", F.coalesce(F.col("w"), F.lit(0.0)) * factor
    ).drop("gross")


def lag_one(weights: DataFrame) -> DataFrame:
    """Previous row's weight, 0 on the first -> adds held."""
    return weights.withColumn("held", F.coalesce(F.lag("w").over(own_days()), F.lit(0.0)))


def turnover(weights: DataFrame) -> DataFrame:
    """Absolute change of the weight, counting the entry from 0 -> adds turnover."""
    return lag_one(weights).withColumn("turnover", F.abs(F.col("w") - F.col("held"))).drop("held")


def weight_change(weights: DataFrame) -> DataFrame:
    """Absolute change of the weight, NULL on the first row -> adds change."""
    return weights.withColumn("change", F.abs(F.col("w") - F.lag("w").over(own_days())))


def live_start(weights: DataFrame, eval_start: str) -> DataFrame:
    """Later of `eval_start` and the first date with any exposure -> (panel, start)."""
    active = F.min(F.when(F.abs("w") > 0, F.col("dt")))
    return weights.groupBy("panel").agg(
        F.greatest(F.lit(eval_start).cast("date"), active).alias("start")
    )


def ffill(series: DataFrame, value: str, by: list[str], order: str = "dt", chunk: Column | None = None) -> DataFrame:
    """Last non-NULL value up to each row.

    `chunk` grows with `order`, which is a date or a row number where no chunk is given.
    """
    chunk = scans.chunk_of(series, order) if chunk is None else chunk
    return scans.running(series, by, [order], chunk, **{value: scans.Running("last", value)}).select(*series.columns)
