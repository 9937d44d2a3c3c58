"""Quality summaries that grow with the data: partial states by month, which combine.

A state says of one instrument's month what its neighbours and the whole need: counts, its first
and last bar, and size, mean, spread and extremes of the log returns and opening gaps inside.
The bars at a seam are compared from the states. Whether a return is anomalous depends on the
mean and deviation of all months; those come from the states too, and only months whose extremes lie
beyond the limit have bars that need a second look. So a new month costs its own bars and a
pass over the states, one row an instrument and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import ANOMALY_SIGMA
from quantspan.functions.scalars import finite, positive_log, weekdays_before

VALUES = ("log", "gap")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def _positive(x: Column) -> Column:
    return F.when(finite(x) > 0, x)


def _measured(bars: DataFrame) -> DataFrame:
    """Bars with what is compared between neighbours of a month -> adds (month, log, gap, skipped)."""
    inside = W.partitionBy("instrument", "month").orderBy("dt")
    has_open = "open" in bars.columns
    opened = _positive(F.col("open")) if has_open else F.lit(None).cast("double")
    level = positive_log(F.col("close"))
    return bars.withColumn("month", month_of(F.col("dt"))).withColumns(
        {
            "level": level,
            "opened": opened,
            "log": level - F.lag(level).over(inside),
            "gap": F.ln(F.try_divide(opened, F.lag(_positive(F.col("close"))).over(inside))),
            "skipped": _skipped(F.lag("dt").over(inside), F.col("dt")),
        }
    )


def _skipped(before: Column, day: Column) -> Column:
    """Weekdays between two bars."""
    return F.greatest(weekdays_before(day) - weekdays_before(F.date_add(before, 1)), F.lit(0))


def states(bars: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row per instrument and month; `raw` bars tell whether a date came twice."""
    close = finite(F.col("close"))
    edge = F.struct("dt", "level", "opened", _positive(F.col("close")).alias("price"))
    moments = []
    for v in VALUES:
        moments += [
            F.count(v).alias(f"{v}_n"),
            F.avg(v).alias(f"{v}_mean"),
            (F.var_pop(v) * F.count(v)).alias(f"{v}_squares"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
        ]
    found = (
        _measured(bars)
        .groupBy("instrument", "month")
        .agg(
            F.count("*").alias("n_obs"),
            F.min_by(edge, "dt").alias("first"),
            F.max_by(edge, "dt").alias("last"),
            F.count_if((close <= 0) | close.isNull()).alias("nonpositive"),
            F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
            *moments,
        )
    )
    if raw is None:
        return found.withColumn("repeats", F.lit(False))
    per_day = raw.groupBy("instrument", "dt").count()
    repeats = per_day.groupBy("instrument", month_of(F.col("dt")).alias("month")).agg((F.max("count") > 1).alias("repeats"))
    # Months whose only raw bars fall on weekends have a state too: their repeats count.
    return found.join(repeats, ["instrument", "month"], "full").withColumn("repeats", F.coalesce("repeats", F.lit(False)))


def _limits(entries: DataFrame, v: str, sigma: float) -> DataFrame:
    """Beyond which a value is anomalous -> (instrument, low, high), from (n, mean, squares) parts"""
    whole = W.partitionBy("instrument")
    mean = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    total = entries.where("n > 0").withColumn("center", mean)
    apart = F.col("mean") - F.col("center")
    spread = F.sqrt(F.sum(F.col("squares") + F.col("n") * apart * apart) / F.sum("n"))
    return (
        total.groupBy("instrument")
        .agg(F.max("center").alias("center"), spread.alias("spread"))
        .where("spread > 0")
        .select(
            "instrument",
            (F.col("center") - sigma * F.col("spread")).alias(f"{v}_low"),
            (F.col("center") + sigma * F.col("spread")).alias(f"{v}_high"),
        )
    )


def summary(found: DataFrame, bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """`quality.quality_summary` from states, with counts as columns

    `bars` are those the states were made of; only suspicious months of them are used.
    -> (instrument, n_obs, start, end, missing_days, nonpositive_price, anomalous_return,
    session_gap, calendar_gap, duplicate_dates)
    """
    order = W.partitionBy("instrument").orderBy("month")
    held = found.where(F.col("n_obs").isNotNull()).withColumn("before", F.lag("last").over(order))
    seams = held.select(
        "*",
        (F.col("first.level") - F.col("before.level")).alias("log_seam"),
        F.ln(F.try_divide(F.col("first.opened"), F.col("before.price"))).alias("gap_seam"),
        F.coalesce(_skipped(F.col("before.dt"), F.col("first.dt")), F.lit(0)).alias("skipped_seam"),
    )
    limited = seams
    for v in VALUES:
        parts = seams.select("instrument", F.col(f"{v}_n").alias("n"), F.col(f"{v}_mean").alias("mean"), F.col(f"{v}_squares").alias("squares"))
        single = seams.where(F.col(f"{v}_seam").isNotNull()).select(
            "instrument", F.lit(1).cast("bigint").alias("n"), F.col(f"{v}_seam").alias("mean"), F.lit(0.0).alias("squares")
        )
        limited = limited.join(_limits(parts.unionByName(single), v, sigma), "instrument", "left")

    def beyond(v: str, value: Column) -> Column:
        return F.coalesce((value < F.col(f"{v}_low")) | (value > F.col(f"{v}_high")), F.lit(False))

    suspicious = limited.where(
        beyond("log", F.col("log_min")) | beyond("log", F.col("log_max")) | beyond("gap", F.col("gap_min")) | beyond("gap", F.col("gap_max"))
    ).select("instrument", "month", *[f"{v}_{side}" for v in VALUES for side in ("low", "high")])
    doubtful = bars.withColumn("month", month_of(F.col("dt"))).join(suspicious.select("instrument", "month"), ["instrument", "month"], "left_semi")
    inside = (
        _measured(doubtful.drop("month"))
        .join(suspicious, ["instrument", "month"])
        .groupBy("instrument")
        .agg(*[F.count_if(beyond(v, F.col(v))).alias(f"{v}_inside") for v in VALUES])
    )
    totals = limited.groupBy("instrument").agg(
        F.sum("n_obs").alias("n_obs"),
        F.min("first.dt").alias("start"),
        F.max("last.dt").alias("end"),
        F.sum(F.col("skipped") + F.col("skipped_seam")).alias("missing_days"),
        F.sum("nonpositive").alias("nonpositive_price"),
        *[F.count_if(beyond(v, F.col(f"{v}_seam"))).alias(f"{v}_seams") for v in VALUES],
    )
    repeats = found.groupBy("instrument").agg(F.bool_or("repeats").cast("bigint").alias("duplicate_dates"))
    number = lambda v: F.col(f"{v}_seams") + F.coalesce(f"{v}_inside", F.lit(0))
    return (
        totals.join(inside, "instrument", "left")
        .join(repeats, "instrument")
        .select(
            "instrument",
            "n_obs",
            "start",
            "end",
            "missing_days",
            "nonpositive_price",
            number("log").alias("anomalous_return"),
            number("gap").alias("session_gap"),
            (F.col("missing_days") > 0).cast("bigint").alias("calendar_gap"),
            "duplicate_dates",
        )
    )
