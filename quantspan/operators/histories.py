"""Running totals over long event histories, where one key may own most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.operators import scans


def hour_of(ts: Column) -> Column:
    """Hours since 1970, by the clock reading."""
    return F.floor(minute_of(ts) / 60)


def minute_of(ts: Column) -> Column:
    """Minutes since 1970, by the clock reading, whatever the session's time zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1440 + F.hour(ts) * 60 + F.minute(ts)


def running_pnl(
    events: DataFrame, path: list[str], order: list[str], chunk: Column | None = None, value: str = "r"
) -> DataFrame:
    """Number the rows of each path and accumulate `value` -> adds (day, pnl).

    Paths are cut by `chunk`, which grows with `order`; without it `events` come from
    `scans.ranged`, which also cuts a path whose rows share one hour.
    """
    totals = {"day": scans.Running("count", F.lit(1)), "pnl": scans.Running("sum", value)}
    found = scans.running(events, path, order, chunk, **totals)
    return found.withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def centred_returns(events: DataFrame, path: list[str], value: str, scale: float) -> DataFrame:
    """r = (value - the path's mean) / scale; the mean is grouped and joined back."""
    means = events.groupBy(*path).agg(F.avg(value).alias("mean_value"))
    return events.join(means, path).withColumn(
        "r", (F.col(value) - F.col("mean_value")) / scale
    ).drop("mean_value")


def centred_pnl(
    events: DataFrame, path: list[str], order: list[str], chunk: Column | None, value: str, scale: float
) -> DataFrame:
    """`running_pnl` of `centred_returns`, from one aggregate and one more scan.

    The counts and sums of a path's chunks give its mean as well as what came before each
    chunk. Without `chunk`, `events` come from `scans.ranged`. -> adds (r, day, pnl)
    """
    rows = events if chunk is None else events.withColumn("chunk", chunk.cast("bigint"))
    whole = W.partitionBy(*path)
    before = whole.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    chunks = (
        rows.groupBy(*path, "chunk")
        .agg(F.count("*").alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"))
        .select(
            *path,
            "chunk",
            (F.sum("total").over(whole) / F.sum("n_values").over(whole)).alias("mean_value"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("days_before"),
            F.coalesce(F.sum("n_values").over(before), F.lit(0)).alias("values_before"),
            F.coalesce(F.sum("total").over(before), zero).alias("total_before"),
        )
        # Laid out like the rows, so that not the rows move to where their whole path is.
        .repartition(*path, "chunk")
    )
    inside = W.partitionBy(*path, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    pnl_before = (F.col("total_before") - F.col("mean_value") * F.col("values_before")) / scale
    return (
        rows.join(chunks, [*path, "chunk"])
        .withColumn("r", (F.col(value) - F.col("mean_value")) / scale)
        .withColumns(
            {
                "day": F.row_number().over(inside).cast("bigint") + F.col("days_before"),
                "pnl": F.coalesce(F.sum("r").over(inside), zero) + pnl_before,
            }
        )
        .drop("chunk", "mean_value", "days_before", "values_before", "total_before")
    )


def ordered_pnl(events: DataFrame, path: list[str], order: list[str], value: str, scale: float) -> DataFrame:
    """`centred_pnl` with each path added up row after row, as one window does it.

    A path is one task's; for the few paths whose last digits matter. -> adds (r, day, pnl)
    """
    so_far = W.partitionBy(*path).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    means = (
        events.withColumn("total", F.sum(value).over(so_far))
        .groupBy(*path)
        .agg((F.max_by("total", F.struct(*order)) / F.count(value)).alias("mean_value"))
    )
    rows = events.join(means, path).withColumn("r", (F.col(value) - F.col("mean_value")) / scale).drop("mean_value")
    return rows.withColumns(
        {"day": F.row_number().over(so_far).cast("bigint"), "pnl": F.coalesce(F.sum("r").over(so_far), F.lit(0.0))}
    )
