"""Turn-of-month window: flags, mean contrast, random-day benchmark, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import DAYS_PER_YEAR
from quantspan.functions.scalars import hashed_draw, ratio
from quantspan.operators.align import traded
from quantspan.operators.bootstrap import (
    block_draws,
    indexed_series,
    path_ids,
    task_count,
    wrapped_blocks,
)
from quantspan.operators.returns import own_calendar_returns
from quantspan.session import join_side, materialize

ALL = "ALL"


def tom_flag(prices: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Last `before` and first `after` own trading days of each month -> adds tom."""
    month = W.partitionBy("panel", "instrument", F.trunc("dt", "MM"))
    opening = F.row_number().over(month.orderBy("dt")) <= after
    closing = F.row_number().over(month.orderBy(F.desc("dt"))) <= before
    return traded(prices).withColumn("tom", opening | closing)


def flagged_returns(prices: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Own-day returns with their flag -> (panel, instrument, dt, ret, tom)"""
    return (
        own_calendar_returns(tom_flag(prices, before, after))
        .where(F.col("own_ret").isNotNull())
        .select("panel", "instrument", "dt", F.col("own_ret").alias("ret"), "tom")
    )


def contrast_days(flagged: DataFrame) -> DataFrame:
    """Sums and counts inside and outside the window per date, per instrument and pooled.

    The pooled series adds up the instruments of a date before anything is resampled, so
    it keeps their co-movement and is no longer than the calendar.
    -> (panel, instrument, dt, s1, n1, s0, n0)
    """
    inside = F.col("tom")
    each = flagged.withColumns(
        {
            "s1": F.when(inside, F.col("ret")).otherwise(0.0),
            "n1": inside.cast("double"),
            "s0": F.when(inside, 0.0).otherwise(F.col("ret")),
            "n0": (~inside).cast("double"),
        }
    ).select("panel", "instrument", "dt", "s1", "n1", "s0", "n0")
    pooled = (
        each.groupBy("panel", "dt")
        .agg(*[F.sum(c).alias(c) for c in ("s1", "n1", "s0", "n0")])
        .withColumn("instrument", F.lit(ALL))
    )
    return each.unionByName(pooled)


def _contrast(s1, n1, s0, n0):
    return ratio(s1, n1) - ratio(s0, n0)


def mean_contrast(
    flagged: DataFrame, n_paths: int = 1000, block_size: int = 20, seed: int = 12345
) -> DataFrame:
    """Mean return inside minus outside, with a block-bootstrap error and 95 % interval.

    Each path resamples as many days as the series has. A block enters as four totals.
    -> (panel, instrument, contrast_bp, se_bp, ci_low_bp, ci_high_bp)
    """
    by = ["panel", "instrument"]
    days = contrast_days(flagged)
    observed = days.groupBy(*by).agg(
        _contrast(F.sum("s1"), F.sum("n1"), F.sum("s0"), F.sum("n0")).alias("observed")
    )
    item = F.struct("s1", "n1", "s0", "n0")
    tail = (F.col("n") - (F.ceil(F.col("n") / block_size) - 1) * block_size).cast("int")
    kept = F.slice("items", F.lit(1), F.col("len"))

    def total(name: str):
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x[name]).alias(name)

    totals = [total(c) for c in ("s1", "n1", "s0", "n0")]
    blocks = materialize(
        wrapped_blocks(indexed_series(days, by), by, item, block_size)
        .withColumn("len", F.explode(F.array_distinct(F.array(F.lit(block_size), tail))))
        .select(*by, "n", "start", "len", *totals),
        "contrast-blocks",
    )
    sizes = blocks.where(F.col("start") == 0).select(*by, "n").distinct()
    paths = path_ids(sizes, by, ["path"], n_paths).withColumn("horizon", F.col("n"))
    resampled = (
        block_draws(paths, block_size, F.lit(seed))
        .drop("n")
        .join(join_side(blocks.drop("n")), [*by, "start", "len"])
        .groupBy(*by, "path")
        .agg(_contrast(F.sum("s1"), F.sum("n1"), F.sum("s0"), F.sum("n0")).alias("drawn"))
    )
    spread = resampled.groupBy(*by).agg(
        F.stddev_samp("drawn").alias("se"),
        F.percentile("drawn", F.lit(0.025)).alias("low"),
        F.percentile("drawn", F.lit(0.975)).alias("high"),
    )
    return observed.join(spread, by).select(
        *by,
        (F.col("observed") * 1e4).alias("contrast_bp"),
        (F.col("se") * 1e4).alias("se_bp"),
        (F.col("low") * 1e4).alias("ci_low_bp"),
        (F.col("high") * 1e4).alias("ci_high_bp"),
    )


def random_subset(n: Column, k: int, *parts: Column) -> Column:
    """`k` different integers of [0, n), all of them where n is smaller -> ARRAY<BIGINT>

    Floyd's selection: the i-th step draws from one integer more than the step before, and takes
    the new one where the draw is already chosen. Every subset is equally likely, and the work
    is k draws however large n is. Draws depend on `parts` and the step only.
    """

    def add(chosen: Column, j: Column) -> Column:
        drawn = hashed_draw(j + 1, *parts, j)
        return F.array_append(chosen, F.when(F.array_contains(chosen, drawn), j).otherwise(drawn))

    steps = F.sequence(F.greatest(n - k, F.lit(0)), n - 1).cast("array<bigint>")
    return F.aggregate(steps, F.array().cast("array<bigint>"), add)


def random_days(days: DataFrame, n_resamples: int = 1000, per_month: int = 4, seed: int = 12345) -> DataFrame:
    """`per_month` dates of each month at random, in every resample -> (panel, resample, pos)

    days(panel, dt, pos) holds one row per frame date, `pos` counting them from 0. A month is
    its first position and its length; only chosen days become rows. Resamples are laid out as
    bare ids and take the months in afterwards, so later windows over (panel, resample) find
    their rows in place.
    """
    months = materialize(
        days.groupBy("panel", F.trunc("dt", "MM").alias("month")).agg(F.count("*").alias("n"), F.min("pos").alias("first")),
        "months",
    )
    resamples = F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)))
    seeds = months.select("panel").distinct().withColumn("resample", resamples)
    chosen = random_subset(F.col("n"), per_month, F.lit(seed), F.col("resample"), F.col("month"))
    return (
        seeds.repartition(task_count(days), "panel", "resample")
        .join(join_side(months), "panel")
        .select("panel", "resample", "first", F.explode(chosen).alias("i"))
        .select("panel", "resample", (F.col("first") + F.col("i")).alias("pos"))
    )


def null_p_value(null: DataFrame, observed: DataFrame) -> DataFrame:
    """Place an observed ratio in the distribution of the random-day ones.

    null(panel, resample, sharpe), observed(panel, sharpe)
    -> (panel, sharpe, null_mean, null_p95, p_value)
    """
    seen = observed.select("panel", F.col("sharpe").alias("seen"))
    return null.join(seen, "panel").groupBy("panel").agg(
        F.max("seen").alias("sharpe"),
        F.avg("sharpe").alias("null_mean"),
        F.percentile("sharpe", F.lit(0.95)).alias("null_p95"),
        F.avg((F.col("sharpe") >= F.col("seen")).cast("double")).alias("p_value"),
    )


def sharpe_ci(ratios: DataFrame, low_mark: float = 0.2, high_mark: float = 0.4) -> DataFrame:
    """Sampling error of an annualised ratio over `years` and its 95 % interval.

    `underpowered` when the interval spans both marks. ratios(panel, sharpe, years)
    """
    error = F.sqrt((1.0 + F.col("sharpe") * F.col("sharpe") / 2.0) / F.col("years"))
    spans = (F.col("ci_low") < low_mark) & (F.col("ci_high") > high_mark)
    return (
        ratios.withColumn("se", error)
        .withColumns(
            {
                "ci_low": F.col("sharpe") - 1.96 * F.col("se"),
                "ci_high": F.col("sharpe") + 1.96 * F.col("se"),
            }
        )
        .withColumn("status", F.when(spans, "underpowered").otherwise("resolved"))
    )


def years_observed(returns: DataFrame) -> DataFrame:
    return returns.groupBy("panel").agg(
        (F.datediff(F.max("dt"), F.min("dt")) / F.lit(DAYS_PER_YEAR)).alias("years")
    )


def relative_verdict(placed: DataFrame) -> DataFrame:
    """Verdict against the random-day benchmark.

    placed(panel, sharpe, null_p95, status, ci_high, contrast_low), status as `sharpe_ci` has
    it: underpowered when the interval of the ratio spans both marks, whatever else holds.
    Else viable when the ratio beats the benchmark's 95th percentile and the mean contrast is
    positive with certainty, parked when only the first holds, underpowered when it does not
    beat it but its interval still reaches it; dead otherwise.
    """
    beats = F.col("sharpe") > F.col("null_p95")
    verdict = (
        F.when(F.col("status") == "underpowered", "underpowered")
        .when(beats & (F.col("contrast_low") > 0), "viable")
        .when(beats, "parked")
        .when(F.col("ci_high") > F.col("null_p95"), "underpowered")
        .otherwise("dead")
    )
    return placed.withColumn("verdict", verdict)

