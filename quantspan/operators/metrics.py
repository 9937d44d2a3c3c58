"""Performance of return series (*by, dt, ret).

Running values (equity, peaks, the row before) go through chunks of a quarter (`scans`), so one
long series is spread over tasks too; the rest are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import DAYS_PER_YEAR, SharpeReference
from quantspan.functions.scalars import bucket_label, finite, ratio
from quantspan.operators import scans
from quantspan.operators.returns import observed_bars_per_year
from quantspan.session import materialize

PANEL = ("panel",)


def bars_per_year_of(ret: str = "ret") -> Column:
    """Aggregate: observed bars per year over the rows with a return."""
    dated = F.when(F.col(ret).isNotNull(), F.col("dt"))
    return observed_bars_per_year(F.count(dated), F.min(dated), F.max(dated))


def sharpe_of(ret: str = "ret", periods_per_year: float | None = None) -> Column:
    """Aggregate: annualised mean over population deviation, 0 for a flat series."""
    per_year = bars_per_year_of(ret) if periods_per_year is None else F.lit(float(periods_per_year))
    deviation = F.stddev_pop(ret)
    return F.coalesce(
        F.sqrt(per_year) * F.avg(ret) / F.when(deviation > 0, deviation), F.lit(0.0)
    )


def bars_per_year(returns: DataFrame, by=PANEL) -> DataFrame:
    return returns.groupBy(*by).agg(bars_per_year_of().alias("bars_per_year"))


def sharpe(returns: DataFrame, by=PANEL, periods_per_year: float | None = None) -> DataFrame:
    return returns.groupBy(*by).agg(sharpe_of(periods_per_year=periods_per_year).alias("sharpe"))


def _compounded(returns: DataFrame, by, order: str = "dt") -> DataFrame:
    growth = F.lit(1.0) + F.coalesce("ret", F.lit(0.0))
    return scans.compounded(returns, list(by), [order], growth, scans.chunk_of(returns, order))


def equity_curve(returns: DataFrame, by=PANEL) -> DataFrame:
    """Compounded value of 1.0; a missing return counts as 0 -> adds equity."""
    return _compounded(returns, by).drop("peak")


def drawdown(returns: DataFrame, by=PANEL) -> DataFrame:
    """Distance of the equity from its highest value so far -> adds (equity, drawdown).

    The first peak is the first equity value, not the initial 1.0.
    """
    found = _compounded(returns, by)
    return found.withColumn("drawdown", ratio(F.col("equity"), F.col("peak")) - 1.0).drop("peak")


def metrics(returns: DataFrame, by=PANEL) -> DataFrame:
    """-> (*by, n_obs, sharpe, max_drawdown, total_return, mean_daily, std_daily, final_equity)"""
    final = F.max_by("equity", "dt")
    return (
        drawdown(returns, by)
        .groupBy(*by)
        .agg(
            F.count("ret").alias("n_obs"),
            sharpe_of().alias("sharpe"),
            F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
            (final - 1.0).alias("total_return"),
            F.avg("ret").alias("mean_daily"),
            F.stddev_pop("ret").alias("std_daily"),
            final.alias("final_equity"),
        )
    )


def frame_lengths(calendar: DataFrame) -> DataFrame:
    """What a sparse series leaves out -> (panel, n_frame, first_dt, last_dt)"""
    return calendar.groupBy("panel").agg(
        F.count("*").alias("n_frame"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


def _whole_moments() -> dict[str, Column]:
    """Moments of a whole frame from those of its active days (n_active, mean_active, var_active)."""
    n, some = F.col("n_frame"), F.coalesce("n_active", F.lit(0))
    mean = F.coalesce("mean_active", F.lit(0.0)) * some / n
    apart = F.coalesce("mean_active", F.lit(0.0)) - mean
    var = (some * (F.coalesce("var_active", F.lit(0.0)) + apart * apart) + (n - some) * mean * mean) / n
    per_year = observed_bars_per_year(n, F.col("first_dt"), F.col("last_dt"))
    deviation = F.sqrt(var)
    sharpe_ = F.coalesce(F.sqrt(per_year) * mean / F.when(deviation > 0, deviation), F.lit(0.0))
    return {"sharpe": sharpe_, "mean_daily": mean, "std_daily": deviation}


def _active_moments() -> list[Column]:
    return [F.count("ret").alias("n_active"), F.avg("ret").alias("mean_active"), F.var_pop("ret").alias("var_active")]


def sparse_sharpe(active: DataFrame, strategies: DataFrame, by=PANEL) -> DataFrame:
    """`sharpe` of series whose missing dates are returns of zero, counted by their number.

    active(*by, dt, ret) has the dates on which a strategy earns or pays anything; strategies
    (*by, n_frame, first_dt, last_dt) are all of them with their frames. -> (*by, sharpe)
    """
    by = list(by)
    moments = active.groupBy(*by).agg(*_active_moments())
    return strategies.join(moments, by, "left").select(*by, _whole_moments()["sharpe"].alias("sharpe"))


def sparse_metrics(active: DataFrame, strategies: DataFrame, by=PANEL) -> DataFrame:
    """`metrics` of series whose missing dates are returns of zero, see `sparse_sharpe`.

    The equity stands still on those dates. They add to its peak only before the first active
    one: there it is the initial 1.0.
    """
    by = list(by)
    level = F.col("equity")
    found = (
        _compounded(active, by)
        .groupBy(*by)
        .agg(
            *_active_moments(),
            F.min("dt").alias("start"),
            F.min(ratio(level, F.col("peak")) - 1.0).alias("from_peak"),
            F.min(ratio(level, F.greatest("peak", F.lit(1.0))) - 1.0).alias("from_one"),
            F.max_by("equity", "dt").alias("final"),
        )
    )
    worst = F.when(F.col("start") > F.col("first_dt"), F.col("from_one")).otherwise(F.col("from_peak"))
    final = F.coalesce("final", F.lit(1.0))
    moments = _whole_moments()
    return strategies.join(found, by, "left").select(
        *by,
        F.col("n_frame").alias("n_obs"),
        moments["sharpe"].alias("sharpe"),
        F.coalesce(worst, F.lit(0.0)).alias("max_drawdown"),
        (final - 1.0).alias("total_return"),
        moments["mean_daily"].alias("mean_daily"),
        moments["std_daily"].alias("std_daily"),
        final.alias("final_equity"),
    )


def sampled_equity(returns: DataFrame, by=PANEL, points: int = 20) -> DataFrame:
    """Every n-th row of the equity curve, n = rows // points and at least 1."""
    by = list(by)
    steps = returns.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / points)).alias("step"))
    numbered = scans.running(equity_curve(returns, by), by, ["dt"], scans.quarter_of(F.col("dt")), i=scans.Running("count", F.lit(1)))
    return (
        numbered.join(steps, by)
        .where((F.col("i") - 1) % F.col("step") == 0)
        .select(*by, "dt", "equity")
    )


def return_histogram(returns: DataFrame, by=PANEL, bins: int = 10) -> DataFrame:
    """Equal-width bins from the smallest to the largest return, the last one closed.

    A constant series gets a range of one around its value. Empty bins are kept. The returns
    are stored once, because ranges and counts both read them.
    -> (*by, bin, low, high, label, n)
    """
    by = list(by)
    usable = returns.select(*by, finite(F.col("ret")).alias("ret")).where(F.col("ret").isNotNull())
    usable = materialize(usable, "returns")
    flat = F.min("ret") == F.max("ret")
    ranges = materialize(
        usable.groupBy(*by).agg(
            (F.min("ret") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
            (F.max("ret") + F.when(flat, 0.5).otherwise(0.0)).alias("hi"),
        ),
        "ranges",
    )
    width = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.floor((F.col("ret") - F.col("lo")) / width), F.lit(bins - 1))
    # A quotient can round across an edge; the edges themselves decide.
    settled = (
        F.when(F.col("ret") < F.col("lo") + F.col("guess") * width, F.col("guess") - 1)
        .when(
            (F.col("guess") < bins - 1) & (F.col("ret") >= F.col("lo") + (F.col("guess") + 1) * width),
            F.col("guess") + 1,
        )
        .otherwise(F.col("guess"))
    )
    counts = (
        usable.join(ranges, by)
        .withColumn("guess", guess)
        .withColumn("bin", settled)
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"))
    )
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    low = F.col("lo") + F.col("bin") * width
    high = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return (
        spine.join(counts, [*by, "bin"], "left")
        .withColumns({"low": low, "high": high})
        .select(
            *by,
            "bin",
            "low",
            "high",
            bucket_label(F.col("low"), F.col("high")).alias("label"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def subperiod_stats(returns: DataFrame, by=PANEL) -> DataFrame:
    """Ratio and compounded return per `period` (see `clean.split_period`)."""
    growth = F.product(F.lit(1.0) + F.coalesce("ret", F.lit(0.0)))
    return returns.groupBy(*by, "period").agg(
        sharpe_of().alias("sharpe"), (growth - 1.0).alias("total_return")
    )


def drawdown_over_vol(returns: DataFrame, by=PANEL) -> DataFrame:
    """Worst drawdown in units of annualised volatility (population deviation)."""
    stats = drawdown(returns, by).groupBy(*by).agg(
        F.min("drawdown").alias("max_drawdown"),
        (F.stddev_pop("ret") * F.sqrt(bars_per_year_of())).alias("annual_vol"),
    )
    return stats.withColumn(
        "dd_over_vol", ratio(F.abs("max_drawdown"), F.col("annual_vol"))
    )


def annual_turnover(daily: DataFrame, by=PANEL) -> DataFrame:
    """Yearly sum of absolute weight changes over a window of daily totals.

    The first date's change is an entry into the window and is not counted; `turnover` of
    every later date is the sum over instruments of |weight change|.
    """
    first = F.min_by("turnover", "dt")
    years = F.datediff(F.max("dt"), F.min("dt")) / DAYS_PER_YEAR
    return daily.groupBy(*by).agg(
        ratio(F.sum("turnover") - first, years).alias("annual_turnover")
    )


def reference_sharpe_check(
    returns: DataFrame, reference: SharpeReference = SharpeReference(), by=PANEL
) -> DataFrame:
    """Whether each series' ratio lies within the tolerance of a published one."""
    return sharpe(returns, by).withColumn(
        "within", F.abs(F.col("sharpe") - reference.value) <= reference.tolerance
    )


def squared_autocorrelation(returns: DataFrame, by=PANEL, order: str = "dt", chunk: Column | None = None) -> DataFrame:
    """Lag-one autocorrelation of centred squared returns: a volatility-clustering gauge.

    `chunk` grows with `order`, which is a date or a row number where no chunk is given.
    """
    by = list(by)
    squares = returns.select(*by, order, (F.col("ret") * F.col("ret")).alias("sq"))
    chunk = scans.chunk_of(returns, order) if chunk is None else chunk
    paired = scans.lagged(squares, by, [order], "sq", "before", chunk)
    means = squares.groupBy(*by).agg(F.avg("sq").alias("mean_sq"))
    own, before = F.col("sq") - F.col("mean_sq"), F.col("before") - F.col("mean_sq")
    return paired.join(means, by).groupBy(*by).agg(ratio(F.sum(own * before), F.sum(own * own)).alias("acf"))
