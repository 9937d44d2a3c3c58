"""First passage of additive profit and loss between a target and loss limits.

Only the first hit of each barrier matters, so nothing has to be frozen after it: the
outcome follows from the first day each condition holds, and those are plain minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.functions.scalars import ratio

PASSED, FAILED, UNRESOLVED = "PASSED", "FAILED", "UNRESOLVED"


def outcome_of(gain_day: Column, loss_day: Column) -> Column:
    """A loss on the day of the gain counts as a loss; reaching neither is its own outcome."""
    return (
        F.when(loss_day.isNotNull() & (gain_day.isNull() | (loss_day <= gain_day)), FAILED)
        .when(gain_day.isNotNull(), PASSED)
        .otherwise(UNRESOLVED)
    )


def _passages(
    steps: DataFrame, path: list[str], cases: list[tuple[dict[str, Column], Column, Column]], **also: Column
) -> DataFrame:
    """Outcome and absorption day of every path under each case, from one aggregation.

    A case has its labels and the conditions of a gain and of a loss; `also` are more aggregates.
    -> (*path, *labels, outcome, day, *also), the day being the path's length when no barrier is reached
    """
    days, rows = [value.alias(name) for name, value in also.items()], []
    for i, (labels, gained, lost) in enumerate(cases):
        days += [
            F.min(F.when(gained, F.col("day"))).alias(f"gain_{i}"),
            F.min(F.when(lost, F.col("day"))).alias(f"loss_{i}"),
        ]
        own = [value.alias(name) for name, value in labels.items()]
        rows.append(F.struct(*own, F.col(f"gain_{i}").alias("gain_day"), F.col(f"loss_{i}").alias("loss_day")))
    return (
        steps.groupBy(*path)
        .agg(*days, F.max("day").alias("horizon"))
        .select(*path, "horizon", *also, F.inline(F.array(*rows)))
        .select(
            *path,
            *cases[0][0],
            outcome_of(F.col("gain_day"), F.col("loss_day")).alias("outcome"),
            F.coalesce(F.least("gain_day", "loss_day"), F.col("horizon")).alias("day"),
            *also,
        )
    )


def _lost(daily_loss_limit: float, max_drawdown: float, k: float = 1.0) -> Column:
    return (F.col("r") <= -daily_loss_limit / k) | (F.col("pnl") <= -max_drawdown / k)


def first_passage(
    steps: DataFrame, path: list[str], target: float, daily_loss_limit: float, max_drawdown: float
) -> DataFrame:
    """Outcome and absorption day per path from steps(path, day, r, pnl).

    The day is the path's length when no barrier is reached. -> (*path, outcome, day)
    """
    return _passages(steps, path, [({}, F.col("pnl") >= target, _lost(daily_loss_limit, max_drawdown))])


def first_passage_or_near(
    steps: DataFrame, path: list[str], target: float, daily_loss_limit: float, max_drawdown: float, margin: float = 1e-9
) -> DataFrame:
    """`first_passage`, and whether a value of the path lies so near a limit that rounding decides.

    Sums carried from chunk to chunk differ from those of one pass in their last digits, which tells
    only where a value is on a limit: such paths are to be added up in order.
    -> (*path, outcome, day, near)
    """
    gaps = (F.col("pnl") - target, F.col("r") + daily_loss_limit, F.col("pnl") + max_drawdown)
    close = F.coalesce(F.max(F.least(*[F.abs(g) for g in gaps]) <= margin), F.lit(False))
    return _passages(steps, path, [({}, F.col("pnl") >= target, _lost(daily_loss_limit, max_drawdown))], near=close)


def first_passage_phases(
    steps: DataFrame, path: list[str], targets: dict[int, float], daily_loss_limit: float, max_drawdown: float
) -> DataFrame:
    """`first_passage` of the same histories under each phase's target, from one pass.

    -> (*path, phase, outcome, day)
    """
    lost = _lost(daily_loss_limit, max_drawdown)
    cases = [({"phase": F.lit(phase)}, F.col("pnl") >= target, lost) for phase, target in targets.items()]
    return _passages(steps, path, cases)


def first_passage_grid(
    steps: DataFrame,
    path: list[str],
    target: float,
    daily_loss_limit: float,
    max_drawdown: float,
    leverages: list[float],
) -> DataFrame:
    """`first_passage` at every leverage k from one pass: k * pnl >= target is
    pnl >= target / k, so each leverage is a pair of conditional minima.

    -> (*path, k, outcome, day)
    """
    cases = [
        ({"k": F.lit(float(k))}, F.col("pnl") >= target / k, _lost(daily_loss_limit, max_drawdown, k))
        for k in leverages
    ]
    return _passages(steps, path, cases)


def phase_stats(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of the three outcomes, share passed among the absorbed, mean absorption day.

    -> (*by, p_pass, p_fail, p_unresolved, p_cond, mean_absorb_day)
    """
    is_pass = (F.col("outcome") == PASSED).cast("double")
    is_fail = (F.col("outcome") == FAILED).cast("double")
    absorbed_day = F.when(F.col("outcome") != UNRESOLVED, F.col("day"))
    return (
        outcomes.groupBy(*(by or []))
        .agg(
            F.avg(is_pass).alias("p_pass"),
            F.avg(is_fail).alias("p_fail"),
            F.avg((F.col("outcome") == UNRESOLVED).cast("double")).alias("p_unresolved"),
            F.avg(absorbed_day).alias("mean_absorb_day"),
        )
        .withColumn(
            "p_cond",
            F.coalesce(ratio(F.col("p_pass"), F.col("p_pass") + F.col("p_fail")), F.lit(0.0)),
        )
    )


def payout_windows(
    steps: DataFrame, path: list[str], interval: int, daily_loss_limit: float, max_drawdown: float
) -> DataFrame:
    """Cut each path into windows of `interval` days that start from zero.

    A window survives when it touches no loss limit; the last one of a path may be short.
    The running sum is per window, so its partitions have at most `interval` rows.
    -> (*path, cycle, days, survived)
    """
    cycle = F.floor((F.col("day") - 1) / interval)
    inside = W.partitionBy(*path, "cycle").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    hit = (F.col("r") <= -daily_loss_limit) | (F.col("level") <= -max_drawdown)
    return (
        steps.withColumn("cycle", cycle)
        .withColumn("level", F.sum("r").over(inside))
        .groupBy(*path, "cycle")
        .agg(F.count("*").alias("days"), (~F.bool_or(hit)).alias("survived"))
    )


def funded_survival(windows: DataFrame, interval: int, by: list[str] | None = None) -> DataFrame:
    """Share of complete payout windows that survive -> (*by, p_survive)"""
    return (
        windows.where(F.col("days") == interval)
        .groupBy(*(by or []))
        .agg(F.avg(F.col("survived").cast("double")).alias("p_survive"))
    )
