"""Momentum study: every sample, lookback and holding charge in one job.

The panel-sized work (signal and daily totals) runs once per sample and lookback and is
written out as daily series; holding charges, windows, metrics and verdicts are then
arithmetic on those small series.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.config import HOLDOUT_START, CostModel, StudyThresholds
from quantspan.operators import metrics as M
from quantspan.operators.align import universe_filter
from quantspan.operators.backtest import daily_breakdown
from quantspan.operators.calendars import frame_calendar
from quantspan.operators.clean import before_holdout
from quantspan.operators.trials import deflated_sharpe, global_verdict, sample_verdict
from quantspan.plans.signals import momentum_grid
from quantspan.session import materialize

STRATEGY = ("panel", "lookback")
TRIAL = (*STRATEGY, "swap_bp")


def daily_series(
    prices: DataFrame,
    samples: DataFrame,
    eval_start: dict[str, str],
    limits: StudyThresholds = StudyThresholds(),
    holdout: dt.date | None = HOLDOUT_START,
) -> DataFrame:
    """Daily totals from each strategy's live start on -> (panel, lookback, dt, gross, ...)

    A strategy is live from the later of its sample's start and its first position. The reserved
    period from `holdout` on takes no part unless a study is exempt from it (None).
    """
    if holdout is not None:
        prices = before_holdout(prices, holdout)
    panels = universe_filter(prices, samples)
    panels = materialize(panels, "panels")
    calendar = materialize(frame_calendar(panels), "calendar")
    lookbacks = F.explode(F.array(*[F.lit(int(m)) for m in limits.lookbacks]))
    specs = calendar.select("panel").distinct().withColumn("lookback", lookbacks)
    weights = momentum_grid(panels, limits.lookbacks, calendar=calendar)
    daily = materialize(
        daily_breakdown(panels, weights, CostModel(), STRATEGY, calendar, specs), "daily"
    )
    starts = F.create_map(*[F.lit(v) for pair in eval_start.items() for v in pair])
    live = daily.groupBy(*STRATEGY).agg(
        F.greatest(
            F.min(F.when(F.col("turnover") > 0, F.col("dt"))),
            F.max(F.try_element_at(starts, F.col("panel"))).cast("date"),
        ).alias("start")
    )
    return daily.join(live, list(STRATEGY)).where(F.col("dt") >= F.col("start")).drop("start")


def trial_returns(daily: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    """Net returns for each holding charge -> (panel, lookback, swap_bp, dt, ret)"""
    swaps = F.explode(F.array(*[F.lit(float(s)) for s in limits.swaps_bp]))
    net = F.col("gross") - F.col("turnover_cost") - F.col("held") * F.col("swap_bp") * 1e-4
    return daily.withColumn("swap_bp", swaps).select(*TRIAL, "dt", net.alias("ret"))


def trial_sharpes(daily: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    return M.sharpe(trial_returns(daily, limits), TRIAL)


def swap_sensitivity(daily: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    """Ratio per sample with one column per holding charge, primary lookback."""
    swaps = [float(s) for s in limits.swaps_bp]
    primary = daily.where(F.col("lookback") == limits.lookbacks[0])
    wide = trial_sharpes(primary, limits).groupBy("panel").pivot("swap_bp", swaps).agg(F.max("sharpe"))
    return wide.select(
        "panel", *[F.col(f"`{s}`").alias(f"sharpe_{str(s).replace('.', '_')}bp") for s in swaps]
    )


def calibration(daily: DataFrame) -> DataFrame:
    """Ratio before costs and yearly turnover -> (panel, lookback, zero_cost_sharpe, annual_turnover)"""
    gross = M.sharpe(daily.select(*STRATEGY, "dt", F.col("gross").alias("ret")), STRATEGY)
    turned = M.annual_turnover(daily, STRATEGY)
    return gross.withColumnRenamed("sharpe", "zero_cost_sharpe").join(turned, list(STRATEGY))


def primary_trials(daily: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    """Trials that count: every sample and lookback at the primary holding charge."""
    one = StudyThresholds(
        limits.success, limits.falsifier, limits.primary_swap_bp, (limits.primary_swap_bp,), limits.lookbacks
    )
    return trial_sharpes(daily, one)


def verdict(daily: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    """Verdict per sample, over all samples, and after deflation if any is marginal.

    -> (panel, sharpe, verdict, global_verdict, degraded, attempts, deflated, promote)
    """
    trials = primary_trials(daily, limits)
    samples = sample_verdict(
        trials.where(F.col("lookback") == limits.lookbacks[0]).select("panel", "sharpe"), limits
    )
    overall = global_verdict(samples).withColumnRenamed("verdict", "global_verdict")
    deflation = deflated_sharpe(trials).select("n_trials", "deflated")
    one = F.lit(1).alias("one")
    combined = overall.select("*", one).join(deflation.select("*", one), "one")
    marginal = F.col("any_marginal")
    return samples.select("*", one).join(combined, "one").select(
        "panel",
        "sharpe",
        "verdict",
        "global_verdict",
        "degraded",
        F.when(marginal, F.col("n_trials"))
        .otherwise((F.col("n_trials") / len(limits.lookbacks)).cast("bigint"))
        .alias("attempts"),
        F.when(marginal, F.col("deflated")).alias("deflated"),
        F.when(marginal, F.col("deflated") > limits.success).alias("promote"),
    )


@dataclass(frozen=True)
class StudyTables:
    """The tables a study reports."""

    sensitivity: DataFrame
    calibration: DataFrame
    verdict: DataFrame
    deflation: DataFrame


def run_study(prices, samples, eval_start, limits: StudyThresholds = StudyThresholds()) -> StudyTables:
    daily = daily_series(prices, samples, eval_start, limits)
    return StudyTables(
        swap_sensitivity(daily, limits),
        calibration(daily),
        verdict(daily, limits),
        deflated_sharpe(primary_trials(daily, limits)),
    )
