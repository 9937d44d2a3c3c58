"""Comparing trials: multiplicity-corrected ratios and pre-registered verdicts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.config import EULER_GAMMA, StudyThresholds
from quantspan.functions.scalars import normal_ppf


def deflated_sharpe(trials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best ratio of a set of trials minus the best one expected from luck alone.

    -> (*by, n_trials, best, expected_max, deflated)
    """
    n = F.col("n_trials").cast("double")
    g = EULER_GAMMA
    luck = F.col("deviation") * (
        (1.0 - g) * normal_ppf(1.0 - 1.0 / n) + g * normal_ppf(1.0 - 1.0 / (n * math.e))
    )
    return (
        trials.groupBy(*by)
        .agg(
            F.count("sharpe").alias("n_trials"),
            F.max("sharpe").alias("best"),
            F.stddev_samp("sharpe").alias("deviation"),
        )
        .withColumn("expected_max", F.when(F.col("n_trials") < 2, F.lit(0.0)).otherwise(luck))
        .select(*by, "n_trials", "best", "expected_max", (F.col("best") - F.col("expected_max")).alias("deflated"))
    )


def best_trial(trials: DataFrame, *names: str) -> DataFrame:
    """The trial with the highest ratio; of equal ones the one with the greatest names."""
    best = trials.where(F.col("sharpe").isNotNull()).agg(F.max(F.struct("sharpe", *names)).alias("best"))
    return best.select("best.sharpe", *[F.col(f"best.{c}").alias(c) for c in names])


def sample_verdict(ratios: DataFrame, limits: StudyThresholds = StudyThresholds()) -> DataFrame:
    return ratios.withColumn(
        "verdict",
        F.when(F.col("sharpe") >= limits.success, "viable")
        .when(F.col("sharpe") < limits.falsifier, "dead")
        .otherwise("marginal"),
    )


def global_verdict(verdicts: DataFrame) -> DataFrame:
    """One verdict over all samples -> (verdict, any_marginal, degraded)

    `degraded`: the first sample by name is viable, the last one dead.
    """
    def has(label):
        return F.bool_or(F.col("verdict") == label)

    return verdicts.agg(
        F.when(has("viable"), "viable")
        .when(F.bool_and(F.col("verdict") == "dead"), "dead")
        .otherwise("marginal")
        .alias("verdict"),
        has("marginal").alias("any_marginal"),
        (
            (F.min_by("verdict", "panel") == "viable") & (F.max_by("verdict", "panel") == "dead")
        ).alias("degraded"),
    )
