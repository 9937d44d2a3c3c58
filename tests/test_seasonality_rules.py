"""Every branch of the verdicts, on values worked out by hand."""

import pytest

from quantspan.operators import exposure, seasonality, trials


def test_relative_verdict_reaches_every_branch(spark):
    cases = [
        ("a", 0.7, 0.6, "underpowered", 1.3, 2.0, "underpowered"),  # its interval spans both marks
        ("b", 0.9, 0.6, "resolved", 1.2, 1.0, "viable"),
        ("c", 0.9, 0.6, "resolved", 1.2, -1.0, "parked"),
        ("d", 0.5, 0.6, "resolved", 0.7, 1.0, "underpowered"),
        ("e", 0.1, 0.6, "resolved", 0.3, 1.0, "dead"),
    ]
    placed = spark.createDataFrame(
        [c[:6] for c in cases], "panel string, sharpe double, null_p95 double, status string, ci_high double, contrast_low double"
    )
    got = {r.panel: r.verdict for r in seasonality.relative_verdict(placed).collect()}
    assert got == {c[0]: c[6] for c in cases}


def test_interval_of_the_card(spark):
    """0.7 over twelve years: 0.7 +- 1.96 * sqrt(1.245 / 12)."""
    row = seasonality.sharpe_ci(spark.createDataFrame([("p", 0.7, 12.0)], "panel string, sharpe double, years double")).first()
    assert (row.ci_low, row.ci_high) == (pytest.approx(0.0687, abs=1e-3), pytest.approx(1.3313, abs=1e-3))
    assert row.status == "underpowered"


def test_weights_beyond_the_cap_are_reported(spark):
    rows = [("p", i, "2020-01-02", 2.0) for i in "ABC"] + [("p", "A", "2020-01-03", 1.0)]
    weights = spark.createDataFrame(rows, "panel string, instrument string, dt string, w double").selectExpr("panel", "instrument", "cast(dt as date) AS dt", "w")
    assert exposure.exposure_violations(weights).count() == 1
    with pytest.raises(ValueError):
        exposure.validate_weights(weights)


@pytest.mark.parametrize(
    "first, last, overall, degraded",
    [(0.5, 0.1, "viable", True), (0.1, 0.5, "viable", False), (0.1, 0.1, "dead", False), (0.3, 0.1, "marginal", False)],
)
def test_samples_together(spark, first, last, overall, degraded):
    ratios = spark.createDataFrame([("A", first), ("B", last)], "panel string, sharpe double")
    row = trials.global_verdict(trials.sample_verdict(ratios)).first()
    assert (row.verdict, row.degraded, row.any_marginal) == (overall, degraded, overall == "marginal")
