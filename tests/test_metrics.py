import numpy as np
import pandas as pd
import pytest
from conftest import series, to_returns

from quantspan.config import SharpeReference
from quantspan.operators import metrics as M


def sample(n=300, seed=3):
    return np.random.default_rng(seed).normal(0.0003, 0.01, n)


def test_drawdown_golden(spark):
    r = to_returns(spark, [0.10, -0.50])
    assert series(M.equity_curve(r), "equity").tolist() == pytest.approx([1.1, 0.55])
    assert M.metrics(r).first().max_drawdown == pytest.approx(-0.5)


def test_first_peak_is_the_first_equity_value(spark):
    assert M.metrics(to_returns(spark, [-0.2, 0.1])).first().max_drawdown == 0.0


def test_metrics_against_numpy(spark):
    r = sample()
    m = M.metrics(to_returns(spark, r)).first()
    equity = np.cumprod(1 + r)
    days = pd.bdate_range("2015-01-01", periods=len(r))
    per_year = len(r) / ((days[-1] - days[0]).days / 365.25)
    assert m.n_obs == 300
    assert m.sharpe == pytest.approx(np.sqrt(per_year) * r.mean() / r.std())
    assert m.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
    assert m.total_return == pytest.approx(equity[-1] - 1)
    assert (m.mean_daily, m.std_daily) == pytest.approx((r.mean(), r.std()))


def test_flat_series_has_ratio_zero(spark):
    assert M.sharpe(to_returns(spark, [0.001] * 20)).first().sharpe == 0.0


def test_one_observation_uses_the_default_year(spark):
    assert M.bars_per_year(to_returns(spark, [0.01])).first().bars_per_year == 252.0


@pytest.mark.parametrize("values", [sample(), np.full(7, 0.02)])
def test_histogram_is_numpys(spark, values):
    rows = M.return_histogram(to_returns(spark, values)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r.n for r in rows] == counts.tolist()
    np.testing.assert_allclose([r.low for r in rows] + [rows[-1].high], edges, atol=1e-12)
    assert rows[0].label == f"[{edges[0]:+.4f}, {edges[1]:+.4f})"


@pytest.mark.parametrize("n, step", [(15, 1), (45, 2), (300, 15)])
def test_equity_is_sampled_every_step(spark, n, step):
    got = M.sampled_equity(to_returns(spark, sample(n))).orderBy("dt").toPandas()
    np.testing.assert_allclose(got.equity, np.cumprod(1 + sample(n))[::step])


def test_reference_band(spark):
    r = to_returns(spark, sample())
    ratio = M.sharpe(r).first().sharpe
    inside = SharpeReference(value=ratio + 0.05, tolerance=0.1)
    outside = SharpeReference(value=ratio + 0.15, tolerance=0.1)
    assert M.reference_sharpe_check(r, inside).first().within
    assert not M.reference_sharpe_check(r, outside).first().within


def test_first_change_of_a_window_is_not_turnover(spark):
    daily = to_returns(spark, [5.0, 1.0, 1.0]).withColumnRenamed("ret", "turnover")
    years = 4 / 365.25  # Thursday to Monday
    assert M.annual_turnover(daily).first().annual_turnover == pytest.approx(2.0 / years)
