import numpy as np
import pandas as pd
import pytest
from conftest import business_days, series, to_prices, to_weights, walk

from quantspan.config import CostModel
from quantspan.operators import backtest as bt
from quantspan.operators import exposure, metrics
from quantspan.plans import signals


def plain_backtest(prices, weights, rate, swap):
    """One account, day by day: a position decided on one date earns until the next one."""
    fees = {c: [x[c] if hasattr(x, "index") else x for x in (rate, swap)] for c in prices.columns}
    wanted = {(d, c): float(v) for c in weights.columns for d, v in weights[c].items() if v == v}
    quote, position, days = {}, dict.fromkeys(prices.columns, 0.0), []
    for d in prices.index:
        account = 0.0
        for c in prices.columns:
            price = float(prices.at[d, c])
            if not np.isnan(price):
                if quote.get(c):
                    account += position[c] * (price / quote[c] - 1)
                quote[c] = price
            target = wanted.get((d, c), 0.0)
            account -= fees[c][1] * abs(position[c]) + fees[c][0] * abs(target - position[c])
            position[c] = target
        days.append(account)
    return pd.Series(days, index=prices.index)


def two_instruments(n=120, seed=4):
    rng = np.random.default_rng(seed)
    days = business_days("2020-01-01", n)
    prices = pd.DataFrame({"A": walk(n, seed), "B": walk(n, seed + 9)}, index=days)
    prices.loc[rng.random(n) < 0.2, "B"] = np.nan
    weights = pd.DataFrame(rng.normal(0, 0.5, (n, 2)), index=days, columns=["A", "B"])
    return prices, weights, rng


def test_matches_a_dense_computation(spark):
    prices, weights, _ = two_instruments()
    got = series(bt.backtest(to_prices(spark, prices), to_weights(spark, weights)), "ret")
    want = plain_backtest(prices, weights, 0.00015, 0.00003)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_missing_weights_are_flat_and_stray_dates_are_ignored(spark):
    prices, weights, rng = two_instruments(seed=6)
    weights = weights.where(rng.random(weights.shape) < 0.5)
    stray = pd.DataFrame({"A": [5.0], "B": [5.0]}, index=[pd.Timestamp("2020-01-04").date()])
    got = series(
        bt.backtest(to_prices(spark, prices), to_weights(spark, pd.concat([weights, stray]))), "ret"
    )
    want = plain_backtest(prices, weights, 0.00015, 0.00003)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_holding_charge_on_a_flat_price(spark):
    days = business_days("2020-01-01", 10)
    flat = pd.DataFrame({"A": [100.0] * 10}, index=days)
    costs = CostModel(0.0, 0.0, 0.0, 0.0, 0.001)
    got = series(bt.backtest(to_prices(spark, flat), to_weights(spark, flat / 100), costs), "ret")
    assert got.iloc[0] == 0.0
    np.testing.assert_allclose(got.iloc[1:], -0.001)


def test_constant_weight_pays_only_the_entry(spark):
    days = business_days("2020-01-01", 50)
    prices = pd.DataFrame({"A": walk(50, 7)}, index=days)
    p, w = to_prices(spark, prices), to_weights(spark, prices * 0 + 1)
    costs = CostModel(swap=0.0)
    gap = series(bt.backtest(p, w, costs, apply_costs=False), "ret") - series(bt.backtest(p, w, costs), "ret")
    assert gap.iloc[0] == pytest.approx(costs.rate)
    np.testing.assert_allclose(gap.iloc[1:], 0.0, atol=1e-15)


def test_listed_costs_and_the_default(spark):
    prices, weights, _ = two_instruments(seed=8)
    listed = spark.createDataFrame(
        [("A", 0.01, 0.0, 0.002, 0.0, 0.0005)],
        "instrument string, spread double, slippage double, impact double, commission double, swap double",
    )
    got = series(bt.backtest(to_prices(spark, prices), to_weights(spark, weights), listed), "ret")
    rate = pd.Series({"A": 0.012, "B": 0.00015})
    swap = pd.Series({"A": 0.0005, "B": 0.00003})
    want = plain_backtest(prices, weights, rate, swap)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_several_strategies_in_one_run(spark):
    prices, weights, _ = two_instruments(seed=10)
    both = to_weights(spark, weights).selectExpr("panel", "1 as spec", "instrument", "dt", "w").unionByName(
        to_weights(spark, weights * -0.5).selectExpr("panel", "2 as spec", "instrument", "dt", "w")
    )
    got = bt.backtest(to_prices(spark, prices), both, by=("panel", "spec")).toPandas()
    for spec, scale in ((1, 1.0), (2, -0.5)):
        mine = got[got.spec == spec].sort_values("dt").ret.to_numpy()
        np.testing.assert_allclose(mine, plain_backtest(prices, weights * scale, 0.00015, 0.00003), atol=1e-12)


def test_exposure_cap(spark):
    days = business_days("2020-01-01", 5)
    heavy = to_weights(spark, pd.DataFrame(2.0, index=days, columns=list("ABC")))
    light = to_weights(spark, pd.DataFrame(1.0, index=days, columns=list("ABC")))
    assert exposure.exposure_violations(heavy).count() == 5
    assert exposure.exposure_violations(light).count() == 0
    exposure.validate_weights(light)
    with pytest.raises(ValueError, match="5 date"):
        exposure.validate_weights(heavy)
    assert exposure.exposure_violations(exposure.gross_cap(heavy)).count() == 0


def test_equal_shares(spark):
    prices, _, _ = two_instruments(30)
    rows = signals.buy_and_hold(to_prices(spark, prices), 0.8).collect()
    assert len(rows) == 60 and {r.w for r in rows} == {0.4}


def test_looking_ahead_is_visible_and_honest_signals_are_not(spark):
    rng = np.random.default_rng(0)
    n = 1500
    prices = pd.DataFrame({"A": walk(n, 1), "B": walk(n, 2)}, index=business_days("2010-01-01", n))
    prices.loc[rng.random(n) < 0.15, "B"] = np.nan
    p = to_prices(spark, prices)

    def ratio(signal):
        return metrics.sharpe(bt.backtest(p, signal(p), apply_costs=False)).first().sharpe

    assert ratio(signals.sign_of_next_return) > 5
    assert ratio(signals.sign_of_last_return) < 2


def test_an_instrument_without_prices_costs_nothing(spark):
    """Ten days, half of the portfolio in a name the panel does not have; worked by hand."""
    days = business_days("2020-01-01", 10)
    flat = pd.DataFrame({"A": [100.0] * 10}, index=days)
    weights = pd.DataFrame({"A": [1.0] * 10, "GHOST": [1.0] * 10}, index=days)
    got = bt.daily_breakdown(to_prices(spark, flat), to_weights(spark, weights)).orderBy("dt").toPandas()
    assert got["turnover"].tolist() == [1.0] + [0.0] * 9
    assert got["held"].tolist() == [0.0] + [1.0] * 9
    np.testing.assert_allclose(got["swap_cost"], [0.0] + [0.00003] * 9)
