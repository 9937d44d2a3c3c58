import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import business_days, to_prices, walk, wide

from quantspan.operators import align, calendars, returns


def gappy(n=400, seed=3, share=0.3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {"FX": walk(n, seed), "IDX": walk(n, seed + 1)}, index=business_days("2018-01-01", n)
    )
    frame.loc[rng.random(n) < share, "IDX"] = np.nan
    return frame


def test_move_across_a_gap_lands_on_the_reopening_day(spark):
    frame = pd.DataFrame({"A": walk(30, 0), "B": walk(30, 1)}, index=business_days("2020-01-01", 30))
    price = frame["B"].to_numpy().copy()
    frame.iloc[5, 1] = np.nan
    got = wide(returns.gap_safe_returns(to_prices(spark, frame)), "ret")["B"].to_numpy()
    assert got[5] == 0.0
    assert got[6] == pytest.approx(price[6] / price[4] - 1)


def test_frame_returns_match_forward_filled_changes(spark):
    frame = gappy()
    got = wide(returns.gap_safe_returns(to_prices(spark, frame)), "ret")
    want = frame.ffill().pct_change().fillna(0.0)
    np.testing.assert_allclose(got.to_numpy(), want[got.columns].to_numpy(), atol=1e-12)


def test_a_zero_price_never_gives_an_infinite_return(spark):
    frame = pd.DataFrame({"A": [100.0, 0.0, 101.0, 102.0]}, index=business_days("2020-01-01", 4))
    got = wide(returns.gap_safe_returns(to_prices(spark, frame)), "ret")["A"].tolist()
    assert got == pytest.approx([0.0, -1.0, 0.0, 102 / 101 - 1])


def test_days_before_the_first_price_are_in_the_frame(spark):
    frame = gappy(20)
    frame.iloc[:7, 1] = np.nan
    cells = align.price_frame(to_prices(spark, frame)).toPandas()
    assert len(cells) == 40
    early = cells[(cells.instrument == "IDX")].sort_values("dt").head(7)
    assert early.filled.isna().all() and early.close.isna().all()


def test_volatility_uses_own_days_and_own_year(spark):
    """Walked bar by bar: a full window of own moves sets the value, gaps keep it."""
    frame = gappy()
    got = wide(returns.rolling_vol(to_prices(spark, frame)), "vol")
    for name in frame.columns:
        bars = [(d, v) for d, v in frame[name].items() if v == v]
        days = [d for d, _ in bars[1:]]
        a_year = len(days) * 365.25 / (days[-1] - days[0]).days
        moves, before, seen = [], None, None
        for d in frame.index:
            value = frame.at[d, name]
            if value == value:
                moves += [value / before - 1] if before else []
                before = value
                if len(moves) >= 63:
                    seen = statistics.stdev(moves[-63:]) * a_year**0.5
            assert got.at[d, name] == (None if seen is None else pytest.approx(seen, rel=1e-9)) or (
                seen is None and np.isnan(got.at[d, name])
            )


def test_volatility_is_not_deflated_by_gaps(spark):
    frame = gappy()
    whole = frame[["FX"]].rename(columns={"FX": "IDX"})
    full = wide(returns.rolling_vol(to_prices(spark, whole), periods_per_year=252.0), "vol")["IDX"]
    holed = frame.copy()
    holed["IDX"] = frame["FX"].where(frame["IDX"].notna())
    sparse = wide(returns.rolling_vol(to_prices(spark, holed)), "vol")["IDX"]
    assert sparse.astype(float).mean() > 0.85 * full.astype(float).mean()


def test_lookback_takes_the_last_price_on_or_before(spark):
    days = [pd.Timestamp(d).date() for d in ("2019-02-26", "2019-02-28", "2019-03-04", "2020-02-29", "2020-03-03")]
    frame = pd.DataFrame({"A": [1.0, 2.0, 3.0, 4.0, 5.0]}, index=days)
    got = {str(r.dt): r.past for r in align.asof_lookback(to_prices(spark, frame), 12).collect()}
    assert got["2020-02-29"] == 2.0 and got["2020-03-03"] == 2.0 and got["2019-03-04"] is None


def test_rebalance_calendar_against_a_plain_search(spark):
    rng = np.random.default_rng(5)
    for trial in range(3):
        every = pd.date_range("2019-01-01", "2020-06-30")
        picked = every[rng.random(len(every)) < (0.05, 0.4, 0.9)[trial]]
        frame = pd.DataFrame({"A": np.ones(len(picked))}, index=[d.date() for d in picked])
        calendar = calendars.frame_calendar(to_prices(spark, frame))
        rows = calendars.rebalance_calendar(calendar).collect()
        starts = [d for d in pd.date_range(picked[0], picked[-1], freq="BMS")]
        for r in rows:
            due = [s for s in starts if s <= pd.Timestamp(r.dt)]
            if not due:
                assert r.rebalance_dt is None and r.source_dt is None
                continue
            assert r.rebalance_dt == due[-1].date()
            assert r.source_dt == max(d for d in picked if d <= due[-1]).date()
