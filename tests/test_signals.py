import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
import pytest
from conftest import business_days, to_prices, walk, wide

from quantspan.config import MAX_GROSS
from quantspan.operators import align, exposure, seasonality
from quantspan.plans import signals, turn_of_month


def trending(n=900):
    """One line that climbs by five cents a day and one that loses ten."""
    days = business_days("2018-01-01", n)
    return pd.DataFrame({"UP": [50 + 0.05 * i for i in range(n)], "DOWN": [200 - 0.1 * i for i in range(n)]}, index=days)


def noisy(n=700, seed=11):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {c: walk(n, seed + i, 0.0002, 0.01 + 0.004 * i) for i, c in enumerate("ABC")},
        index=business_days("2018-01-01", n),
    )
    frame.loc[rng.random(n) < 0.2, "B"] = np.nan
    frame.loc[rng.random(n) < 0.1, "A"] = np.nan
    return frame


def dense(spark, prices, weights):
    """Every cell; the transforms leave flat ones out."""
    got = wide(align.align_weights(to_prices(spark, prices), weights), "w")
    return got.reindex(columns=sorted(prices.columns)).to_numpy(dtype=float)


def bars_a_year(dates, fixed):
    return fixed or len(dates) * 365.25 / (dates[-1] - dates[0]).days


def own_sizes(quotes, months, fixed):
    """Per own day of one instrument: direction over the last known volatility."""
    dates, values = [d for d, _ in quotes], [v for _, v in quotes]
    moves = [b / a - 1 if a else None for a, b in zip(values, values[1:])]
    year = bars_a_year(dates[1:], fixed)
    sizes, vol = {}, None
    for i, (d, v) in enumerate(quotes):
        window = moves[i - 63 : i] if i >= 63 else []
        if window and None not in window:
            vol = float(np.std(window, ddof=1)) * year**0.5
        probe = (pd.Timestamp(d) - pd.DateOffset(months=months)).date()
        past = [q for e, q in quotes if e <= probe]
        if past and vol:
            change = v - past[-1]
            sizes[d] = (change > 0) / vol - (change < 0) / vol
    return sizes


def rebalance_due(first, last):
    """First Monday-to-Friday day of each month within the frame."""
    out = []
    for month in pd.period_range(first, last, freq="M"):
        d = month.start_time.date()
        while d.weekday() > 4:
            d += dt.timedelta(days=1)
        if first <= d <= last:
            out.append(d)
    return out


def plain_momentum(prices, months=12, per_year=None, cap=MAX_GROSS):
    """Weights of every frame date, in dicts: size, scale to the target, sample, hold."""
    names, days = sorted(prices.columns), list(prices.index)
    quotes = {c: [(d, float(v)) for d, v in prices[c].items() if v == v] for c in names}
    sizes = {c: own_sizes(quotes[c], months, per_year) for c in names}
    year = bars_a_year(days, per_year) if per_year else len(days) * 365.25 / (days[-1] - days[0]).days
    known = {c: dict(quotes[c]) for c in names}
    last, held, earned, targets = {}, dict.fromkeys(names, 0.0), [], {}
    for i, d in enumerate(days):
        total = 0.0
        for c in names:
            if d in known[c]:
                if last.get(c):
                    total += held[c] * (known[c][d] / last[c] - 1)
                last[c] = known[c][d]
        vol = float(np.std(earned[-63:], ddof=1)) * year**0.5 if i >= 63 else 0.0
        earned.append(total)
        size = {c: sizes[c].get(d, 0.0) for c in names}
        gross = sum(abs(x) for x in size.values())
        held = {c: x / gross if gross else 0.0 for c, x in size.items()}
        scale = min(0.08 / vol, cap) if vol else 0.0
        targets[d] = [held[c] * scale for c in names]
    due, rows = rebalance_due(days[0], days[-1]), []
    for d in days:
        passed = [x for x in due if x <= d]
        source = [x for x in days if passed and x <= passed[-1]]
        rows.append(targets[source[-1]] if source else [0.0] * len(names))
    return np.array(rows)


@pytest.mark.parametrize("months, per_year", [(12, None), (6, 252.0)])
def test_momentum_against_a_day_by_day_version(spark, months, per_year):
    prices = noisy()
    got = dense(spark, prices, signals.tsmom(to_prices(spark, prices), months, periods_per_year=per_year))
    want = plain_momentum(prices, months, per_year)
    assert np.abs(want).sum() > 10
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_a_zero_price_keeps_the_last_volatility(spark):
    prices = noisy(650, seed=3)
    prices.iloc[450, 2] = 0.0
    got = dense(spark, prices, signals.tsmom(to_prices(spark, prices), 6, periods_per_year=252.0))
    np.testing.assert_allclose(got, plain_momentum(prices, 6, 252.0), atol=1e-9)
    assert np.abs(got[480:500, 2]).min() > 0


def test_direction_follows_the_trend(spark):
    prices = trending()
    got = dense(spark, prices, signals.tsmom(to_prices(spark, prices)))[-1]
    assert got[0] < 0 < got[1]  # DOWN, UP


def test_weights_change_about_monthly(spark):
    prices = noisy(900)
    got = dense(spark, prices, signals.tsmom(to_prices(spark, prices)))
    changes = (np.abs(np.diff(got, axis=0)).sum(axis=1) > 1e-12).sum()
    assert 6 <= changes / (900 / 261) <= 15


def test_exposure_stays_within_the_cap(spark):
    weights = signals.tsmom(to_prices(spark, trending()))
    exposure.validate_weights(weights)
    assert exposure.gross_exposure(weights).agg({"gross": "max"}).first()[0] == pytest.approx(MAX_GROSS)


def test_later_data_cannot_move_earlier_weights(spark):
    """Noisy prices and no cap in reach, so that the scalar itself is what is compared."""
    prices = noisy(700)
    full = signals.tsmom(to_prices(spark, prices), 6, periods_per_year=252.0, max_gross=1e9)
    head = prices.iloc[:550]
    cut = signals.tsmom(to_prices(spark, head), 6, periods_per_year=252.0, max_gross=1e9)
    a, b = dense(spark, prices, full)[:550], dense(spark, head, cut)
    assert np.abs(b).sum() > 10
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_several_lookbacks_equal_single_runs(spark):
    p = to_prices(spark, noisy(600))
    both = signals.momentum_grid(p, (12, 6)).toPandas()
    for months in (12, 6):
        one = signals.tsmom(p, months).toPandas().sort_values(["instrument", "dt"])
        mine = both[both.lookback == months].sort_values(["instrument", "dt"])
        assert len(one) == len(mine) > 0
        np.testing.assert_allclose(mine.w.to_numpy(), one.w.to_numpy())


def test_turn_of_month_days(spark):
    days = business_days("2020-01-01", 66)
    flags = seasonality.tom_flag(to_prices(spark, pd.DataFrame({"A": walk(66, 1)}, index=days)))
    flagged = {str(r.dt) for r in flags.collect() if r.tom}
    assert {"2020-01-31", "2020-02-03", "2020-02-04", "2020-02-05", "2020-02-28"} <= flagged
    assert "2020-02-06" not in flagged and "2020-01-30" not in flagged
    wider = seasonality.tom_flag(to_prices(spark, pd.DataFrame({"A": walk(66, 1)}, index=days)), 1, 4)
    assert {str(r.dt) for r in wider.collect() if r.tom} - flagged == {
        "2020-01-06", "2020-02-06", "2020-03-05", "2020-04-01",
    } - flagged


def test_turn_of_month_is_flat_outside_and_never_capped(spark):
    prices = pd.DataFrame({c: walk(500, i, 0.0, 0.011) for i, c in enumerate("ABC")}, index=business_days("2018-01-01", 500))
    p = to_prices(spark, prices)
    flags = {(r.instrument, r.dt): r.tom for r in seasonality.tom_flag(p).collect()}
    rows = turn_of_month.tom_weights(p).collect()
    assert rows and all(r.w > 0 and flags[(r.instrument, r.dt)] for r in rows)
    assert not any(r.capped for r in rows if str(r.dt) > "2018-08-01")


def test_random_days_are_four_a_month_and_repeatable(spark):
    from quantspan.operators.calendars import frame_calendar

    calendar = frame_calendar(to_prices(spark, pd.DataFrame({"A": walk(200, 1)}, index=business_days("2018-01-01", 200))))
    drawn = seasonality.random_days(calendar, 5)
    dated = drawn.join(calendar, ["panel", "pos"]).toPandas()
    counts = dated.groupby(["resample", dated.dt.map(lambda d: (d.year, d.month))]).size()
    assert (counts == 4).all() and not dated.duplicated(["resample", "dt"]).any()
    again = seasonality.random_days(calendar.repartition(7), 5).toPandas()
    key = ["resample", "pos"]
    assert set(map(tuple, dated[key].values)) == set(map(tuple, again[key].values))


def test_random_subsets_are_subsets_and_all_alike_likely(spark):
    from collections import Counter

    rows = spark.range(6000).select(
        *[seasonality.random_subset(F.lit(n), k, F.lit(7), F.col("id")).alias(f"s{n}_{k}") for n, k in ((5, 2), (3, 4), (1, 4))]
    ).collect()
    pairs = Counter(tuple(sorted(r.s5_2)) for r in rows)
    assert len(pairs) == 10 and all(480 < c < 720 for c in pairs.values())
    assert all(sorted(r.s3_4) == [0, 1, 2] and r.s1_4 == [0] for r in rows)


def test_null_benchmark_is_repeatable(spark):
    p = to_prices(spark, noisy(400))
    first = turn_of_month.null_benchmark(p, 8).orderBy("resample").toPandas()
    second = turn_of_month.null_benchmark(p.repartition(5), 8).orderBy("resample").toPandas()
    assert len(first) == 8 and first.sharpe.nunique() == 8
    np.testing.assert_allclose(first.sharpe, second.sharpe)


def test_contrast_finds_a_planted_effect(spark):
    days = business_days("2015-01-01", 800)
    p = to_prices(spark, pd.DataFrame({"A": np.ones(800), "B": np.ones(800)}, index=days))
    flags = {(r.instrument, r.dt): r.tom for r in seasonality.tom_flag(p).collect()}
    rng = np.random.default_rng(0)
    prices = pd.DataFrame(
        {
            c: 100 * np.cumprod(1 + rng.normal(0, 0.005, 800) + [0.003 if flags[(c, d)] else 0.0 for d in days])
            for c in "AB"
        },
        index=days,
    )
    got = {
        r.instrument: r
        for r in seasonality.mean_contrast(seasonality.flagged_returns(to_prices(spark, prices)), 300).collect()
    }
    assert set(got) == {"A", "B", "ALL"}
    assert all(r.ci_low_bp > 0 and r.ci_low_bp < r.contrast_bp < r.ci_high_bp for r in got.values())
    assert got["ALL"].se_bp < got["A"].se_bp


def contract(spark, signal, n=700):
    return signals.signal_contract(signal, to_prices(spark, noisy(n))).orderBy("cut").collect()


def test_contract_finds_what_looks_ahead(spark):
    """A cheat differs on its last day only; the honest one and a fixed year nowhere."""
    for row in contract(spark, signals.sign_of_next_return):
        assert row.n_changed > 0 and row.first_changed == row.last_dt and row.n_strays == 0
    honest = contract(spark, signals.sign_of_last_return)
    assert len(honest) == 3 and all(r.n_changed == 0 and r.first_changed is None for r in honest)
    fixed = contract(spark, lambda p: signals.tsmom(p, 6, periods_per_year=252.0))
    assert all(r.n_cells > 300 and r.n_changed == 0 for r in fixed)


def test_contract_reports_what_the_whole_sample_decides(spark):
    """Annualising with the bars observed in all of the sample moves most of the past."""
    observed = contract(spark, lambda p: signals.tsmom(p, 6))
    assert any(r.n_changed > 100 and r.first_changed < r.last_dt for r in observed)


def test_contract_finds_invented_days_and_instruments(spark):
    def invents(prices):
        known = signals.buy_and_hold(prices)
        shifted = known.groupBy("panel").agg(F.max("dt").alias("dt")).select(
            "panel", F.lit("GHOST").alias("instrument"), F.date_sub("dt", 1000).alias("dt"), F.lit(0.0).alias("w")
        )
        return known.unionByName(shifted)

    assert all(r.n_strays == 1 for r in contract(spark, invents, 60))


def test_study_leaves_the_reserved_period_out(spark):
    from quantspan.config import HOLDOUT_START
    from quantspan.plans import momentum_study

    frame = noisy(700)
    frame.index = business_days("2022-01-03", len(frame))
    prices = to_prices(spark, frame)
    samples = prices.select("panel", "instrument").distinct()
    starts = {"p": "2023-02-01"}
    tables = momentum_study.run_study(prices, samples, starts)
    daily = momentum_study.daily_series(prices, samples, starts)
    assert daily.agg(F.max("dt")).first()[0] < HOLDOUT_START
    exempt = momentum_study.daily_series(prices, samples, starts, holdout=None)
    assert exempt.agg(F.max("dt")).first()[0] > HOLDOUT_START
    assert tables.verdict.count() == 1 and tables.deflation.count() == 1
    assert {"panel", "sharpe_0_0bp", "sharpe_0_3bp", "sharpe_1_0bp"} <= set(tables.sensitivity.columns)
    assert {r.lookback for r in tables.calibration.collect()} == {6, 12}


@pytest.mark.parametrize("rule, expected", [("BMS", "MS"), ("BQS", "QS"), ("BYS", "YS"), ("W-WED", "W-WED"), ("B", "B")])
def test_rebalances_by_rule(spark, rule, expected):
    """Against pandas' own offsets: in force is the last one up to a date, sampled on or before it."""
    from quantspan.operators.calendars import frame_calendar, rebalance_calendar

    days = [d for i, d in enumerate(business_days("2018-01-01", 600)) if i % 11 != 3]
    calendar = frame_calendar(to_prices(spark, pd.DataFrame({"A": np.ones(len(days))}, index=days)))
    got = {r.dt: r for r in rebalance_calendar(calendar, rule).collect()}
    due = [d.date() for d in pd.date_range(days[0], days[-1], freq="B" + expected if expected in ("MS", "QS", "YS") else expected)]
    assert len(got) == len(days) and len(due) >= 3
    for d in days:
        rebalance = max((x for x in due if x <= d), default=None)
        source = rebalance and max(x for x in days if x <= rebalance)
        assert (got[d].rebalance_dt, got[d].source_dt) == (rebalance, source), d


def test_unknown_rebalance_rules_are_named(spark):
    from quantspan.operators.calendars import rebalance_calendar

    with pytest.raises(ValueError, match="W-SUN"):
        rebalance_calendar(spark.createDataFrame([], "panel string, dt date, prev_dt date, next_dt date"), "W-SUN")
