import pytest
from conftest import business_days, day, to_bars, walk

from quantspan.operators import quality


def kinds(df):
    return {r.kind for r in df.collect()}


def test_a_jump_is_an_anomalous_return(spark):
    close = [100.0] * 60
    close[30] = 150.0
    bars = to_bars(spark, business_days("2020-01-01", 60), close=close)
    found = quality.anomalous_returns(bars).orderBy("dt").collect()
    assert [r.dt for r in found] == business_days("2020-01-01", 60)[30:32]
    assert found[0].detail.startswith("z=") and found[1].detail.startswith("z=-")


def test_a_flat_series_has_no_score(spark):
    bars = to_bars(spark, business_days("2020-01-01", 30), close=[100.0] * 30)
    assert quality.anomalous_returns(bars).count() == 0


@pytest.mark.parametrize("gapped", [True, False])
def test_opening_gaps_and_closing_jumps_are_told_apart(spark, gapped):
    close = list(walk(60, 1, deviation=0.001))
    if not gapped:
        close[30:] = [c * 1.5 for c in close[30:]]
    opened = [close[0]] + close[:-1]
    if gapped:
        opened[30] = close[29] * 1.30
    bars = to_bars(spark, business_days("2020-01-01", 60), open=opened, close=close)
    assert kinds(quality.anomalies(None, bars)) == {"session_gap" if gapped else "anomalous_return"}


def test_no_open_means_no_session_gap(spark):
    bars = to_bars(spark, business_days("2020-01-01", 10), close=walk(10, 2))
    assert quality.session_gaps(bars).count() == 0


def test_zero_and_missing_prices(spark):
    close = [100.0] * 10
    close[5], close[7] = 0.0, None
    bars = to_bars(spark, business_days("2020-01-01", 10), close=close)
    found = quality.nonpositive_prices(bars).orderBy("dt").collect()
    assert [r.dt for r in found] == [business_days("2020-01-01", 10)[i] for i in (5, 7)]


def test_missing_weekdays_are_counted(spark):
    days = business_days("2020-01-01", 5) + business_days("2020-02-03", 5)
    bars = to_bars(spark, days, close=[1.0] * 10)
    summary = quality.quality_summary(bars, bars).first()
    assert summary.missing_days == 18 and summary.n_obs == 10
    assert summary.counts == {"calendar_gap": 1}
    assert quality.calendar_gaps(bars).first().detail == "18 weekdays"


def test_a_single_bar_misses_nothing(spark):
    bars = to_bars(spark, [day("2020-01-01")], close=[1.0])
    assert quality.quality_summary(None, bars).first().missing_days == 0


def test_listing_stops_but_says_how_much_is_left(spark):
    bars = to_bars(spark, business_days("2020-01-01", 30), close=[0.0] * 30)
    listed = quality.first_anomalies(quality.anomalies(None, bars), 20).collect()
    assert len(listed) == 20 and {r.more for r in listed} == {10}


def test_all_checks_agree_with_the_single_ones(spark):
    close = list(walk(200, 3))
    close[50], close[80] = 0.0, close[80] * 2
    bars = to_bars(spark, business_days("2020-01-01", 200), open=[c * 1.001 for c in close], close=close)
    together = quality.anomalies(bars, bars, 3.0)
    apart = (
        quality.nonpositive_prices(bars)
        .unionByName(quality.anomalous_returns(bars, 3.0))
        .unionByName(quality.session_gaps(bars, 3.0))
        .unionByName(quality.calendar_gaps(bars))
        .unionByName(quality.duplicate_date_anomalies(bars))
    )
    assert sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))
    assert together.count() > 2
