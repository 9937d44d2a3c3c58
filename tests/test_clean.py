from conftest import business_days, day, to_bars

from quantspan.operators import clean


def test_last_row_of_a_date_wins_and_dates_are_unique(spark):
    bars = to_bars(
        spark,
        [day("2020-01-03"), day("2020-01-01"), day("2020-01-02"), day("2020-01-02")],
        close=[3.0, 1.0, 2.0, 2.5],
    )
    rows = clean.clean_bars(bars).orderBy("dt").collect()
    assert [(str(r.dt), r.close) for r in rows] == [
        ("2020-01-01", 1.0),
        ("2020-01-02", 2.5),
        ("2020-01-03", 3.0),
    ]


def test_a_null_price_can_be_the_last_one(spark):
    bars = to_bars(spark, [day("2020-01-02"), day("2020-01-02")], close=[2.0, None])
    assert clean.dedup_keep_last(bars).first().close is None


def test_weekends_and_unparsed_dates_are_dropped(spark):
    days = [day(f"2020-01-{d:02d}") for d in range(1, 22)] + [None]
    bars = to_bars(spark, days, close=[1.0] * 22)
    kept = [r.dt for r in clean.clean_bars(bars).collect()]
    assert len(kept) == 15 and all(d.weekday() < 5 for d in kept)


def test_unparsed_dates_repeat_each_other(spark):
    unique = to_bars(spark, business_days("2020-01-01", 3) + [None], close=[1.0] * 4)
    twice = to_bars(spark, business_days("2020-01-01", 2) + [None, None], close=[1.0] * 4)
    assert not clean.duplicate_dates(unique).first().has_duplicates
    assert clean.duplicate_dates(twice).first().has_duplicates


def test_later_batch_wins(spark):
    days = business_days("2020-01-01", 3)
    first = to_bars(spark, days, close=[1.0, 2.0, 3.0])
    later = to_bars(spark, days[2:], close=[9.0])
    rows = clean.merge_batches(first, later).orderBy("dt").collect()
    assert [r.close for r in rows] == [1.0, 2.0, 9.0]


def test_holdout_starts_on_its_first_day(spark):
    bars = to_bars(spark, [day("2023-08-16"), day("2023-08-17")], close=[1.0, 1.0])
    assert [str(r.dt) for r in clean.before_holdout(bars).collect()] == ["2023-08-16"]
