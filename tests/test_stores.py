import datetime as dt
import time

import numpy as np
import pytest
from conftest import business_days, walk
from pyspark.sql import functions as F

from quantspan.operators import quality, quality_state
from quantspan.operators.clean import clean_bars
from quantspan.sources import candles, stores

BARS = "instrument string, dt date, ord bigint, open double, close double"


def bars(spark, seed=1, names=("A", "B"), n=200, start="2020-01-01"):
    rng = np.random.default_rng(seed)
    rows = []
    for k, name in enumerate(names):
        close = walk(n, seed + k)
        for i, (d, c) in enumerate(zip(business_days(start, n), close)):
            if rng.random() < 0.1:
                continue  # gaps, also at the seams of months
            rows.append((name, d, i, float(c) * (1.3 if i % 67 == 66 else 1.0), float(c) * (3.0 if i % 71 == 70 else 1.0) * (i % 53 != 52)))
            if rng.random() < 0.05:
                rows.append((name, d, 1000 + i, float(c), float(c)))
    return spark.createDataFrame(rows, BARS)


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merging_a_batch_leaves_other_months_alone(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = bars(spark)
    stores.merge_months(first, path)
    files = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in (tmp_path / "bars").rglob("*.parquet")}
    batch = spark.createDataFrame([("A", dt.date(2020, 3, 4), 1, 7.0, 7.0), ("C", dt.date(2020, 3, 4), 1, 8.0, 8.0), ("A", None, 1, 1.0, 1.0)], BARS)
    time.sleep(0.02)
    assert stores.merge_months(batch, path) == ["2020-03"]
    untouched = {p for p in files if "month=2020-03" not in str(p)}
    assert len(untouched) >= 8
    assert all((p.stat().st_mtime_ns, p.read_bytes()) == files[p] for p in untouched)
    once = table(spark.read.parquet(path), "instrument", "dt", "close")
    assert ("A", dt.date(2020, 3, 4), 7.0) in once and ("C", dt.date(2020, 3, 4), 8.0) in once
    kept = {r[:2] for r in table(first, "instrument", "dt")}
    assert {r[:2] for r in once} == kept | {("A", dt.date(2020, 3, 4)), ("C", dt.date(2020, 3, 4))}
    stores.merge_months(batch, path)
    assert table(spark.read.parquet(path), "instrument", "dt", "close") == once


def summary_of(spark, raw, sigma):
    whole = quality.quality_summary(raw, clean_bars(raw), sigma)
    kinds = (*quality.KIND_ORDER, "calendar_gap", "duplicate_dates")
    counts = [F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).alias(k) for k in kinds]
    return whole.select("instrument", "n_obs", "start", "end", "missing_days", *counts)


@pytest.mark.parametrize("sigma", [1.0, 3.0])
def test_states_of_parts_give_the_summary_of_the_whole(spark, tmp_path, sigma):
    raw = bars(spark, 5, ("A", "B", "C"), 300)
    path = str(tmp_path / "states")
    for part in ("dt < '2020-06-17'", "dt >= '2020-06-17'"):
        # A month that both parts touch is made from all of its bars.
        months = raw.where(part).select(quality_state.month_of(F.col("dt")).alias("m")).distinct()
        some = raw.withColumn("m", quality_state.month_of(F.col("dt"))).join(months, "m", "left_semi").drop("m")
        stores.write_months(quality_state.states(clean_bars(some), some), path)
    found = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    got = quality_state.summary(found, clean_bars(raw), sigma)
    want = summary_of(spark, raw, sigma)
    rows = table(got, *want.columns)
    assert rows == table(want, *want.columns)
    assert sum(r[6] for r in rows) > 3 and sum(r[7] for r in rows) > 3  # both kinds occur


def test_a_merged_batch_renews_its_states(spark, tmp_path):
    store, path = str(tmp_path / "bars"), str(tmp_path / "states")
    raw = bars(spark, 9, ("A",), 120)
    stores.merge_quality(raw, store, path)
    late = spark.createDataFrame([("A", dt.date(2020, 2, 3), 5000, 1.0, 1e6), ("A", dt.date(2020, 7, 1), 5001, 1.0, -1.0)], BARS)
    stores.merge_quality(late, store, path)
    kept = spark.read.parquet(store).drop("month")
    found = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    columns = ["instrument", "n_obs", "start", "end", "missing_days", "nonpositive_price", "anomalous_return"]
    want = summary_of(spark, kept, 5.0)
    assert table(quality_state.summary(found, clean_bars(kept)), *columns) == table(want, *columns)


def test_flat_and_single_bars(spark):
    rows = [("flat", d, i, None, 5.0) for i, d in enumerate(business_days("2020-01-01", 60))] + [("one", dt.date(2020, 1, 2), 1, None, 5.0)]
    raw = spark.createDataFrame(rows, BARS)
    got = quality_state.summary(quality_state.states(raw), raw)
    assert table(got, "instrument", "n_obs", "anomalous_return", "session_gap") == [("flat", 60, 0, 0), ("one", 1, 0, 0)]
    empty = raw.where("false")
    assert quality_state.summary(quality_state.states(empty), empty).count() == 0


def test_only_the_blobs_asked_for_are_opened(spark, tmp_path):
    days = business_days("2020-01-01", 90)
    rows = [(s, d, 1.0, 2.0, 0.5, 1.5) for s in ("AAA", "BBB") for d in days]
    daily = spark.createDataFrame(rows, "instrument string, dt date, open double, high double, low double, close double")
    folder = str(tmp_path / "feed")
    candles.write_candles(candles.pack_candles(daily), folder)
    names, points = {"A": "AAA", "B": "BBB"}, {"A": 100.0, "B": 100.0}
    whole = candles.read_candles(spark, folder, names, points)
    assert sorted(table(whole, "symbol", "dt", "open", "high", "low", "close")) == sorted(rows)
    one = (F.col("symbol") == "AAA") & (F.col("month") == dt.date(2020, 2, 1))
    assert whole.where(one).count() == 20 and whole.count() == 180  # a filter leaves the next query alone
    # Every other blob is broken: a read that opens one fails.
    for p in (tmp_path / "feed").rglob("*.bi5"):
        if "/AAA/2020/01/" not in str(p):
            p.write_bytes(b"broken")
    february = dt.date(2020, 2, 1)
    some = candles.read_candles(spark, folder, names, points, ["A"], (february, february))
    assert sorted(table(some, "dt", "close")) == sorted((d, 1.5) for d in days if d.month == 2)
    with pytest.raises(Exception):
        whole.agg(F.sum("close")).collect()
    with pytest.raises(KeyError, match="BBB"):
        candles.read_candles(spark, folder, {"A": "AAA"}, points)
