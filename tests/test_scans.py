import datetime as dt

import numpy as np
import pytest
from conftest import to_returns
from pyspark.sql import functions as F

from quantspan.operators import backtest as bt
from quantspan.operators import exposure, histories, metrics, scans
from quantspan.operators.calendars import frame_calendar


def numbered(spark, n=700, keys=(1, 1, 1, 2), seed=1):
    """One key with most of the rows; values with gaps, zeros and negatives."""
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.2, None, rng.normal(0, 1, n).round(3))
    rows = [(int(k), i, None if v is None else float(v)) for i, (k, v) in enumerate(zip(rng.choice(keys, n), value))]
    return spark.createDataFrame(rows, "k int, i int, v double")


KINDS = {"sum": "sum(v)", "count": "count(v)", "product": "product(v)", "max": "max(v)", "min": "min(v)", "last": "last(v, true)"}


@pytest.mark.parametrize("cut", ["column", "ranged"])
def test_every_operation_equals_one_window(spark, cut):
    df = numbered(spark)
    asked = {name: scans.Running(name, "v") for name in KINDS}
    if cut == "ranged":
        got = scans.running(scans.ranged(df, ["k"], ["i"]), ["k"], ["i"], **asked)
    else:
        got = scans.running(df, ["k"], ["i"], F.floor(F.col("i") / 50), **asked)
    got = got.orderBy("i").toPandas()
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        mine, v = got[got.k == k], part.v.astype(float)
        known = v.notna().cumsum() > 0
        want = {
            "sum": v.fillna(0).cumsum(), "count": v.notna().cumsum(), "product": v.fillna(1).cumprod(),
            "max": v.cummax().ffill(), "min": v.cummin().ffill(), "last": v.ffill(),
        }
        for name, column in want.items():
            column = column if name == "count" else column.where(known)
            np.testing.assert_allclose(mine[name].astype(float), column, atol=1e-9, err_msg=name)


def test_compounding_through_losses_of_everything_and_more(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in range(900)]
    rng = np.random.default_rng(2)
    r = rng.normal(0.001, 0.05, 900)
    r[100], r[400] = -1.5, -2.2  # the equity turns negative, and back
    df = spark.createDataFrame([("p", d, float(x)) for d, x in zip(days, r)], "panel string, dt date, ret double")
    got = scans.compounded(df, ["panel"], ["dt"], 1 + F.col("ret"), scans.quarter_of(F.col("dt"))).orderBy("dt").toPandas()
    equity = np.cumprod(1 + r)
    np.testing.assert_allclose(got.equity, equity, rtol=1e-9)
    np.testing.assert_allclose(got.peak, np.maximum.accumulate(equity), rtol=1e-9)


def test_row_before_reaches_into_the_chunk_before(spark):
    df = numbered(spark, 300)
    got = scans.lagged(df, ["k"], ["i"], "v", "before", F.floor(F.col("i") / 7)).toPandas().sort_values("i")
    want = df.toPandas().sort_values("i")
    want["before"] = want.groupby("k").v.shift()
    np.testing.assert_allclose(got.before.astype(float), want.before.astype(float))


def test_one_hour_of_one_path_is_spread_over_the_tasks(spark):
    """All events of a user share an hour, and most of them one instant."""
    rng = np.random.default_rng(3)
    at = ["2024-01-01 10:00:00" if i % 3 else f"2024-01-01 10:{i % 60:02d}:00" for i in range(3000)]
    rows = [(1, t, i, float(v)) for i, (t, v) in enumerate(zip(at, rng.normal(size=3000)))]
    rows += [(2, "2024-01-02 00:00:00", 5000 + i, 1.0) for i in range(20)]
    events = spark.createDataFrame(rows, "u int, t string, e int, v double").withColumn("ts", F.to_timestamp_ntz("t"))
    laid = scans.ranged(events, ["u"], ["ts", "e"])
    sizes = [r["count"] for r in laid.where("u = 1").groupBy("chunk").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2000
    got = histories.centred_pnl(laid, ["u"], ["ts", "e"], None, "v", 10.0).orderBy("u", "day").toPandas()
    plain = spark.sql(
        "select u, e, row_number() over w as day, sum((v - m) / 10) over w as pnl from "
        "(select *, avg(v) over (partition by u) as m from {e}) window w as (partition by u order by ts, e)", e=events
    ).orderBy("u", "day").toPandas()
    assert got.e.tolist() == plain.e.tolist() and got.day.tolist() == plain.day.tolist()
    np.testing.assert_allclose(got.pnl, plain.pnl, atol=1e-9)


@pytest.mark.parametrize("make", [
    lambda r: metrics.drawdown(r),
    lambda r: exposure.ffill(r, "ret", ["panel"]),
    lambda r: scans.lagged(r, ["panel"], ["dt"], "ret", "x", scans.quarter_of(F.col("dt"))),
])
def test_no_window_holds_the_rows_of_a_whole_series(spark, make, tmp_path):
    path = str(tmp_path / "r")
    to_returns(spark, np.zeros(400)).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Rows move by (panel, chunk) only; what moves by panel is one row a chunk.
    lines = plan.split("Initial Plan")[-1].split("\n")
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(panel" in x]
    for i in exchanges:
        if ", chunk" not in lines[i]:
            assert "Aggregate" in lines[i + 1] or "Project" in lines[i + 1], lines[i + 1]
    assert any(", chunk" in lines[i] for i in exchanges)


def test_chunks_of_order_columns(spark):
    with pytest.raises(TypeError, match="no chunks are known"):
        scans.chunk_of(spark.range(1).selectExpr("cast(id as string) as s"), "s")


@pytest.mark.parametrize("start", [0, 40])
def test_zeros_are_counted_not_written(spark, start):
    """A sparse series has the measures of the dense one, also where it begins idle."""
    rng = np.random.default_rng(5)
    r = np.where(rng.random(300) < 0.3, rng.normal(0, 0.02, 300), 0.0)
    r[:start] = 0.0
    r[start] = -0.03
    dense = to_returns(spark, r)
    calendar = frame_calendar(dense)
    active = dense.where("ret != 0")
    want = metrics.metrics(dense).first()
    got = metrics.sparse_metrics(active, metrics.frame_lengths(calendar)).first()
    assert got.n_obs == want.n_obs == 300
    for name in ("sharpe", "max_drawdown", "total_return", "mean_daily", "std_daily", "final_equity"):
        assert got[name] == pytest.approx(want[name], rel=1e-9, abs=1e-12), name
    ratio = metrics.sparse_sharpe(active, metrics.frame_lengths(calendar)).first()
    assert ratio.sharpe == pytest.approx(want.sharpe)
    idle = metrics.sparse_metrics(active.where("false"), metrics.frame_lengths(calendar)).first()
    assert (idle.sharpe, idle.max_drawdown, idle.final_equity, idle.n_obs) == (0.0, 0.0, 1.0, 300)


def test_active_days_are_the_breakdown_without_its_zeros(spark):
    prices = to_returns(spark, np.linspace(1, 2, 50)).select("panel", F.lit("X").alias("instrument"), "dt", F.col("ret").alias("close"))
    weights = prices.where("day(dt) = 7").select("panel", "instrument", "dt", F.lit(0.5).alias("w"))
    active, whole = bt.active_days(prices, weights), bt.daily_breakdown(prices, weights)
    assert whole.count() == 50 and 0 < active.count() <= 6
    assert active.exceptAll(whole.where("gross != 0 or turnover != 0 or held != 0").select(active.columns)).count() == 0


def test_asof_reaches_back_over_slices(spark):
    rng = np.random.default_rng(6)
    day = lambda i: dt.date(2019, 1, 1) + dt.timedelta(days=int(i))
    right = [(int(k), day(i), None if rng.random() < 0.1 else float(i)) for k in (1, 2) for i in sorted(rng.choice(900, 40, replace=False))]
    right += [(3, day(5), 5.0), (3, None, 9.0)]  # asked about two years later
    left = [(n, int(rng.choice([1, 1, 1, 2, 3, 4])), day(rng.integers(-50, 1000))) for n in range(400)] + [(400, 1, None)]
    r = spark.createDataFrame(right, "k int, t date, v double")
    q = spark.createDataFrame(left, "n int, k int, at date")
    got = {x.n: x.found for x in scans.asof_join(q, r, ["k"], "at", "t", {"found": "v"}).collect()}
    assert len(got) == 401 and got[400] is None
    for n, k, at in left[:-1]:
        past = [(t, v) for key, t, v in right if key == k and t is not None and t <= at]
        assert got[n] == (max(past, key=lambda x: x[0])[1] if past else None)


@pytest.mark.parametrize("window, block", [(2, 8), (7, 8), (8, 8), (20, 64)])
def test_blocks_with_a_halo_equal_sliding_windows(spark, window, block):
    pdf = numbered(spark, 400).toPandas()
    pdf["v"] = pdf.v.where(pdf.i % 90 > 2).fillna(1000.5)  # far from zero, with few distinct levels
    pdf.loc[pdf.i % 131 == 5, "v"] = None
    rows = [(int(k), int(i), None if v != v else float(v)) for k, i, v in pdf[["k", "i", "v"]].itertuples(index=False)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = scans.rolling_deviation(df, ["k"], ["i"], "v", window, "sd", F.floor(F.col("i") / 30), block).toPandas()
    assert len(got) == 400 and got.columns.tolist() == ["k", "i", "v", "sd"]
    for k, part in pdf.groupby("k"):
        want = part.sort_values("i").v.astype(float).rolling(window).std()
        mine = got[got.k == k].sort_values("i").sd.astype(float)
        # Equal values among jumps of 1000: the root of 1e-16 times their square.
        np.testing.assert_allclose(mine.to_numpy(), want.to_numpy(), atol=1e-4)
