import numpy as np
import pytest
from conftest import to_returns
from pyspark.sql import functions as F

from quantspan.config import BarrierRules, ResamplingParams
from quantspan.functions.scalars import first_passage_probability, normal_ppf
from quantspan.operators import barrier, bootstrap, metrics
from quantspan.operators.histories import centred_pnl, centred_returns, hour_of, minute_of, running_pnl


def gaussian(mu, sigma, n, seed):
    return np.random.default_rng(seed).normal(mu, sigma, n)


def walk_through(r, target, daily, drawdown):
    """One path, day by day, stopping at the first barrier."""
    level = 0.0
    for t, x in enumerate(r, 1):
        level += x
        if x <= -daily or level <= -drawdown:
            return "FAILED", t
        if target is not None and level >= target:
            return "PASSED", t
    return "UNRESOLVED", len(r)


def steps_of(spark, paths):
    rows = [(p, d, float(x)) for p, r in enumerate(paths) for d, x in enumerate(r, 1)]
    df = spark.createDataFrame(rows, "path int, day int, r double")
    return df.selectExpr("*", "sum(r) over (partition by path order by day) as pnl")


def test_first_passage_equals_a_day_by_day_walk(spark):
    paths = np.random.default_rng(1).normal(0.0005, 0.006, (150, 200))
    got = barrier.first_passage(steps_of(spark, paths), ["path"], 0.10, 0.03, 0.08).collect()
    for row in got:
        assert (row.outcome, row.day) == walk_through(paths[row.path], 0.10, 0.03, 0.08)
    assert {r.outcome for r in got} == {"PASSED", "FAILED", "UNRESOLVED"}


def test_every_leverage_equals_its_own_walk(spark):
    paths = np.random.default_rng(2).normal(0.0005, 0.01, (60, 150))
    grid = [0.25, 1.0, 3.0]
    got = barrier.first_passage_grid(steps_of(spark, paths), ["path"], 0.10, 0.03, 0.08, grid).collect()
    assert len(got) == 180
    for row in got:
        assert (row.outcome, row.day) == walk_through(paths[row.path] * row.k, 0.10, 0.03, 0.08)


def test_drawdown_counts_from_the_start_not_from_the_peak(spark):
    path = [0.01] * 8 + [-0.005] * 30
    row = barrier.first_passage(steps_of(spark, [path]), ["path"], 0.20, 1.0, 0.10).first()
    assert (row.outcome, row.day) == ("UNRESOLVED", 38)


def test_a_loss_on_the_day_of_the_gain_is_a_loss(spark):
    row = barrier.first_passage(steps_of(spark, [[0.3, -0.06]]), ["path"], 0.24, 0.05, 0.1).first()
    assert row.outcome == "PASSED"
    row = barrier.first_passage(steps_of(spark, [[0.29, -0.05]]), ["path"], 0.30, 0.05, 0.1).first()
    assert row.outcome == "FAILED"


def test_shares_add_up_and_undecided_is_not_failed(spark):
    paths = np.random.default_rng(3).normal(0, 0.005, (100, 60))
    found = barrier.first_passage(steps_of(spark, paths), ["path"], 0.05, 0.05, 0.05)
    s = barrier.phase_stats(found).first()
    assert s.p_pass + s.p_fail + s.p_unresolved == pytest.approx(1.0)
    assert s.p_unresolved > 0.1
    assert s.p_cond == pytest.approx(s.p_pass / (s.p_pass + s.p_fail))


def test_chunked_totals_equal_a_single_window(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), i, float(v)) for i, (u, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 500), rng.normal(size=500)))]
    events = spark.createDataFrame(rows, "u int, i int, r double").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, i * 3)")
    )
    plain = spark.sql(
        "select i, row_number() over w as day, sum(r) over w as pnl from {e} "
        "window w as (partition by u order by ts)", e=events
    )
    want = plain.orderBy("i").toPandas()
    for chunk in (minute_of(F.col("ts")), hour_of(F.col("ts")), F.lit(0)):
        got = running_pnl(events, ["u"], ["ts"], chunk).orderBy("i").toPandas()
        assert got.day.tolist() == want.day.tolist()
        np.testing.assert_allclose(got.pnl, want.pnl, atol=1e-12)


def test_centred_totals_in_two_scans(spark, tmp_path):
    rows = [(u, i, float((i * 7919 + u) % 101)) for u in (1, 1, 2, 3) for i in range(200)]
    path = str(tmp_path / "events")
    events = spark.createDataFrame(rows, "u int, i int, v double").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, i * 7)")
    )
    events.distinct().write.parquet(path)
    stored = spark.read.parquet(path)
    got = centred_pnl(stored, ["u"], ["ts", "i"], hour_of(F.col("ts")), "v", 10.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
    want = running_pnl(centred_returns(stored, ["u"], "v", 10.0), ["u"], ["ts", "i"], F.lit(0))
    a, b = (x.orderBy("u", "i").toPandas() for x in (got, want))
    assert a.day.tolist() == b.day.tolist()
    np.testing.assert_allclose(a.pnl, b.pnl, atol=1e-9)


def test_payout_windows_start_from_zero(spark):
    path = [-0.02] * 4 + [0.0] * 17 + [-0.02] * 4 + [0.0] * 17 + [-0.06] + [0.0] * 10
    windows = barrier.payout_windows(steps_of(spark, [path]), ["path"], 21, 0.05, 0.10)
    assert [r.survived for r in windows.orderBy("cycle").collect()] == [True, True, False]
    assert barrier.funded_survival(windows, 21).first().p_survive == 1.0  # the third is short


def test_closed_form(spark):
    one = spark.range(1)

    def p(mu, sigma, a, b):
        return one.select(first_passage_probability(F.lit(mu), F.lit(sigma), F.lit(a), F.lit(b)).alias("p")).first().p

    assert p(0.0, 0.01, 0.10, 0.10) == pytest.approx(0.5)
    assert p(0.0, 0.01, 0.05, 0.15) == pytest.approx(0.25)
    assert p(0.001, 0.01, 0.1, 0.1) == pytest.approx((1 - np.exp(-2)) / (1 - np.exp(-4)))
    with pytest.raises(Exception, match="sigma"):
        p(0.1, 0.0, 0.1, 0.1)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_ppf(F.col("p")).alias("z"))
    for r in rows.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)


# --- resampling -----------------------------------------------------------------------------


def drawn(spark, r, **kw):
    df = bootstrap.block_bootstrap(to_returns(spark, r), **kw).toPandas()
    return df.pivot(index="path", columns="day", values="r").to_numpy()


def test_blocks_are_runs_of_the_series_with_wrap_around(spark):
    r = np.arange(1.0, 31.0)
    paths = drawn(spark, r, n_paths=40, horizon=50, block_size=7, seed=3)
    assert paths.shape == (40, 50)
    for start in range(0, 50, 7):
        block = paths[:, start : start + 7]
        following = np.diff(block, axis=1)
        assert np.isin(following, (1.0, -29.0)).all()
    assert (np.diff(paths, axis=1) == -29.0).any()


def test_a_series_shorter_than_a_block_wraps_repeatedly(spark):
    paths = drawn(spark, [1.0, 2.0, 3.0], n_paths=5, horizon=20, block_size=10, seed=1)
    assert np.isin(np.diff(paths[:, :10], axis=1), (1.0, -2.0)).all()


def test_draws_do_not_depend_on_the_layout(spark):
    r = to_returns(spark, gaussian(0, 0.01, 300, 5))
    kw = dict(n_paths=20, horizon=60, block_size=20, seed=9)
    a = bootstrap.block_bootstrap(r, **kw)
    b = bootstrap.block_bootstrap(r.repartition(7), **kw)
    assert a.exceptAll(b).count() == 0 and a.count() == 1200
    c = bootstrap.block_bootstrap(r, **{**kw, "seed": 10})
    assert a.exceptAll(c).count() > 0


def test_blocks_keep_volatility_clusters(spark):
    vol = np.concatenate([np.full(100, 0.003), np.full(100, 0.03)] * 10)
    r = to_returns(spark, np.random.default_rng(0).normal(0, 1, vol.size) * vol)

    def clustering(df):
        return metrics.squared_autocorrelation(df, ("panel",), "day").first().acf

    original = metrics.squared_autocorrelation(r).first().acf
    block, single = (
        clustering(
            bootstrap.block_bootstrap(r, 1, 4000, size, 1).withColumnRenamed("r", "ret")
        )
        for size in (100, 1)
    )
    assert original > 0.1 and block > 0.1 and block > single + 0.05


def test_block_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        bootstrap.block_bootstrap(to_returns(spark, [0.1]), 1, 1, 0, 1)
    with pytest.raises(ValueError):
        ResamplingParams(block_size=0)


def test_a_level_on_a_limit_falls_as_in_the_sql(spark, tmp_path):
    import __spark_entry__ as contract
    import duckdb

    # Amounts whose mean is 50 and that reach the target of 199.9 exactly, at the eighth event.
    rng, rows = np.random.default_rng(7), []
    for user in range(40):
        cents = rng.integers(0, 9_000, 8)
        cents[7] = 59_990 - cents[:7].sum()
        rest = rng.multinomial(20_010, np.full(8, 1 / 8))
        for x in [*cents.tolist(), *rest.tolist()]:
            rows.append((len(rows), user, x / 100))
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double")
    events = events.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, event_id)"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 128)  # chunks of five rows
    try:
        events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        got = contract.queries()["first_passage"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT user_id, outcome, day FROM ({contract.oracle_sql()['first_passage']})").fetchall()
    assert sorted((r.user_id, r.outcome, r.day) for r in got) == sorted(want)
