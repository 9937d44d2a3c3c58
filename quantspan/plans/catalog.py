"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import (
    BarrierRules,
    CostModel,
    ResamplingParams,
    SharpeReference,
    StudyThresholds,
)
from quantspan.functions import scalars as S
from quantspan.operators import (
    align,
    barrier,
    bootstrap,
    calendars,
    clean,
    exposure,
    histories,
    metrics,
    quality,
    quality_state,
    returns,
    seasonality,
    trials,
)
from quantspan.operators import backtest as bt
from quantspan.plans import momentum_study, panels, signals, turn_of_month
from quantspan.session import materialize, scratch_path
from quantspan.sources import candles, raw, stores
from quantspan.streaming import passages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FULL = ResamplingParams()
RULES = BarrierRules()
RESAMPLES = 1000
SPLIT = "1998-06-30"
EVAL_START = {"A": "1996-01-01", "B": "1997-01-01"}
SAMPLE_A = ("1-URGENT", "2-HIGH", "3-MEDIUM")
TIGHT_CAP = 0.25
BARS = ((-0.3, -0.4), (-0.2, -0.4), (-0.9, -1.0))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles to so many decimals; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(c, decimals) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def priority(spark, sf):
    return panels.priority_panel(spark, sf)


def brand(spark, sf):
    return panels.brand_panel(spark, sf)


def stored(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A panel and its calendar as tables on disk, for queries that pass over them repeatedly.

    The panel has a row per instrument and day, far fewer than the records behind it, which
    are then read once. The calendar's true size lets the optimizer pick its joins.
    """
    prices = materialize(prices, "prices")
    return prices, materialize(calendars.frame_calendar(prices), "calendar")


def held_returns(spark, sf) -> DataFrame:
    """Net buy-and-hold returns of the priority panel, the series most reports start from."""
    prices, calendar = stored(priority(spark, sf))
    weights = signals.buy_and_hold(prices, calendar=calendar)
    return bt.backtest(prices, weights, calendar=calendar)


def momentum_weights(spark, sf) -> DataFrame:
    prices, calendar = stored(priority(spark, sf))
    return signals.tsmom(prices, calendar=calendar)


# --- sources and sinks ------------------------------------------------------------------


def _write_dumps(spark, sf) -> str:
    """Orders as one CSV dump per priority, rows in key order."""
    path = scratch_path(spark, "dumps")
    (
        panels.table(spark, sf, "orders")
        .select(
            F.col("o_orderpriority").alias("instrument"),
            F.col("o_orderkey").alias("key"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
            F.col("o_totalprice").alias("Close"),
        )
        .repartition("instrument")
        .sortWithinPartitions("instrument", "key")
        .drop("key")
        .write.partitionBy("instrument")
        .csv(path, header=True)
    )
    return path


def _folder_name(path):
    return F.regexp_extract(raw.plain_path(path), "instrument=([^/]+)/", 1)


@query
def raw_scan(spark, sf):
    dumps = raw.read_raw(spark, _write_dumps(spark, sf), name_of=_folder_name)
    return rounded(dumps.select("instrument", "dt", "close"))


@query
def clean_sink(spark, sf):
    dumps = raw.read_raw(spark, _write_dumps(spark, sf), name_of=_folder_name)
    path = scratch_path(spark, "clean")
    stores.write_clean(clean.clean_bars(dumps).drop("ord"), path)
    return rounded(spark.read.parquet(path).select("instrument", "dt", "close"))


@query
def panel_scan(spark, sf):
    path = scratch_path(spark, "clean")
    stores.write_clean(clean.clean_bars(panels.order_bars(spark, sf)).drop("ord"), path)
    return rounded(stores.read_prices(spark, path, "orders"))


@query
def quality_sink(spark, sf):
    raw_bars = panels.balance_bars(spark, sf)
    path = scratch_path(spark, "quality")
    stores.write_quality(raw_bars, clean.clean_bars(raw_bars), path)
    detail = spark.read.parquet(f"{path}/detail").groupBy("instrument").agg(
        F.count("*").alias("listed"), F.max("more").alias("more")
    )
    return spark.read.parquet(f"{path}/summary").join(detail, "instrument").select(
        "instrument", "n_obs", "start", "end", "missing_days", "listed", "more"
    )


@query
def report_sink(spark, sf):
    path = scratch_path(spark, "report")
    stores.write_report(held_returns(spark, sf), path)
    found = spark.read.parquet(f"{path}/metrics")
    points = spark.read.parquet(f"{path}/equity").groupBy("panel").agg(F.count("*").alias("points"))
    binned = spark.read.parquet(f"{path}/histogram").groupBy("panel").agg(F.sum("n").alias("binned"))
    return rounded(
        found.join(points, "panel").join(binned, "panel").select(
            F.col("panel").cast("string").alias("panel"), "n_obs", "sharpe", "final_equity", "points", "binned"
        )
    )


@query
def candle_decode(spark, sf):
    """Daily bars packed into monthly blobs, written as files, and read back through the source."""
    bars = panels.ohlc_bars(spark, sf)
    path = scratch_path(spark, "candles")
    names = bars.select("instrument").distinct()
    symbols = {r.instrument: r.instrument for r in names.collect()}  # folders of a feed
    candles.write_candles(candles.pack_candles(bars), path)
    found = candles.read_candles(spark, path, symbols, {i: 100.0 for i in symbols})
    return rounded(found.select("instrument", "dt", "open", "high", "low", "close"))


@query
def symbol_map_check(spark, sf):
    """Brands sold in the orders that no supplier-side mapping (parts of size 1) covers."""
    parts = panels.table(spark, sf, "part")
    universe = parts.select(F.col("p_brand").alias("instrument"))
    mapped = parts.where(F.col("p_size") == 1).select(
        F.col("p_brand").alias("instrument"), F.col("p_name").alias("symbol")
    )
    return candles.unmapped_instruments(universe, mapped)


@query
def month_spine(spark, sf):
    spans = panels.order_bars(spark, sf).groupBy("instrument").agg(
        F.min("dt").alias("start"), F.max("dt").alias("end")
    )
    return calendars.month_spine(spans).select("instrument", "month")


@query
def ingest_merge(spark, sf):
    """Balances first, then order amounts: the later batch wins on shared dates."""
    first = panels.balance_bars(spark, sf).withColumn("instrument", F.lit("ALL"))
    then = panels.order_bars(spark, sf).withColumn("instrument", F.lit("ALL"))
    return rounded(clean.merge_batches(first, then).select("instrument", "dt", "close"))


@query
def ingest_upsert(spark, sf):
    """Balances are stored; order amounts from 1997 on are merged into their months, twice."""
    first = panels.balance_bars(spark, sf).withColumn("instrument", F.lit("ALL"))
    then = panels.order_bars(spark, sf).withColumn("instrument", F.lit("ALL")).where(F.year("dt") >= 1997)
    path = scratch_path(spark, "bars")
    for batch in (first, then, then):
        stores.merge_months(batch, path)
    return rounded(spark.read.parquet(path).select("instrument", "dt", "close"))


@query
def instrument_from_path(spark, sf):
    pages = panels.table(spark, sf, "pages")
    return pages.select("page_id", raw.instrument_of(F.col("url")).alias("instrument"))


@query
def raw_glob(spark, sf):
    """Dump files found next to the writer's own marker files."""
    files = raw.raw_files(spark, _write_dumps(spark, sf))
    return files.select(_folder_name(F.col("path")).alias("instrument"))


def _write_adjusted(spark, sf) -> str:
    """Dumps with other header names: an upper-case open and only an adjusted close."""
    path = scratch_path(spark, "dumps")
    (
        panels.table(spark, sf, "orders")
        .select(
            F.lit("x").alias("Vendor"),
            (F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400_000).alias("Timestamp"),
            (F.col("o_totalprice") + 1.0).alias("OPEN"),
            F.col("o_totalprice").alias("Adj Close"),
        )
        .write.csv(path, header=True)
    )
    return path


@query
def price_column_normalise(spark, sf):
    dumps = raw.read_raw(spark, _write_adjusted(spark, sf), name_of=lambda path: F.lit("X"))
    return rounded(dumps.select("instrument", "dt", "open", "close"))


@query
def close_resolve(spark, sf):
    """No close by any name: the first column that is all numbers stands in for it."""
    path = scratch_path(spark, "dumps")
    parts = panels.table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Gmt time"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
    )
    parts.write.csv(path, header=True)
    dumps = raw.read_raw(spark, path, name_of=lambda path: F.lit("X"))
    return rounded(dumps.groupBy("instrument", "dt").agg(F.count("*").alias("n"), F.sum("close").alias("total")))


# --- projections, filters and scalar functions ---------------------------------------------


@query
def weekday_filter(spark, sf):
    return rounded(clean.weekday_filter(panels.order_bars(spark, sf)).select("instrument", "dt", "ord", "close"))


@query
def positive_log(spark, sf):
    return rounded(panels.balance_bars(spark, sf).select("ord", S.positive_log(F.col("close")).alias("log_close")))


@query
def finite_or_zero(spark, sf):
    orders = panels.table(spark, sf, "orders")
    per_key = S.ratio(F.col("o_totalprice"), F.col("o_orderkey").cast("double"))
    return rounded(orders.select("o_orderkey", S.finite_or_zero(per_key).alias("per_key")))


@query
def direction_sign(spark, sf):
    return rounded(
        panels.table(spark, sf, "customer").select(
            "c_custkey", S.direction_sign(F.col("c_acctbal")).alias("direction")
        )
    )


@query
def months_before(spark, sf):
    days = panels.order_bars(spark, sf).select("dt").distinct()
    return days.select("dt", *[S.months_before(F.col("dt"), k).alias(f"before_{k}") for k in (1, 6, 12)])


@query
def business_month_start(spark, sf):
    days = panels.order_bars(spark, sf).select("dt").distinct()
    return days.select("dt", S.business_month_start(F.col("dt")).alias("month_start"))


@query
def point_scale(spark, sf):
    """Amounts in cents back to units, with a scale per priority and a default."""
    bars = panels.order_bars(spark, sf)
    points = (
        bars.select("instrument").distinct()
        .withColumn("point", F.when(F.col("instrument") != "5-LOW", 1000.0))
    )
    units = F.round(F.col("close") * 100.0).cast("bigint")
    return rounded(
        bars.join(points, "instrument").select("ord", S.scaled_price(units, F.col("point")).alias("price"))
    )


def _priority_costs(spark, sf) -> DataFrame:
    """Per-priority costs from the share of each order status; the lowest has none listed."""
    orders = panels.table(spark, sf, "orders")

    def share(status):
        return F.avg((F.col("o_orderstatus") == status).cast("double")) * 1e-3

    return (
        orders.where(F.col("o_orderpriority") != "5-LOW")
        .groupBy(F.col("o_orderpriority").alias("instrument"))
        .agg(
            share("F").alias("spread"),
            share("O").alias("slippage"),
            share("P").alias("impact"),
            F.lit(0.0).alias("commission"),
            (share("P") * 0.1).alias("swap"),
        )
    )


@query
def cost_rate(spark, sf):
    rates = bt.cost_rate(_priority_costs(spark, sf))
    return rounded(rates.select("instrument", (F.col("rate") * 1e4).alias("rate_bp"), (F.col("swap") * 1e4).alias("swap_bp")))


@query
def swap_override(spark, sf):
    swapped = bt.swap_override(_priority_costs(spark, sf), (0.0, 0.3, 1.0))
    return rounded(swapped.select("instrument", "swap_bp", "swap", (F.col("spread") * 1e4).alias("spread_bp")))


@query
def first_passage_closed_form(spark, sf):
    """Drift and deviation from each event type's values."""
    moments = panels.table(spark, sf, "events").groupBy("event_type").agg(
        (F.avg("value") / 1e6).alias("mu"), (F.stddev_pop("value") / 1e3).alias("sigma")
    )
    p = S.first_passage_probability(F.col("mu"), F.col("sigma"), F.lit(0.05), F.lit(0.15))
    driftless = S.first_passage_probability(F.lit(0.0), F.col("sigma"), F.lit(0.05), F.lit(0.15))
    return rounded(moments.select("event_type", p.alias("p"), driftless.alias("p_driftless")))


@query
def normal_ppf(spark, sf):
    ranks = panels.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    tails = F.explode(F.array(*[F.lit(v) for v in (0.001, 0.02, 0.5, 0.98, 0.999)]))
    p = ranks.withColumn("tail", tails).withColumn("p", (F.col("tail") * F.col("n") + 0.5) / (F.col("n") + 1.0))
    return rounded(p.select("c_nationkey", "p", S.normal_ppf(F.col("p")).alias("z")))


@query
def bucket_label(spark, sf):
    suppliers = panels.table(spark, sf, "supplier")
    low = F.col("s_acctbal") / 777.0
    return suppliers.select("s_suppkey", S.bucket_label(low, low + 0.5).alias("label"))


@query
def window_slice(spark, sf):
    sliced = clean.from_date(clean.split_period(priority(spark, sf), SPLIT), "1996-06-01")
    return sliced.groupBy("instrument", "period").agg(
        F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last")
    )


@query
def holdout_filter(spark, sf):
    kept = clean.before_holdout(priority(spark, sf), F.lit("1999-01-01").cast("date"))
    return kept.groupBy("instrument").agg(F.count("*").alias("n"), F.max("dt").alias("last"))


@query
def phase_rules(spark, sf):
    """The same histories under both phases' targets."""
    targets = {1: RULES.phase1_target, 2: RULES.phase2_target}
    found = barrier.first_passage_phases(
        panels.user_steps(spark, sf), ["user_id"], targets, RULES.daily_loss_limit, RULES.max_drawdown
    )
    return found.groupBy("phase", "outcome").agg(F.count("*").alias("n"))


def _samples(spark, sf) -> DataFrame:
    members = priority(spark, sf).select("instrument").distinct()
    return members.withColumn("panel", F.lit("B")).unionByName(
        members.where(F.col("instrument").isin(*SAMPLE_A)).withColumn("panel", F.lit("A"))
    )


@query
def universe_filter(spark, sf):
    sampled = align.universe_filter(priority(spark, sf), _samples(spark, sf))
    return calendars.frame_calendar(sampled).select("panel", "dt", F.col("pos").cast("bigint").alias("pos"))


# --- joins and alignment ----------------------------------------------------------------------


@query
def align_union(spark, sf):
    return rounded(align.price_frame(*stored(priority(spark, sf))).select("instrument", "dt", "close", "filled"))


@query
def align_weights(spark, sf):
    """Equal weights on traded days only; every other cell of the frame is flat."""
    prices, calendar = stored(priority(spark, sf))
    weights = prices.select("panel", "instrument", "dt", F.lit(0.2).alias("w"))
    return rounded(align.align_weights(prices, weights, calendar).select("instrument", "dt", "w"))


@query
def asof_lookback(spark, sf):
    prices = materialize(priority(spark, sf), "prices")
    return rounded(align.asof_lookback(prices, 12).select("instrument", "dt", "close", "past"))


@query
def frame_ffill(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    return rounded(align.frame_ffill(prices, prices, "close", calendar).select("instrument", "dt", "close"))


@query
def calendar_anti(spark, sf):
    return calendars.missing_weekdays(panels.order_bars(spark, sf))


@query
def cost_lookup(spark, sf):
    members = priority(spark, sf).select("instrument").distinct()
    rates = bt.cost_lookup(members, _priority_costs(spark, sf))
    return rounded(rates.select("instrument", (F.col("rate") * 1e4).alias("rate_bp"), (F.col("swap") * 1e4).alias("swap_bp")))


@query
def rebalance_hold(spark, sf):
    calendar = calendars.frame_calendar(priority(spark, sf))
    return calendars.rebalance_calendar(calendar).select("dt", "rebalance_dt", "source_dt")


@query
def leverage_grid(spark, sf):
    """Outcomes of real histories under every leverage, from one pass over the steps."""
    steps = panels.user_steps(spark, sf)
    found = barrier.first_passage_grid(
        steps, ["user_id"], RULES.phase1_target, RULES.daily_loss_limit, RULES.max_drawdown, FULL.leverages
    )
    return rounded(found.groupBy("k", "outcome").agg(F.count("*").alias("n"), F.avg("day").alias("mean_day")))


@query
def block_gather(spark, sf):
    """Twenty consecutive returns from every start, wrapping around."""
    indexed = bootstrap.indexed_series(bootstrap.finite_returns(held_returns(spark, sf)), ["panel"])
    blocks = bootstrap.wrapped_blocks(indexed, ["panel"], F.col("ret"), 20)
    return rounded(
        blocks.select(F.col("start").cast("bigint").alias("start"), F.posexplode("items").alias("offset", "ret"))
    )


def _study_daily(spark, sf) -> DataFrame:
    return momentum_study.daily_series(priority(spark, sf), _samples(spark, sf), EVAL_START)


@query
def trial_grid(spark, sf):
    return rounded(momentum_study.trial_sharpes(_study_daily(spark, sf)))


# --- sort, dedup, limit, set operations ----------------------------------------------------------


@query
def sort_by_date(spark, sf):
    order = W.partitionBy("instrument").orderBy("dt")
    bars = clean.dedup_keep_last(panels.order_bars(spark, sf))
    return rounded(bars.select("instrument", "dt", F.row_number().over(order).cast("bigint").alias("rank"), "close"))


@query
def dedup_keep_last(spark, sf):
    return rounded(clean.dedup_keep_last(panels.order_bars(spark, sf)).select("instrument", "dt", "ord", "close"))


@query
def dup_detect(spark, sf):
    return clean.duplicate_dates(panels.event_bars(spark, sf))


@query
def limit_per_group(spark, sf):
    found = quality.anomalies(None, clean.clean_bars(panels.balance_bars(spark, sf)))
    listed = quality.first_anomalies(found, 50)
    return listed.select("instrument", F.col("rank").cast("bigint").alias("rank"), "dt", "kind", "more")


@query
def nth_sample(spark, sf):
    return rounded(metrics.sampled_equity(held_returns(spark, sf)))


@query
def best_trial(spark, sf):
    found = momentum_study.primary_trials(_study_daily(spark, sf))
    return rounded(trials.best_trial(found, "panel", "lookback"))


@query
def date_difference(spark, sf):
    """Frame dates on which an instrument did not trade."""
    cells = align.price_frame(*stored(priority(spark, sf)))
    return cells.where(F.col("close").isNull()).select("instrument", "dt")


@query
def concat_rows(spark, sf):
    both = panels.order_bars(spark, sf).unionByName(panels.balance_bars(spark, sf))
    return rounded(both.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("close").alias("total")))


# --- windows --------------------------------------------------------------------------------------


def _close_shares(prices) -> DataFrame:
    """Weights that change: the share of an instrument's close in its date's total."""
    shares = exposure.cross_section_normalise(prices.withColumn("w", F.col("close")))
    return shares.select("panel", "instrument", "dt", "w")


def _traded_weights(spark, sf) -> DataFrame:
    return _close_shares(materialize(priority(spark, sf), "prices"))


@query
def lag_one(spark, sf):
    return rounded(exposure.lag_one(_traded_weights(spark, sf)).select("instrument", "dt", "held"))


@query
def ffill(spark, sf):
    """Days that end on a non-positive balance take the last positive one."""
    bars = clean.clean_bars(panels.balance_bars(spark, sf))
    usable = bars.withColumn("close", F.when(F.col("close") > 0, F.col("close")))
    return rounded(exposure.ffill(usable, "close", ["instrument"]).select("instrument", "dt", "close"))


@query
def gap_safe_returns(spark, sf):
    return rounded(returns.gap_safe_returns(*stored(priority(spark, sf))).select("instrument", "dt", "ret"))


@query
def own_calendar_returns(spark, sf):
    return rounded(returns.own_calendar_returns(brand(spark, sf)).select("instrument", "dt", "own_ret"))


@query
def rolling_vol(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    return rounded(returns.rolling_vol(prices, calendar=calendar).select("instrument", "dt", "vol"))


@query
def exante_scalar(spark, sf):
    sized = signals.momentum_raw(materialize(priority(spark, sf), "prices"), (12,))
    scale = signals.daily_scale(sized, ["panel", "lookback"])
    return rounded(scale.select("dt", "port_ret", "port_vol", "scalar"))


@query
def turnover(spark, sf):
    return rounded(exposure.turnover(_traded_weights(spark, sf)).select("instrument", "dt", "turnover"))


@query
def equity_curve(spark, sf):
    return rounded(metrics.equity_curve(held_returns(spark, sf)).select("dt", "equity"))


@query
def drawdown(spark, sf):
    return rounded(metrics.drawdown(held_returns(spark, sf)).select("dt", "drawdown"))


@query
def additive_pnl(spark, sf):
    """To nine decimals: some of these values lie halfway between two sixth ones."""
    return rounded(panels.user_steps(spark, sf).select("user_id", "day", "r", "pnl"), 9)


@query
def log_return(spark, sf):
    bars = clean.clean_bars(panels.balance_bars(spark, sf))
    return rounded(quality.log_returns(bars).select("instrument", "dt", "log_ret"))


@query
def open_gap(spark, sf):
    return rounded(quality.open_gaps(panels.ohlc_bars(spark, sf)).select("instrument", "dt", "open_gap"))


@query
def lead_one(spark, sf):
    return rounded(signals.sign_of_next_return(*stored(priority(spark, sf))).select("instrument", "dt", "w"))


@query
def sq_autocorr(spark, sf):
    return rounded(metrics.squared_autocorrelation(held_returns(spark, sf)))


@query
def weight_change(spark, sf):
    return rounded(exposure.weight_change(_traded_weights(spark, sf)).select("instrument", "dt", "change"))


# --- aggregates -------------------------------------------------------------------------------------


def _event_clean(spark, sf) -> DataFrame:
    return clean.weekday_filter(panels.event_ohlc(spark, sf))


@query
def anomalous_return(spark, sf):
    return quality.anomalous_returns(clean.clean_bars(panels.balance_bars(spark, sf)), sigma=3.0)


@query
def session_gap(spark, sf):
    return quality.session_gaps(_event_clean(spark, sf), sigma=2.5)


@query
def nonpositive_price(spark, sf):
    return quality.nonpositive_prices(clean.clean_bars(panels.balance_bars(spark, sf)))


@query
def calendar_gap(spark, sf):
    return quality.calendar_gaps(clean.clean_bars(panels.order_bars(spark, sf)))


@query
def duplicate_dates(spark, sf):
    return quality.duplicate_date_anomalies(panels.balance_bars(spark, sf))


@query
def quality_summary(spark, sf):
    raw_bars = panels.balance_bars(spark, sf)
    summary = quality.quality_summary(raw_bars, clean.clean_bars(raw_bars))
    kinds = (*quality.KIND_ORDER, "calendar_gap", "duplicate_dates")
    counts = [F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).alias(k) for k in kinds]
    return summary.select("instrument", "n_obs", "start", "end", "missing_days", *counts)


@query
def quality_merge(spark, sf):
    """States of the months up to 1997 and of those after, stored one after the other, combined."""
    raw_bars = panels.balance_bars(spark, sf)
    path = scratch_path(spark, "states")
    for part in (F.year("dt") <= 1997, F.year("dt") > 1997):
        some = raw_bars.where(part)
        stores.write_months(quality_state.states(clean.clean_bars(some), some), path)
    found = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    return quality_state.summary(found, clean.clean_bars(raw_bars))


@query
def counts_by_kind(spark, sf):
    return quality.counts_by_kind(quality.anomalies(panels.event_bars(spark, sf), _event_clean(spark, sf), 2.5))


def _sign_weights(prices, calendar) -> DataFrame:
    weights = signals.sign_of_last_return(prices, calendar)
    return weights.withColumn("w", F.col("w") * 0.25)


def _long_short(spark, sf) -> DataFrame:
    return _sign_weights(*stored(brand(spark, sf)))


@query
def gross_exposure(spark, sf):
    return rounded(exposure.gross_exposure(_long_short(spark, sf)).select("dt", "gross"))


@query
def exposure_violations(spark, sf):
    return rounded(exposure.exposure_violations(_long_short(spark, sf)).select("dt", "gross"))


@query
def validate_weights(spark, sf):
    """Momentum weights keep within the cap: the check passes and returns no date."""
    weights = momentum_weights(spark, sf)
    exposure.validate_weights(weights)
    return exposure.exposure_violations(weights).select("dt")


@query
def weight_violations(spark, sf):
    """The same weights against a cap that they break: the check names dates, all of them are listed."""
    weights = materialize(momentum_weights(spark, sf), "weights")
    found = exposure.exposure_violations(weights, TIGHT_CAP)
    try:
        exposure.validate_weights(weights, TIGHT_CAP)
        raised = False
    except ValueError:
        raised = True
    return rounded(found.select("dt", "gross", F.lit(raised).alias("raised")))


@query
def cross_section_normalise(spark, sf):
    return rounded(exposure.cross_section_normalise(_long_short(spark, sf)).select("instrument", "dt", "w"))


@query
def gross_cap(spark, sf):
    return rounded(exposure.gross_cap(_long_short(spark, sf)).select("instrument", "dt", "w"))


def _daily(spark, sf) -> DataFrame:
    prices, calendar = stored(priority(spark, sf))
    weights = _close_shares(prices)
    return bt.daily_breakdown(prices, weights, _priority_costs(spark, sf), calendar=calendar)


@query
def portfolio_return(spark, sf):
    return rounded(_daily(spark, sf).select("dt", "gross"))


@query
def turnover_cost(spark, sf):
    return rounded(_daily(spark, sf).select("dt", "turnover", (F.col("turnover_cost") * 1e4).alias("cost_bp")))


@query
def swap_cost(spark, sf):
    return rounded(_daily(spark, sf).select("dt", "held", (F.col("swap_cost") * 1e4).alias("cost_bp")))


@query
def backtest(spark, sf):
    prices, calendar = stored(brand(spark, sf))
    weights = _sign_weights(prices, calendar)
    return rounded(bt.backtest(prices, weights, calendar=calendar).select("dt", (F.col("ret") * 1e4).alias("ret_bp")))


@query
def bars_per_year(spark, sf):
    prices = brand(spark, sf)
    own = returns.own_calendar_returns(prices).withColumnRenamed("own_ret", "ret")
    return rounded(metrics.bars_per_year(own, ("instrument",)))


@query
def sharpe(spark, sf):
    own = returns.own_calendar_returns(brand(spark, sf)).withColumnRenamed("own_ret", "ret")
    return rounded(metrics.sharpe(own, ("instrument",)))


@query
def performance_metrics(spark, sf):
    return rounded(metrics.metrics(held_returns(spark, sf)))


@query
def return_histogram(spark, sf):
    found = metrics.return_histogram(held_returns(spark, sf))
    return rounded(found.select("panel", "bin", "low", "high", "label", "n"))


@query
def annual_turnover(spark, sf):
    return rounded(metrics.annual_turnover(_daily(spark, sf)))


@query
def live_start(spark, sf):
    return exposure.live_start(momentum_weights(spark, sf), "1996-01-01")


@query
def subperiod_stats(spark, sf):
    return rounded(metrics.subperiod_stats(clean.split_period(held_returns(spark, sf), SPLIT)))


@query
def dd_over_vol(spark, sf):
    return rounded(metrics.drawdown_over_vol(held_returns(spark, sf)))


@query
def zero_cost_sharpe(spark, sf):
    return rounded(momentum_study.calibration(_study_daily(spark, sf)))


@query
def swap_sensitivity(spark, sf):
    return rounded(momentum_study.swap_sensitivity(_study_daily(spark, sf)))


@query
def deflated_sharpe(spark, sf):
    return rounded(trials.deflated_sharpe(momentum_study.primary_trials(_study_daily(spark, sf))))


@query
def verdict(spark, sf):
    return rounded(momentum_study.verdict(_study_daily(spark, sf)))


@query
def verdict_bars(spark, sf):
    """The same study under limits that reach every branch: degraded, marginal and viable."""
    daily = materialize(_study_daily(spark, sf), "study")
    result = None
    for bar, (success, falsifier) in enumerate(BARS):
        found = momentum_study.verdict(daily, StudyThresholds(success=success, falsifier=falsifier)).withColumn("bar", F.lit(bar))
        result = found if result is None else result.unionByName(found)
    return rounded(result)


@query
def reference_sharpe_check(spark, sf):
    """Gross buy-and-hold of each instrument alone against one published ratio."""
    alone, calendar = stored(brand(spark, sf).withColumn("panel", F.col("instrument")))
    weights = signals.buy_and_hold(alone, calendar=calendar)
    gross = bt.backtest(alone, weights, apply_costs=False, calendar=calendar)
    return rounded(metrics.reference_sharpe_check(gross, SharpeReference(value=5.0, tolerance=0.5)))


# --- signals ----------------------------------------------------------------------------------------


@query
def buy_and_hold(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    return rounded(signals.buy_and_hold(prices, 0.9, calendar).select("instrument", "dt", "w"))


@query
def tsmom(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    weights = signals.tsmom(prices, calendar=calendar)
    return rounded(align.align_weights(prices, weights, calendar).select("instrument", "dt", "w"))


@query
def tsmom_fixed_year(spark, sf):
    """Six-month lookback, annualised with a constant so later data cannot move it."""
    prices, calendar = stored(brand(spark, sf))
    weights = signals.tsmom(prices, 6, periods_per_year=252.0, calendar=calendar)
    return rounded(weights.select("instrument", "dt", "w"))


@query
def tsmom_backtest(spark, sf):
    prices, calendar = stored(brand(spark, sf))
    weights = signals.tsmom(prices, calendar=calendar)
    active = bt.active_days(prices, weights, calendar=calendar).select("panel", "dt", bt.net_of_costs().alias("ret"))
    return rounded(metrics.sparse_metrics(active, metrics.frame_lengths(calendar)))


@query
def lookahead_guard(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    result = None
    for name, signal in (("cheat", signals.sign_of_next_return), ("honest", signals.sign_of_last_return)):
        gross = bt.backtest(prices, signal(prices, calendar), apply_costs=False, calendar=calendar)
        ratio = metrics.sharpe(gross)
        row = ratio.select(F.lit(name).alias("signal"), "sharpe", (F.col("sharpe") > 5).alias("caught"))
        result = row if result is None else result.unionByName(row)
    return rounded(result)


@query
def signal_contract(spark, sf):
    """Two signals, one of which looks a day ahead, on panels cut at three dates."""
    prices = materialize(priority(spark, sf), "prices")
    result = None
    for name, signal in (("cheat", signals.sign_of_next_return), ("honest", signals.sign_of_last_return)):
        found = signals.signal_contract(signal, prices).select(
            F.lit(name).alias("signal"), "cut", "last_dt", "n_cells", "n_changed", "first_changed", "n_strays"
        )
        result = found if result is None else result.unionByName(found)
    return result


# --- resampling and barriers -----------------------------------------------------------------------------


@query
def block_bootstrap(spark, sf):
    drawn = bootstrap.block_bootstrap(held_returns(spark, sf), FULL.n_paths, FULL.horizon_days, FULL.block_size, FULL.seed)
    return rounded(
        drawn.groupBy("path").agg(
            F.count("*").alias("days"),
            F.sum("r").alias("total"),
            F.max_by("r", "day").alias("last"),
            F.sum(F.col("r") * F.col("day")).alias("weighted"),
        )
    )


@query
def first_passage(spark, sf):
    limits = (RULES.phase1_target, RULES.daily_loss_limit, RULES.max_drawdown)
    found = materialize(barrier.first_passage_or_near(panels.user_steps(spark, sf), ["user_id"], *limits), "passages")
    again = panels.user_steps_in_order(spark, sf, found.where("near"))
    return found.where("NOT near").drop("near").unionByName(barrier.first_passage(again, ["user_id"], *limits))


@query
def passage_batches(spark, sf):
    """Histories that arrive in four quarters of their time, each run going on where the last ended."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("steps", "passages", "progress"))
    schema = "path string, at timestamp_ntz, id bigint, r double"
    events = panels.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("path"),
        F.col("ts").cast("timestamp_ntz").alias("at"),
        F.col("event_id").alias("id"),
        ((F.col("value") - 50.0) / panels.PNL_SCALE).alias("r"),
    )
    span = events.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    edges = [span["low"] + (span["high"] - span["low"]) * i / 4 for i in range(1, 4)] if span["low"] else []
    lower = F.lit(True)
    for edge in [*edges, None]:
        upper = F.lit(True) if edge is None else F.col("at") < F.lit(edge).cast("timestamp_ntz")
        events.where(lower & upper).write.mode("append").parquet(folder)
        passages.advance(spark, folder, schema, out, checkpoint, RULES)
        lower = ~upper
    return passages.outcomes(spark, out).select(F.col("path").cast("bigint").alias("user_id"), "outcome", "day")


@query
def phase_stats(spark, sf):
    return rounded(barrier.phase_stats(first_passage(spark, sf)))


@query
def funded_survival(spark, sf):
    windows = barrier.payout_windows(
        panels.user_steps(spark, sf), ["user_id"], RULES.payout_interval_days, RULES.daily_loss_limit, RULES.max_drawdown
    )
    return rounded(barrier.funded_survival(windows, RULES.payout_interval_days))


# --- turn of month -----------------------------------------------------------------------------------------


@query
def tom_flag(spark, sf):
    return seasonality.tom_flag(brand(spark, sf)).select("instrument", "dt", "tom")


@query
def tom_signal(spark, sf):
    found = turn_of_month.tom_weights(materialize(priority(spark, sf), "prices"))
    return rounded(found.select("instrument", "dt", "w", "capped"))


@query
def mean_contrast(spark, sf):
    flagged = seasonality.flagged_returns(materialize(priority(spark, sf), "prices"))
    return rounded(seasonality.mean_contrast(flagged, 1000).select("instrument", "contrast_bp", "se_bp", "ci_low_bp", "ci_high_bp"))


@query
def null_benchmark(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    found = turn_of_month.null_benchmark(prices, RESAMPLES, calendar=calendar)
    return rounded(found.select(F.col("resample").cast("bigint").alias("resample"), "sharpe"))


def _tom_against_null(prices, calendar) -> tuple[DataFrame, DataFrame]:
    earned = materialize(
        turn_of_month.tom_returns(prices, (3,), calendar=calendar).drop("after"), "tom-returns"
    )
    null = turn_of_month.null_benchmark(prices, RESAMPLES, calendar=calendar)
    return earned, seasonality.null_p_value(null, metrics.sharpe(earned))


@query
def null_p_value(spark, sf):
    return rounded(_tom_against_null(*stored(priority(spark, sf)))[1])


@query
def sharpe_ci(spark, sf):
    base = materialize(held_returns(spark, sf), "returns")
    ratios = metrics.sharpe(base).join(seasonality.years_observed(base), "panel")
    return rounded(seasonality.sharpe_ci(ratios))


@query
def window_variant(spark, sf):
    """The single pre-registered variant of the window, deflated for two trials.

    It is promoted where that beats the 95th percentile of a benchmark drawn anew, with as many
    days a month as the variant's window has.
    """
    prices, calendar = stored(priority(spark, sf))
    return rounded(turn_of_month.variant_verdict(prices, calendar, RESAMPLES))


@query
def relative_verdict(spark, sf):
    prices, calendar = stored(priority(spark, sf))
    earned, placed = _tom_against_null(prices, calendar)
    years = seasonality.years_observed(earned)
    bounded = seasonality.sharpe_ci(metrics.sharpe(earned).join(years, "panel")).select("panel", "ci_high", "status")
    contrast = (
        seasonality.mean_contrast(seasonality.flagged_returns(prices))
        .where(F.col("instrument") == seasonality.ALL)
        .select("panel", F.col("ci_low_bp").alias("contrast_low"))
    )
    found = seasonality.relative_verdict(placed.join(bounded, "panel").join(contrast, "panel"))
    return rounded(found.select("panel", "sharpe", "null_p95", "ci_high", "contrast_low", "verdict"))


QUERIES["metrics"] = QUERIES.pop("performance_metrics")
