"""Quality checks on clean bars: anomalies, their counts, and a per-instrument summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.config import ANOMALY_SIGMA
from quantspan.functions.scalars import finite, positive_log, weekdays_before
from quantspan.operators.clean import duplicate_dates


def whole():
    return W.partitionBy("instrument")


def by_date():
    return whole().orderBy("dt")


def log_returns(bars: DataFrame) -> DataFrame:
    """Difference of guarded logs between consecutive bars -> adds log_ret."""
    log_close = positive_log(F.col("close"))
    return bars.withColumn("log_ret", log_close - F.lag(log_close).over(by_date()))


def open_gaps(bars: DataFrame) -> DataFrame:
    """ln(open / previous close) where both are positive -> adds open_gap."""
    opened = F.when(finite(F.col("open")) > 0, F.col("open"))
    before = F.lag(finite(F.col("close"))).over(by_date())
    return bars.withColumn("open_gap", F.ln(F.try_divide(opened, F.when(before > 0, before))))


def _zscore(name: str) -> Column:
    """Distance from the instrument's mean in population deviations; NULL when flat."""
    spread = F.stddev_pop(name).over(whole())
    return (F.col(name) - F.avg(name).over(whole())) / F.when(spread > 0, spread)


def nonpositive_prices(bars: DataFrame) -> DataFrame:
    close = finite(F.col("close"))
    bad = bars.where((close <= 0) | close.isNull())
    return bad.select("instrument", "dt", F.lit("nonpositive_price").alias("kind"), F.lit("").alias("detail"))


def anomalous_returns(bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    scored = log_returns(bars).withColumn("z", _zscore("log_ret"))
    return scored.where(F.abs("z") > sigma).select(
        "instrument",
        "dt",
        F.lit("anomalous_return").alias("kind"),
        F.format_string("z=%.1f", "z").alias("detail"),
    )


def session_gaps(bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """Opening jumps against the previous close; none when the bars have no open."""
    if "open" not in bars.columns:
        return nonpositive_prices(bars).where(F.lit(False))
    scored = open_gaps(bars).withColumn("z", _zscore("open_gap"))
    return scored.where(F.abs("z") > sigma).select(
        "instrument", "dt", F.lit("session_gap").alias("kind"), F.lit("").alias("detail")
    )


def _skipped() -> Column:
    """Weekdays between a bar and the next one, by arithmetic on the two dates."""
    after = F.lead("dt").over(by_date())
    skipped = weekdays_before(after) - weekdays_before(F.date_add("dt", 1))
    return F.when(after.isNotNull(), F.greatest(skipped, F.lit(0)))


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """Number of missing weekdays, for instruments that miss any."""
    return _gap_anomalies(
        bars.withColumn("skipped", _skipped()).groupBy("instrument").agg(F.sum("skipped").alias("missing"))
    )


def _gap_anomalies(missing: DataFrame) -> DataFrame:
    return missing.where(F.col("missing") > 0).select(
        "instrument",
        F.lit(None).cast("date").alias("dt"),
        F.lit("calendar_gap").alias("kind"),
        F.format_string("%d weekdays", "missing").alias("detail"),
    )


def duplicate_date_anomalies(raw: DataFrame) -> DataFrame:
    return (
        duplicate_dates(raw)
        .where("has_duplicates")
        .select(
            "instrument",
            F.lit(None).cast("date").alias("dt"),
            F.lit("duplicate_dates").alias("kind"),
            F.lit("").alias("detail"),
        )
    )


# Dated checks, in the order a report lists them.
KIND_ORDER = ("nonpositive_price", "anomalous_return", "session_gap")


def checked_bars(bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """Every check on every bar in one pass -> adds (z, skipped, one flag per dated kind).

    One shuffle on the instrument, whose rows are bounded by the days of the calendar once
    the bars are clean.
    """
    has_open = "open" in bars.columns
    scored = bars.withColumn("skipped", _skipped())
    scored = log_returns(open_gaps(scored) if has_open else scored)
    scored = scored.withColumn("z", _zscore("log_ret"))
    gap = F.abs(_zscore("open_gap")) > sigma if has_open else F.lit(False)
    close = finite(F.col("close"))
    flags = {
        "nonpositive_price": (close <= 0) | close.isNull(),
        "anomalous_return": F.abs("z") > sigma,
        "session_gap": gap,
    }
    return scored.withColumns({k: F.coalesce(flags[k], F.lit(False)) for k in KIND_ORDER})


def anomalies(raw: DataFrame | None, bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """Every check at once -> (instrument, dt, kind, detail)."""
    checked = checked_bars(bars, sigma)
    found = [
        F.when(
            F.col(kind),
            F.struct(
                F.lit(kind).alias("kind"),
                (F.format_string("z=%.1f", "z") if kind == "anomalous_return" else F.lit("")).alias("detail"),
            ),
        )
        for kind in KIND_ORDER
    ]
    dated = checked.select("instrument", "dt", F.inline(F.array_compact(F.array(*found))))
    result = dated.unionByName(calendar_gaps(bars))
    return result if raw is None else result.unionByName(duplicate_date_anomalies(raw))


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("instrument", "kind").agg(F.count("*").alias("n"))


def quality_summary(raw: DataFrame | None, bars: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """-> (instrument, n_obs, start, end, missing_days, counts MAP<kind, n>)"""
    totals = (
        checked_bars(bars, sigma)
        .groupBy("instrument")
        .agg(
            F.count("*").alias("n_obs"),
            F.min("dt").alias("start"),
            F.max("dt").alias("end"),
            F.coalesce(F.sum("skipped"), F.lit(0)).alias("missing_days"),
            *[F.count_if(F.col(k)).alias(k) for k in KIND_ORDER],
        )
        .withColumn("calendar_gap", (F.col("missing_days") > 0).cast("bigint"))
    )
    if raw is None:
        totals = totals.withColumn("duplicate_dates", F.lit(0).cast("bigint"))
    else:
        repeated = F.coalesce(F.col("has_duplicates"), F.lit(False)).cast("bigint")
        totals = totals.join(duplicate_dates(raw), "instrument", "left").withColumn(
            "duplicate_dates", repeated
        )
    kinds = (*KIND_ORDER, "calendar_gap", "duplicate_dates")
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k) for k in kinds]))
    return totals.select(
        "instrument",
        "n_obs",
        "start",
        "end",
        "missing_days",
        F.map_filter(counts, lambda kind, n: n > 0).alias("counts"),
    )


def ranked_anomalies(found: DataFrame, per_instrument: int = 200) -> DataFrame:
    """All dated anomalies, numbered per instrument, and how many there are beyond a listing.

    -> (instrument, rank, dt, kind, detail, more)
    """
    kind_rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    listing = whole().orderBy(kind_rank, "dt")
    return (
        found.where(F.col("dt").isNotNull())
        .select(
            "instrument",
            F.row_number().over(listing).alias("rank"),
            "dt",
            "kind",
            "detail",
            F.greatest(F.count("*").over(whole()) - per_instrument, F.lit(0)).alias("more"),
        )
    )


def first_anomalies(found: DataFrame, per_instrument: int = 200) -> DataFrame:
    """The listing of a report: the first `per_instrument` rows of `ranked_anomalies`."""
    return ranked_anomalies(found, per_instrument).where(F.col("rank") <= per_instrument)
