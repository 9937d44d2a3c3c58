"""Column expressions. All are native: they stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantspan.config import DEFAULT_POINT


def finite(x: Column) -> Column:
    """NaN and the infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """`num / den`, NULL when the divisor is zero."""
    return F.try_divide(num, den)


def positive_log(x: Column) -> Column:
    """Natural logarithm of finite positive values, NULL otherwise."""
    return F.ln(F.when(finite(x) > 0, x))


def direction_sign(x: Column) -> Column:
    return F.signum(x)


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def weekdays_before(day: Column) -> Column:
    """Mondays to Fridays since a fixed Monday, `day` itself not counted."""
    days = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def months_before(day: Column, months: int) -> Column:
    """`months` calendar months earlier, clamped to the end of the month."""
    return F.add_months(day, -months)


def business_month_start(day: Column) -> Column:
    """First Monday-to-Friday day of the month of `day`."""
    first = F.trunc(day, "MM")
    wd = F.weekday(first)
    return F.date_add(first, F.when(wd == 5, 2).when(wd == 6, 1).otherwise(0))


def scaled_price(units: Column, point: Column) -> Column:
    """Integer price units to quoted price."""
    return units / F.coalesce(point, F.lit(DEFAULT_POINT))


def bucket_label(low: Column, high: Column) -> Column:
    return F.format_string("[%+.4f, %+.4f)", low, high)


def first_passage_probability(mu: Column, sigma: Column, loss: Column, gain: Column) -> Column:
    """P(reach +gain before -loss) of a drifted Brownian motion; NULL sigma stays NULL."""
    k = 2.0 * mu / (sigma * sigma)
    drifted = (1.0 - F.exp(-k * loss)) / (1.0 - F.exp(-k * (loss + gain)))
    return (
        F.when(sigma <= 0, F.raise_error("sigma must be > 0").cast("double"))
        .when(mu == 0, loss / (loss + gain))
        .otherwise(drifted)
    )


# Coefficients of the published rational approximation of the inverse
# normal distribution (central region A/B, tails C/D).
PROBIT_A = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
PROBIT_B = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
)
PROBIT_C = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
PROBIT_D = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
)
PROBIT_TAIL = 0.02425


def _polynomial(coefficients, x: Column, last: float | None = None) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:] if last is None else (*coefficients[1:], last):
        acc = acc * x + F.lit(c)
    return acc


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function, 0 < p < 1."""
    centre = p - 0.5
    squared = centre * centre
    middle = _polynomial(PROBIT_A, squared) * centre / _polynomial(PROBIT_B, squared, 1.0)

    def tail(q: Column) -> Column:
        return _polynomial(PROBIT_C, q) / _polynomial(PROBIT_D, q, 1.0)

    return (
        F.when(p < PROBIT_TAIL, tail(F.sqrt(-2.0 * F.ln(p))))
        .when(p > 1.0 - PROBIT_TAIL, -tail(F.sqrt(-2.0 * F.ln(1.0 - p))))
        .otherwise(middle)
    )


def hashed_draw(n: Column, *parts: Column) -> Column:
    """Integer in [0, n) that depends only on `parts`.

    Unlike `rand(seed)` it does not move with the partitioning or with a task retry.
    """
    digest = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    # Never NULL, and declared so: a join on the draw needs no extra filter that hashes again.
    return F.coalesce(F.conv(digest, 16, 10).cast("bigint") % n, F.lit(0))
