"""Scores as column expressions; each is an aggregate unless it says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS, QUANTILES, TINY, TINY_SCALE


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """To the nearest, the same way in every engine (not an aggregate).

    Means of prices often lie just half-way between two results, where the last bit would decide; the limit is set a little aside.
    """
    return F.floor(col(x) * 10.0**digits + 0.501).cast("double") / 10.0**digits


def mae(actual, forecast) -> Column:
    return F.avg(F.abs(col(actual) - col(forecast)))


def rmse(actual, forecast) -> Column:
    d = col(actual) - col(forecast)
    return F.sqrt(F.avg(d * d))


def smape(actual, forecast) -> Column:
    """Symmetric percentage error from 0 to 200; a zero denominator counts as TINY."""
    a, f = col(actual), col(forecast)
    size = F.abs(a) + F.abs(f)
    return F.avg(200 * F.abs(a - f) / F.when(size == 0, TINY).otherwise(size))


def ratio(model: Column, baseline: Column) -> Column:
    """Model error over baseline error; over a zero baseline 0 for a zero error, else infinity (not an aggregate)."""
    return F.when(baseline == 0, F.when(model == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(model, baseline))


def pinball_term(actual, quantile, level: float) -> Column:
    """Loss of one row at one level (not an aggregate)."""
    d = col(actual) - col(quantile)
    return F.greatest(level * d, (level - 1) * d)


def pinball(actual, quantile, level: float) -> Column:
    return F.avg(pinball_term(actual, quantile, level))


def mean_pinball(actual) -> Column:
    return reduce(lambda a, b: a + b, [pinball(actual, q, level) for q, level in zip(QUANTILES, LEVELS, strict=True)]) / len(LEVELS)


def coverage(actual, low="q10", high="q90") -> Column:
    """Share of rows from low to high, both included."""
    a = col(actual)
    return F.avg(((a >= col(low)) & (a <= col(high))).cast("double"))


def pit(actual) -> Column:
    """Level of the actual value by linear interpolation between the sorted quantiles, from 0.1 to 0.9; of equal quantiles the rightmost counts (not an aggregate)."""
    a, qs = col(actual), F.array_sort(F.array(*QUANTILES))
    at = [F.element_at(qs, i + 1) for i in range(len(LEVELS))]
    out = F.when(a >= at[-1], LEVELS[-1]).when(a < at[0], LEVELS[0])
    for i in range(len(LEVELS) - 2, -1, -1):
        step = F.try_divide(a - at[i], at[i + 1] - at[i])
        out = out.when(a >= at[i], LEVELS[i] + (LEVELS[i + 1] - LEVELS[i]) * F.coalesce(step, F.lit(0.0)))
    return out


def quantile_bin(actual) -> Column:
    """How many quantiles lie strictly below the actual value, 0 to 9 (not an aggregate)."""
    return reduce(lambda a, b: a + b, [(F.col(q) < col(actual)).cast("bigint") for q in QUANTILES])


def in_sample_scale(value: Column, lagged: Column) -> Column:
    """Mean absolute seasonal difference, at least TINY_SCALE."""
    return F.greatest(F.avg(F.abs(value - lagged)), F.lit(TINY_SCALE))


def weighted_interval_score(actual) -> Column:
    """Score of one row: half the median's error and the interval scores of the four central intervals (not an aggregate)."""
    a = col(actual)
    total = 0.5 * F.abs(a - F.col("q50"))
    for alpha, low, high in ((0.2, "q10", "q90"), (0.4, "q20", "q80"), (0.6, "q30", "q70"), (0.8, "q40", "q60")):
        lo, hi = F.col(low), F.col(high)
        score = (hi - lo) + (2 / alpha) * F.greatest(lo - a, F.lit(0.0)) + (2 / alpha) * F.greatest(a - hi, F.lit(0.0))
        total = total + alpha / 2 * score
    return total / 4.5
