"""Distribution functions in NumPy, for use at the Python boundary."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    return front * _fraction(a, b, x)


def _fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + t1 / (1 + t2 / ...)), from the far end; 200 terms are exact to double precision where the caller uses it."""
    value = 1.0
    for i in range(200, 0, -1):
        m = i // 2
        t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + t / value
    return 1 / value


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t."""
    return np.array([np.nan if not n > 0 or np.isnan(x) else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)])


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of the incomplete beta function, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if incomplete_beta(a, b, mid) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-15:
            break
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float) -> tuple[float, float]:
    """Exact binomial interval; NaN without trials."""
    if n == 0:
        return float("nan"), float("nan")
    low = 0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)
    high = 1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k)
    return low, high
