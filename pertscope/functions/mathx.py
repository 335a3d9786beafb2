"""Closed-form math on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

# ln(m!) for m = 0..9, used below the Stirling-series cut-over.
_LN_FACT_SMALL = np.array([math.lgamma(m + 1) for m in range(10)])
_HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def log_factorial(m: np.ndarray) -> np.ndarray:
    """ln(m!) for whole m >= 0.

    Exact table for m < 10, otherwise the Stirling series of ln Gamma(m+1) up to
    the z^-7 term (truncation error below 1e-12 relative for z >= 11).
    """
    m = np.asarray(m, dtype=np.int64)
    z = np.maximum(m, 10) + 1.0
    z2 = z * z
    series = ((z - 0.5) * np.log(z) - z + _HALF_LN_2PI
              + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z2) + 1.0 / (1260.0 * z * z2 * z2)
              - 1.0 / (1680.0 * z * z2 * z2 * z2))
    return np.where(m < 10, _LN_FACT_SMALL[np.minimum(m, 9)], series)


def log_binom(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(np.asarray(n) - k)


def hypergeom_pmf(total: int, marked: int, drawn: int) -> tuple[np.ndarray, int]:
    """P(X = i) for i from the lower to the upper end of the support of X, the
    marked among ``drawn`` of ``total`` things of which ``marked`` are; and the
    lower end."""
    low, high = max(0, drawn + marked - total), min(marked, drawn)
    i = np.arange(low, high + 1)
    return np.exp(log_binom(marked, i) + log_binom(total - marked, drawn - i) - log_binom(total, drawn)), low
