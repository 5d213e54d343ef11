"""Aggregate and scalar statistics as Spark columns.

Percentile arguments ``p`` are within 0 to 1. All skip nulls; the functions that sort a group collect one numeric column of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal quantile by Abramowitz and Stegun, 26.2.23.
QUANTILE_TOP = (2.515517, 0.802853, 0.010328)
QUANTILE_BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean0(x: str | Column) -> Column:
    """Mean, 0 for no values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def linear(x: str | Column, p: float) -> Column:
    """Percentile with linear interpolation of the finite values."""
    v = col(x)
    return F.percentile(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), max(0.0, min(1.0, p)))


def abs_linear(x: str | Column, p: float) -> Column:
    """The same of absolute values, 0 for no values."""
    return F.coalesce(F.percentile(F.abs(col(x)), p), F.lit(0.0))


def at_index(x: str | Column, index: Column) -> Column:
    """The value at a 0-based place of the sorted values."""
    return F.element_at(F.sort_array(F.collect_list(x)), index.cast("int") + 1)


def nearest(x: str | Column, p: float) -> Column:
    """The value at place round((n - 1) p)."""
    return at_index(x, F.round((F.count(x) - 1) * p))


def ceiling(x: str | Column, p: float) -> Column:
    """The value at place ceil(p n) - 1."""
    return at_index(x, F.ceil(F.count(x) * p) - 1)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation, 0 where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))), F.lit(0.0))


def safe_pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation within -1 and 1, 0 for fewer than two pairs or next to no spread."""
    n = F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.when((n >= 2) & (spread * n > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(0.0)


def normal_quantile(p: float) -> float:
    """Of the standard normal distribution, by a rational approximation."""
    tail = min(p, 1 - p)
    t = math.sqrt(-2 * math.log(tail))
    value = t - sum(c * t**i for i, c in enumerate(QUANTILE_TOP)) / sum(c * t**i for i, c in enumerate(QUANTILE_BOTTOM))
    return value if p > 0.5 else -value


def bonferroni_r(tests: str | Column, n: str | Column, alpha: float = 0.05) -> Column:
    """The correlation that is significant among ``tests`` ones over ``n`` pairs; 0.5 where that can't be said."""
    many, pairs = col(tests), col(n)
    t = F.sqrt(-2 * F.log(alpha / (2 * F.greatest(many, F.lit(1)))))
    power = lambda of: sum((c * F.pow(t, F.lit(i)) for i, c in enumerate(of)), F.lit(0.0))
    z = t - power(QUANTILE_TOP) / power(QUANTILE_BOTTOM)
    return F.when((many > 0) & (pairs >= 4), z / F.sqrt(z * z + pairs - 2)).otherwise(0.5)
