"""Closed-form statistics, as column expressions where rows are involved."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares below this are raised to it before a stability index is taken.
PSI_FLOOR = 1e-4


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def wilson(share: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Score interval of a share; (0, 1) without rows."""
    z2 = z * z
    size = F.when(n > 0, n.cast("double"))
    bottom = 1 + z2 / size
    centre = (share + z2 / (2 * size)) / bottom
    margin = z * F.sqrt(share * (1 - share) / size + z2 / (4 * size * size)) / bottom
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(1.0))


def share_difference(a: Column, n: Column, b: Column, m: Column, z: float) -> tuple[Column, Column]:
    """Newcombe's interval of a - b."""
    (a_low, a_high), (b_low, b_high) = wilson(a, n, z), wilson(b, m, z)
    gap = a - b
    return gap - F.hypot(a - a_low, b_high - b), gap + F.hypot(a_high - a, b - b_low)


def psi(reference: Column, current: Column) -> Column:
    """The aggregate of (q - p) ln(q / p) over bins, shares floored."""
    p, q = F.greatest(reference, F.lit(PSI_FLOOR)), F.greatest(current, F.lit(PSI_FLOOR))
    return F.sum((q - p) * F.log(q / p))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are given; null for fewer than two or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between the neighbours at (n - 1) q."""
    return F.percentile(x, F.lit(q))


def floor_quantile_rank(n: Column, q: float) -> Column:
    """1-based rank of the quantile without interpolation."""
    return (F.floor((n - 1) * q) + 1).cast("long")
