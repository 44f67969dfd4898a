"""Column helpers that return null where plain arithmetic would fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def adjusted_skew(x: Column, frame: WindowSpec, least: int) -> Column:
    """Bias-adjusted skewness from ``least`` values on; 0 where all are equal."""
    n = F.count(x).over(frame)
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    return F.when(n >= least, F.when(flat, 0.0).otherwise(F.skewness(x).over(frame) * factor))


def lag_correlation(x: Column, before: Column, pairs: WindowSpec, frame: WindowSpec, least: int) -> Column:
    """Correlation of neighbours in a frame, from ``least`` values on; 0 where all values are equal.

    ``pairs`` is the frame less its first row, whose neighbour lies outside.
    """
    both = x.isNotNull() & before.isNotNull()
    a, b = F.when(both, x), F.when(both, before)
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    corr = ratio(F.covar_pop(a, b).over(pairs), F.stddev_pop(a).over(pairs) * F.stddev_pop(b).over(pairs))
    return F.when(F.count(x).over(frame) >= least, F.when(flat, 0.0).otherwise(corr))


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null, which ``least`` and ``greatest`` would skip."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


#: Added before rounding, in units of the last digit: engines that differ in the last bit round ties alike.
NUDGE = 1.37e-3


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    nudge = NUDGE * 10**-digits
    return df.select(*(F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
