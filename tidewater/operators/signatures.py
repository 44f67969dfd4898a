"""Twelve descriptors of the trailing year of a series, across years within a unit.

The window is an array of the known values, and each descriptor a higher-order function on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import history

WINDOW, LEAST = 52, 12
TINY = 1e-12
#: A value is above the mean by more than this, so that one equal to it isn't, however sums are rounded.
TIE = 1e-9
NAMES = ("mean", "std", "slope", "ac1", "acf_first_zero", "prop_above_mean", "longest_run_above_mean", "n_local_max", "iqr", "skew", "trend_resid_std", "recent_over_old")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _first(df: DataFrame, name: str, x: str) -> dict[str, Column]:
    frame = history(-(WINDOW - 1))
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(frame)
    enough = F.count(x).over(frame) >= LEAST
    return {f"_w_{name}": F.when(enough, F.collect_list(x).over(frame)), f"_m_{name}": F.when(enough, F.avg(x).over(frame)), f"_s_{name}": F.when(enough, F.stddev_pop(x).over(frame)), f"_q_{name}": F.when(enough, quartiles)}


def _centred(name: str) -> dict[str, Column]:
    w, m = F.col(f"_w_{name}"), F.col(f"_m_{name}")
    middle = (F.size(w) - 1) / 2
    slope = total(F.transform(w, lambda x, i: x * (i - middle))) / (F.size(w) * (F.size(w) * F.size(w) - 1) / 12)
    return {f"_x_{name}": F.transform(w, lambda x: x - m), f"_b_{name}": F.when(w.isNotNull(), slope)}


def _described(name: str) -> dict[str, Column]:
    w, m, s, q, d, b = (F.col(f"_{k}_{name}") for k in "wmsqxb")
    n = F.size(w)
    power = total(F.transform(d, lambda x: x * x)) + TINY
    product = lambda lag: total(F.zip_with(F.slice(d, lag + 1, n - lag), F.slice(d, F.lit(1), n - lag), lambda x, y: x * y))
    zero = F.filter(F.sequence(F.lit(1), n - 1), lambda lag: product(lag) / power <= 0)
    runs = F.aggregate(w, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct(F.when(x - m > TIE, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["most"], F.when(x - m > TIE, a["now"] + 1).otherwise(0)).alias("most")))
    peaks = F.filter(F.sequence(F.lit(2), n - 1), lambda i: (F.element_at(w, i) > F.element_at(w, i - 1)) & (F.element_at(w, i) > F.element_at(w, i + 1)))
    middle = (n - 1) / 2
    residual = F.sqrt(total(F.transform(d, lambda x, i: (x - b * (i - middle)) * (x - b * (i - middle)))) / n)
    half = F.floor(n / 2).cast("int")
    mean_of = lambda part: total(part) / half
    values = {
        "mean": m, "std": s, "slope": b, "ac1": product(F.lit(1)) / power, "acf_first_zero": F.coalesce(F.get(zero, F.lit(0)), F.lit(0)).cast("double"),
        "prop_above_mean": F.size(F.filter(w, lambda x: x - m > TIE)) / n, "longest_run_above_mean": runs["most"].cast("double"), "n_local_max": F.size(peaks).cast("double"), "iqr": q[1] - q[0],
        "skew": total(F.transform(d, lambda x: x * x * x)) / n / (s * s * s + TINY), "trend_resid_std": residual, "recent_over_old": (mean_of(F.slice(w, n - half + 1, half)) + 1) / (mean_of(F.slice(w, F.lit(1), half)) + 1),
    }
    return {f"c22fb_{k}_{name}": F.when(w.isNotNull(), v) for k, v in values.items()}


def add_signatures(panel: DataFrame, series: dict[str, str] | None = None) -> DataFrame:
    """The panel and 12 columns for each series, ``c22fb_<name>_<series>``."""
    series = series or {"case": "c", "rain": "r"}
    out = panel.select("*", *(v.alias(k) for n, x in series.items() for k, v in _first(panel, n, x).items()))
    out = out.select("*", *(v.alias(k) for n in series for k, v in _centred(n).items()))
    return out.select(*panel.columns, *(v.alias(k) for n in series for k, v in _described(n).items()))
