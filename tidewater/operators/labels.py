"""Peak-anchored labels of a unit's year. They look ahead by design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import in_season, whole_year

LEAST_WEEKS, HORIZON = 10, 8


def positions(panel: DataFrame) -> DataFrame:
    """Adds ``_pos`` (0-based row of the year), ``_fit`` and ``_peak`` (the first maximum)."""
    year = whole_year()
    out = panel.select("*", (F.row_number().over(in_season()) - 1).alias("_pos"), F.max("c").over(year).alias("_top"), F.count(F.lit(1)).over(year).alias("_weeks"))
    fit = F.coalesce((F.col("_weeks") >= LEAST_WEEKS) & (F.col("_top") > 0), F.lit(False))
    return out.select("*", fit.alias("_fit"), F.min(F.when(F.col("c") == F.col("_top"), F.col("_pos"))).over(year).alias("_peak"))


def onsets(placed: DataFrame) -> DataFrame:
    """Adds ``_onset``: the first minimum up to the peak."""
    year, rising = whole_year(), F.col("_pos") <= F.col("_peak")
    out = placed.select("*", F.min(F.when(rising, F.col("c"))).over(year).alias("_low"))
    return out.select("*", F.min(F.when(rising & (F.col("c") == F.col("_low")), F.col("_pos"))).over(year).alias("_onset"))


def _label(placed: DataFrame, y: Column, labelable: Column, drop: list[str]) -> DataFrame:
    flag = lambda c: F.coalesce(F.col("_fit") & c, F.lit(False)).cast("int")
    return placed.select("*", flag(y).alias("y"), flag(labelable).alias("labelable")).drop(*drop)


def label(panel: DataFrame, mode: str = "limb", horizon: int = HORIZON) -> DataFrame:
    """Adds ``y`` and ``labelable``.

    ``limb``: positive from the onset to before the peak, all weeks labelable. ``prepeak``: positive
    up to ``horizon`` weeks before the peak, weeks before the peak labelable. Years of fewer than 10
    rows, or without a positive count, are neither.
    """
    placed = positions(panel)
    pos, peak = F.col("_pos"), F.col("_peak")
    drop = ["_pos", "_top", "_weeks", "_fit", "_peak", "_low", "_onset"]
    if mode == "limb":
        placed = onsets(placed)
        return _label(placed, (pos >= F.col("_onset")) & (pos < peak), F.lit(True), drop)
    if mode == "prepeak":
        return _label(placed, (peak - pos > 0) & (peak - pos <= horizon), pos < peak, drop)
    raise ValueError(f"no such label mode: {mode}")
