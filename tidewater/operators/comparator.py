"""A trend forecast as comparator: the rise a straight line through the last weeks promises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import in_season, season

TREND_WEEKS, HORIZON, LEAST_HISTORY = 8, 8, 12


def trend_scores(labelled: DataFrame) -> DataFrame:
    """Adds ``slope`` and ``score``: the largest forecast less the last value.

    Null where the year's history is shorter than 12 rows, the row isn't labelable, or a week of the
    trend has no count.
    """
    frame = season(-(TREND_WEEKS - 1), 0)
    out = labelled.select("*", F.row_number().over(in_season()).alias("_n"))
    gap = F.count("c").over(frame) < F.count(F.lit(1)).over(frame)
    out = out.select("*", F.when(~gap & (F.col("_n") > 1), F.regr_slope(F.col("c"), F.col("_n").cast("double")).over(frame)).alias("slope"))
    rise = F.when(F.col("slope") > 0, F.col("slope") * HORIZON).otherwise(F.col("slope"))
    return out.select(*labelled.columns, "slope", F.when((F.col("_n") >= LEAST_HISTORY) & (F.col("labelable") == 1), rise).alias("score"))


def with_cluster(df: DataFrame) -> DataFrame:
    """Adds ``cluster``, the unit-year as text."""
    return df.withColumn("cluster", F.concat_ws("-", "unit", F.col("yr").cast("string")))
