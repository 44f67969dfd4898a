"""The frames behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .catalogue import family_of
from .metrics import auroc


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def dips(rungs: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds ``dip``: whether a rung lies below the one before."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
    return rungs.withColumn("dip", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))


def attribution(df: DataFrame, columns: list[str], most: int = 14) -> DataFrame:
    """The ``most`` features whose AUROC of y alone lies farthest from one half; of equals, by name."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("p")) for c in columns))
    areas = auroc(df.select("y", F.inline(cells)), ["feature"])
    scored = areas.where("auroc IS NOT NULL").select("feature", F.round(F.abs(F.col("auroc") - 0.5), 9).alias("importance"), family_of(F.col("feature")).alias("family"))
    return scored.orderBy(F.desc("importance"), "feature").limit(most)


def by_climate(units: DataFrame, climates: DataFrame) -> DataFrame:
    """Unit AUROC with climate type and the type's mean, sorted by type, then falling AUROC."""
    joined = units.join(F.broadcast(climates), "unit", "left").withColumn("climate_type", F.coalesce("climate_type", F.lit("NA")))
    return joined.withColumn("type_mean", F.avg("auroc").over(Window.partitionBy("climate_type"))).orderBy("climate_type", F.desc("auroc"), "unit")


def reliability(df: DataFrame, by: list[str]) -> DataFrame:
    """``bin, n, mean_score, rate`` in bins between score quantiles: 3 to 10 of them, by the distinct scores."""
    groups = df.groupBy(*by).agg(F.count_distinct("p").alias("k"))
    count = F.least(F.lit(10), F.greatest(F.lit(3), F.col("k"))).cast("int")
    marks = [i / n for n in range(3, 11) for i in range(1, n)]
    points = df.groupBy(*by).agg(F.percentile("p", F.array(*map(F.lit, marks))).alias("points")).join(groups, by).withColumn("bins", count)
    inner = F.expr("slice(points, cast((bins - 3) * bins / 2 AS int) + 1, bins - 1)")
    binned = df.join(points.select(*by, inner.alias("inner")), by).withColumn("bin", F.size(F.filter("inner", lambda e: e < F.col("p"))))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("rate"))


def separation(df: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Score histogram by class over [0, 1], as density."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    counted = df.groupBy(*by, "y", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "y"))
    return counted.withColumn("density", ratio(F.col("n") * F.lit(float(bins)), total))
