"""Rank and calibration metrics as relational operators, weighted and by group.

All take a table with a label ``y`` (0 or 1), a score ``p`` and, if given, a weight ``w``, and return
a row for each group. Ties in the score are grouped, so a metric is a sort and a running sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

BINS = 10
#: Into how many ranges of its values a group is cut where its rows are put in order.
RANGES = 64
EPS = 1e-6


def by_score(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """One row for each distinct score: ``wp`` and ``wn``, the weight of positives and negatives."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col("p").isNotNull() & F.col("y").isNotNull())
    return known.groupBy(*by, "p").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("wn"))


def _partition(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` where null equals null; the left side's keys stay."""
    mine = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(mine[f"_r_{k}"])
    return left.join(mine, same, how).drop(*(f"_r_{k}" for k in keys))


def running(df: DataFrame, by: list[str], value: str, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``below_<c>``, the sum of ``c`` over lesser values of the group, and ``all_<c>``; a value is one row.

    A group is cut into ranges of ``value`` at rough quantiles, each range is summed and ordered for
    itself, and the sums of the ranges before are added. So no task orders a whole group; where the
    cuts lie doesn't change the result. ``ranges=1`` is for many groups that are small by nature.
    """
    if ranges < 2:
        group = _partition(by)
        so_far = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"below_{c}") for c in columns), *(F.sum(c).over(group).alias(f"all_{c}") for c in columns))
    cuts = [i / ranges for i in range(1, ranges)]
    marks = df.groupBy(*by).agg(F.percentile_approx(value, cuts).alias("_marks"))
    placed = _joined(df, marks, by).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col(value)))).drop("_marks")
    sums = placed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    group = _partition(by)  # of at most ``ranges`` rows
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_range", *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns), *(F.sum(f"_s_{c}").over(group).alias(f"all_{c}") for c in columns))
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in columns))
    out = _joined(own, before, [*by, "_range"])
    return out.select(*df.columns, *((F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"below_{c}") for c in columns), *(f"all_{c}" for c in columns))


def auroc(df: DataFrame, by: list[str], weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``auroc``: the share of pairs in order, ties counting half; null if a class is missing."""
    ranked = running(by_score(df, by, weight), by, "p", ["wn"], ranges)
    return ranked.groupBy(*by).agg(ratio(F.sum(F.col("wp") * (F.col("below_wn") + F.col("wn") / 2)), F.sum("wp") * F.sum("wn")).alias("auroc"))


def auprc(df: DataFrame, by: list[str], weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``auprc``: average precision by steps of the distinct scores; null if a class is missing."""
    ranked = running(by_score(df, by, weight), by, "p", ["wp", "wn"], ranges)
    tp, fp = (F.col(f"all_{c}") - F.col(f"below_{c}") for c in ("wp", "wn"))
    out = ranked.groupBy(*by).agg(F.sum(F.when(F.col("wp") > 0, F.col("wp") * ratio(tp, tp + fp))).alias("s"), F.sum("wp").alias("pos"), F.sum("wn").alias("neg"))
    return out.select(*by, F.when(F.col("neg") > 0, ratio(F.col("s"), F.col("pos"))).alias("auprc"))


def brier(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    error = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return df.groupBy(*by).agg(ratio(F.sum(w * error), F.sum(w)).alias("brier"))


def edges(spark, bins: int = BINS) -> DataFrame:
    """Half-open bins of equal width: (bin, lo, hi)."""
    step = 1.0 / bins
    marks = [i * step for i in range(bins)] + [1.0]
    return spark.createDataFrame([(i, marks[i], marks[i + 1]) for i in range(bins)], "bin int, lo double, hi double")


def ece(df: DataFrame, by: list[str], weight: str | None = None, bins: int = BINS) -> DataFrame:
    """``ece``: bins are half-open, so that a score of 1 lies in none but counts in the total."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, "y", "p", w.alias("_w"))
    binned = rows.join(F.broadcast(edges(df.sparkSession, bins)), (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")), "left")
    sums = binned.groupBy(*by, "bin").agg(F.sum("_w").alias("n"), ratio(F.sum(F.col("_w") * F.col("y")), F.sum("_w")).alias("rate"), ratio(F.sum(F.col("_w") * F.col("p")), F.sum("_w")).alias("mean"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("rate") - F.col("mean"))).otherwise(0.0)
    return sums.groupBy(*by).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def logit(p: Column, eps: float = EPS) -> Column:
    q = F.when(p < eps, eps).when(p > 1 - eps, 1 - eps).otherwise(p)
    return F.log(q / (1 - q))


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal deviate, by the error function's rational approximation, good to 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # A published Chebyshev fit of the complementary error function.
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(k) + t * poly
    return t * F.exp(poly - x * x)


def chi_squared_p(x: Column, df: Column) -> Column:
    """The upper tail of chi squared with ``df`` degrees of freedom, by its finite sums.

    Each term is the one before times x / 2 over the next integer, or half-integer where ``df`` is odd.
    """
    half, odd = x / 2, (df % 2).cast("double")
    first = F.when(odd == 1, F.sqrt(half) * (2 / math.sqrt(math.pi))).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] * half / (k + odd / 2)).alias("term"), (s["total"] + s["term"]).alias("total"))
    terms = F.floor(df / 2).cast("int")
    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda s: s["total"])).otherwise(0.0)
    return F.exp(-half) * total + F.when(odd == 1, normal_p(F.sqrt(x))).otherwise(0.0)


def spiegelhalter(df: DataFrame, by: list[str]) -> DataFrame:
    """``z`` and two-sided ``p_value``; null where the denominator is 0."""
    p, y = F.col("p"), F.col("y")
    out = df.groupBy(*by).agg(F.sum((y - p) * (1 - 2 * p)).alias("num"), F.sqrt(F.sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))).alias("den"))
    out = out.select(*by, ratio(F.col("num"), F.col("den")).alias("z"))
    return out.select(*by, "z", normal_p(F.col("z")).alias("p_value"))


def with_midrank(df: DataFrame, by: list[str], value: str, name: str = "midrank", ties: str = "_ties") -> DataFrame:
    """Adds ``name``, the 1-based rank, equal values sharing the mean of their ranks, and ``ties``, how many are equal."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(ties))
    ranks = running(counts, by, value, [ties]).select(*by, value, ties, (F.col(f"below_{ties}") + (F.col(ties) + 1) / 2).alias(name))
    return _joined(df, ranks, [*by, value])


def delong(df: DataFrame, by: list[str], a: str = "p1", b: str = "p2") -> DataFrame:
    """Paired test of two scores' AUROC: ``auc1, auc2, z, p_value``.

    A row's placement is the share of the other class that it is beyond, ties counting half: what the
    difference of its midranks among all and among its own class comes to.
    """
    rows = df.select(*by, "y", F.col(a).alias("_p1"), F.col(b).alias("_p2"))
    for k in "12":
        sums = running(by_score(rows.select(*by, "y", F.col(f"_p{k}").alias("p")), by), by, "p", ["wp", "wn"])
        lesser = lambda c: ratio(F.col(f"below_{c}") + F.col(c) / 2, F.col(f"all_{c}"))
        places = sums.select(*by, F.col("p").alias(f"_p{k}"), lesser("wn").alias("_pos"), (1 - lesser("wp")).alias("_neg"), *((F.col("all_wp").alias("m"), F.col("all_wn").alias("n")) if k == "1" else ()))
        rows = _joined(rows, places, [*by, f"_p{k}"]).withColumn(f"v{k}", F.when(F.col("y") == 1, F.col("_pos")).otherwise(F.col("_neg"))).drop("_pos", "_neg")
    d = F.col("v1") - F.col("v2")
    part = lambda k: F.var_samp(F.when(F.col("y") == k, d))
    mean = lambda k: F.avg(F.when(F.col("y") == 1, F.col(f"v{k}")))
    out = rows.groupBy(*by).agg(mean("1").alias("auc1"), mean("2").alias("auc2"), (ratio(part(1), F.max("m")) + ratio(part(0), F.max("n"))).alias("var"))
    out = out.withColumn("z", F.when(F.col("var") > 0, (F.col("auc1") - F.col("auc2")) / F.sqrt("var")))
    return out.select(*by, "auc1", "auc2", "z", normal_p(F.col("z")).alias("p_value"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p_value", tie: str | None = None) -> DataFrame:
    """Adds ``p_adjusted``, the step-up false discovery rate within each group."""
    order = [F.col(p).asc(), *([F.col(tie).asc()] if tie else [])]
    w = _partition(by)
    ranked = df.select("*", F.row_number().over(w.orderBy(*order)).alias("_rank"), F.count(F.lit(1)).over(w).alias("_n"))
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    least = F.min(raw).over(w.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return ranked.select(*df.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)).alias("p_adjusted"))


def kruskal(df: DataFrame, by: list[str], value: str, group: str, least: int = 2) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups of at least ``least`` values: ``h, n_groups, p_value``."""
    known = df.where(F.col(value).isNotNull()).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*by, group))).where(F.col("_size") >= least)
    ranked = with_midrank(known.select(*by, group, F.col(value).alias("_v")), by, "_v", "_rank")
    sums = ranked.groupBy(*by, group).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("_rank").alias("s"), F.sum(F.col("_ties") * F.col("_ties") - 1).alias("t"))
    out = sums.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("n_groups"))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    correction = 1 - F.col("t") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    out = out.select(*by, F.when(F.col("n_groups") >= 2, ratio(h, correction)).alias("h"), "n_groups")
    return out.withColumn("p_value", chi_squared_p(F.col("h"), F.col("n_groups") - 1))


def group_means(df: DataFrame, by: list[str], value: str, group: str, least: int = 2) -> DataFrame:
    """``mean, n`` of each group that ``kruskal`` compares."""
    return df.groupBy(*by, group).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= least)
