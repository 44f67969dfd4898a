"""Intervals, calibration blocks and adjusted comparisons over bootstrap replicates.

``resampling`` makes the replicates. A table of multiplicities of one's own serves as well: a weight
for each cluster, shared by all representations, which keeps comparisons paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import metrics, resampling

REPLICATES, LOW, HIGH = resampling.REPLICATES, 0.025, 0.975


def replicate_metrics(oof: DataFrame, mult: DataFrame, by: list[str], names: tuple[str, ...] = ("auroc", "auprc", "brier")) -> DataFrame:
    """``b, *by`` and a column for each metric, of (cluster, y, p) weighted by multiplicity."""
    rows = oof.join(mult, "cluster").where("mult > 0")
    out = None
    for name in names:
        # thousands of groups, a replicate each, keep all tasks busy as they are
        ordered = {} if name == "brier" else {"ranges": 1}
        one = getattr(metrics, name)(rows, ["b", *by], "mult", **ordered)
        out = one if out is None else out.join(one, ["b", *by])
    return out


def interval(value: str) -> list[Column]:
    return [F.percentile(value, LOW).alias("ci_lo"), F.percentile(value, HIGH).alias("ci_hi")]


def bootstrap_ci(replicates: DataFrame, by: list[str], name: str) -> DataFrame:
    """Percentile interval of a metric over replicates where it is known."""
    return replicates.where(F.col(name).isNotNull()).groupBy(*by).agg(*interval(name))


def paired_contrasts(points: DataFrame, replicates: DataFrame, rep: str, name: str, by: list[str] | None = None) -> DataFrame:
    """``*by, a, b_rep, delta, ci_lo, ci_hi, p_value`` of each pair of representations (a before b)."""
    by = by or []

    def pairs(df: DataFrame, keys: list[str]) -> DataFrame:
        one = df.select(*keys, F.col(rep).alias("a"), F.col(name).alias("va"), F.lit(1).alias("_k"))
        other = df.select(*keys, F.col(rep).alias("b_rep"), F.col(name).alias("vb"), F.lit(1).alias("_k"))
        return one.join(other, [*keys, "_k"]).where("a < b_rep").select(*keys, "a", "b_rep", (F.col("va") - F.col("vb")).alias("d"))

    point = pairs(points, by).withColumnRenamed("d", "delta")
    share = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("d") > 0), share(F.col("d") < 0)) + 1 / (F.count(F.lit(1)) + 1))
    spread = pairs(replicates, [*by, "b"]).where("d IS NOT NULL").groupBy(*by, "a", "b_rep").agg(*interval("d"), p.alias("p_value"))
    return point.join(spread, [*by, "a", "b_rep"], "left")


def contrasts(oof: DataFrame, rep: str = "rep", names: tuple[str, ...] = resampling.METRICS, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``metric, a, b_rep, delta, ci_lo, ci_hi, p_value``: all pairs of representations by each metric, over draws that all share."""
    drawn = resampling.replicate_metrics(resampling.chunks(oof, [rep]), [rep], replicates, seed)
    tall = lambda df, keys: df.select(*keys, rep, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))))
    points = oof.select(rep).distinct()
    for m in names:
        points = points.join(getattr(metrics, m)(oof, [rep]), rep)
    return paired_contrasts(tall(points, []), tall(drawn, ["b"]), rep, "value", ["metric"])


def beats_chance(oof: DataFrame, by: list[str], mult: DataFrame | None = None, within: list[str] | None = None, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """AUROC of each group, its interval over clusters, and whether that lies above one half.

    Replicates are those of ``mult``, or drawn: over all clusters, or those of each group of ``within``.
    """
    drawn = replicate_metrics(oof, mult, by, ("auroc",)) if mult is not None else resampling.replicate_metrics(resampling.chunks(oof, by, within), by, replicates, seed)
    out = metrics.auroc(oof, by).join(bootstrap_ci(drawn, by, "auroc"), by, "left")
    return out.withColumn("beats_chance", F.coalesce(F.col("ci_lo") > 0.5, F.lit(False)))


def cox(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """``*by, cox_intercept, cox_slope``: the unpenalised logistic regression of y on logit p, null for a single class.

    A Newton step of all groups is one aggregation over the distinct scores.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = materialised(df.groupBy(*by, "p", "y").agg(F.sum(w).alias("_w")).select(*by, metrics.logit(F.col("p")).alias("_x"), F.col("y").cast("double").alias("_y"), "_w"), "logits")
    both = rows.groupBy(*by).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).where("_lo < _hi").select(*by)

    def sums_of(moving: DataFrame) -> DataFrame:
        joined = rows.join(moving, by) if by else rows.crossJoin(F.broadcast(moving))
        fit = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_a") + F.col("_s") * F.col("_x")))))
        curve, slack, x = F.col("_w") * fit * (1 - fit), F.col("_w") * (F.col("_y") - fit), F.col("_x")
        return joined.select(*by, curve.alias("_h"), (curve * x).alias("_hx"), (curve * x * x).alias("_hxx"), slack.alias("_g"), (slack * x).alias("_gx"))

    found = resampling.newton(both, by, sums_of).withColumnsRenamed({"_a": "cox_intercept", "_s": "cox_slope"})
    return rows.select(*by).distinct().join(found, by, "left")


def calibration(oof: DataFrame, by: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Cox slope and intercept, Brier score and ECE with intervals, and Spiegelhalter's test."""
    point = cox(oof, by).join(metrics.brier(oof, by), by).join(metrics.ece(oof, by), by).join(metrics.spiegelhalter(oof, by), by)
    drawn = resampling.replicate_calibration(resampling.chunks(oof, by), by, replicates, seed)
    names = ("cox_intercept", "cox_slope", "brier", "ece")
    ends = drawn.groupBy(*by).agg(*(F.percentile(n, q).alias(f"{n}_{side}") for n in names for side, q in (("lo", LOW), ("hi", HIGH))))
    return point.join(ends, by, "left")


def confirmatory(contrasts: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``family`` and ``p_adjusted``: the one planned contrast as it is, the others adjusted."""
    planned = (F.col("a") == min(a, b)) & (F.col("b_rep") == max(a, b))
    marked = contrasts.withColumn("family", F.when(planned, "confirmatory").otherwise("exploratory"))
    return metrics.benjamini_hochberg(marked.withColumn("_tie", F.concat_ws("|", "a", "b_rep")), ["family"], tie="_tie").drop("_tie")


def stability(lifts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    return lifts.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_seeds"))


def lifts(oof: DataFrame, base: str, rep: str) -> DataFrame:
    """``seed, measure, value``: AUROC of ``base`` and ``rep``, and what the one is above the other, for each seed."""
    areas = metrics.auroc(oof, ["seed", "rep"])
    wide = areas.groupBy("seed").agg(*(F.max(F.when(F.col("rep") == r, F.col("auroc"))).alias(n) for r, n in ((base, "lo"), (rep, "hi"))))
    return wide.select("seed", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in ((base, F.col("lo")), (rep, F.col("hi")), ("lift", F.col("hi") - F.col("lo")))))))


def unit_intervals(oof: DataFrame, by: list[str], least_rows: int = 5, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``*by, ci_lo, ci_hi, beats_chance, n_clusters`` of units of at least ``least_rows`` rows and both classes, over draws of the unit's own clusters."""
    sizes = oof.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("y").alias("_lo"), F.max("y").alias("_hi"), F.count_distinct("cluster").alias("n_clusters"))
    fit = sizes.where((F.col("_n") >= least_rows) & (F.col("_lo") < F.col("_hi")))
    judged = beats_chance(oof.join(fit.select(*by), by, "left_semi"), by, within=by, replicates=replicates, seed=seed).drop("auroc")
    return sizes.select(*by).join(judged.join(fit.select(*by, "n_clusters"), by), by, "left").withColumn("beats_chance", F.coalesce("beats_chance", F.lit(False)))
