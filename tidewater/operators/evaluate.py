"""Forward-chaining evaluation: folds, training caps, preparation, the offline learner, summaries.

A fold trains on the years before its own. A capped sample of each year and class, merged over years,
is all that training reads; the rows to be scored are those of the fold's own year, once each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..session import materialised
from . import boosting, metrics

LEAST_YEARS, MOST_TRAIN, MOST_QUANTILES = 2, 1000, 1000


def fold_years(df: DataFrame, by: list[str] | None = None, skip: int = LEAST_YEARS) -> DataFrame:
    """``*by, fold``: the years with at least ``skip`` earlier ones, of labelable rows."""
    by = by or []
    years = df.where("labelable = 1").select(*by, "yr").distinct()
    order = Window.partitionBy(*by).orderBy("yr") if by else Window.partitionBy(F.lit(0)).orderBy("yr")
    return years.select(*by, F.col("yr").alias("fold"), F.row_number().over(order).alias("_n")).where(F.col("_n") > skip).drop("_n")


def folds(df: DataFrame, by: list[str] | None = None, skip: int = LEAST_YEARS) -> DataFrame:
    """Rows of each fold with ``fold`` and ``is_test``; folds whose train rows lack a class are left out.

    A fold whose own year has no positive stays: its rows are scored like all others.
    """
    by = by or []
    rows = df.where("labelable = 1")
    years = F.broadcast(fold_years(df, by, skip))
    joined = rows.join(years, [*[rows[b] == years[b] for b in by], rows["yr"] <= years["fold"]]) if not by else rows.join(years, by).where("yr <= fold")
    joined = joined.withColumn("is_test", (F.col("yr") == F.col("fold")).cast("int"))
    seen = joined.where("is_test = 0").groupBy(*by, "fold").agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    return joined.join(seen.where("hi = 1 AND lo = 0").select(*by, "fold"), [*by, "fold"], "left_semi")


def cap_training(folded: DataFrame, by: list[str], most: int = MOST_TRAIN, seed: int = 0) -> DataFrame:
    """Train rows of a fold cut to ``most``: up to half positives, filled with negatives, leftovers back to positives.

    Which rows stay is decided by a hash, so that it is the same in each run.
    """
    keys = [*by, "fold"]
    size = Window.partitionBy(*keys, "is_test")
    pos = F.sum("y").over(size)
    total = F.count(F.lit(1)).over(size)
    sized = folded.select("*", pos.alias("_pos"), (total - pos).alias("_neg"), F.row_number().over(Window.partitionBy(*keys, "is_test", "y").orderBy(F.xxhash64(F.lit(seed), "unit", "yr", "wn"), "unit", "yr", "wn")).alias("_nth"))
    first = F.least("_pos", F.lit(most // 2))
    negatives = F.least(F.col("_neg"), most - first)
    positives = F.least(F.col("_pos"), most - negatives)
    keep = (F.col("is_test") == 1) | (F.col("_pos") + F.col("_neg") <= most) | F.when(F.col("y") == 1, F.col("_nth") <= positives).otherwise(F.col("_nth") <= negatives)
    return sized.where(keep).drop("_pos", "_neg", "_nth")


def impute_medians(folded: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Unknown values become the fold's train median; a column that no train row knows becomes null everywhere."""
    keys = [*by, "fold"]
    medians = folded.where("is_test = 0").groupBy(*keys).agg(*(F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns))
    joined = folded.join(medians, keys)
    return joined.select(*(F.when(F.col(f"_m_{c}").isNotNull(), F.coalesce(c, f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in folded.columns))


def probit(p: Column) -> Column:
    """The normal quantile, by a rational approximation with a relative error of 1.2e-9."""
    # A published approximation of the inverse normal distribution, for the middle and the tails.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661996416, 1.0)

    def poly(values: tuple[float, ...], x: Column) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + v
        return out

    low = F.least(p, 1 - p)
    q = p - 0.5
    t = F.sqrt(-2 * F.log(low))
    tail = poly(c, t) / poly(d, t)
    return F.when(low >= 0.02425, q * poly(a, q * q) / poly(b, q * q)).when(q < 0, tail).otherwise(-tail)


def rank_gaussian(folded: DataFrame, column: str, by: list[str], quantiles: int = MOST_QUANTILES) -> DataFrame:
    """Adds ``<column>_g``: the value's place among the fold's train values, as a normal quantile.

    Up to ``quantiles`` train values are marks themselves; of more, their quantiles are. A value between two
    marks lies between their places, and marks of one value share the middle of theirs. The least and the
    greatest mark and all beyond are at the ends.
    """
    keys, eps = [*by, "fold"], 1e-7
    train = folded.where(f"is_test = 0 AND {column} IS NOT NULL")
    size = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.percentile(column, F.array(*(F.lit(i / (quantiles - 1)) for i in range(quantiles)))).alias("_cuts"))
    few, many = size.where(F.col("_size") <= quantiles).select(*keys), size.where(F.col("_size") > quantiles)
    values = train.join(few, keys, "left_semi").select(*keys, F.col(column).cast("double").alias("_v")).unionByName(many.select(*keys, F.explode("_cuts").alias("_v")))
    known = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy(*keys).orderBy("_v")
    whole = Window.partitionBy(*keys)
    upto, total = F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_k").over(whole)
    ranks = known.select(*keys, "_v", ratio(upto - F.col("_k"), total - 1).alias("_lo"), ratio(upto - 1, total - 1).alias("_hi"), F.min("_v").over(whole).alias("_least"), F.max("_v").over(whole).alias("_most"))
    marks = ranks.select("*", F.lead("_v").over(order).alias("_v2"), F.lead("_lo").over(order).alias("_lo2"))
    asked = folded.select(*keys, F.col(column).cast("double").alias("_x")).distinct()
    # marks and values in one order: the last mark before a value is the one below it
    mark = F.struct("_v", "_lo", "_hi", "_v2", "_lo2", "_least", "_most")
    merged = marks.select(*keys, F.col("_v").alias("_x"), mark.alias("_mark"), F.lit(0).alias("_kind"))
    merged = merged.unionByName(asked.where("_x IS NOT NULL").select(*keys, "_x", F.lit(None).cast(merged.schema["_mark"].dataType).alias("_mark"), F.lit(1).alias("_kind")))
    below = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    hit = merged.withColumn("_mark", below).where("_kind = 1 AND _mark IS NOT NULL").select(*keys, "_x", "_mark.*")
    between = F.col("_hi") + (F.col("_lo2") - F.col("_hi")) * (F.col("_x") - F.col("_v")) / (F.col("_v2") - F.col("_v"))
    at = F.when(F.col("_x") >= F.col("_most"), 1.0).when(F.col("_x") <= F.col("_least"), 0.0).when(F.col("_x") == F.col("_v"), (F.col("_lo") + F.col("_hi")) / 2).otherwise(between)
    place = hit.select(*keys, "_x", at.alias("_at"))
    joined = folded.withColumn("_x", F.col(column)).join(place, [*keys, "_x"], "left")
    at = F.when(F.col("_x").isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce("_at", F.lit(0.0)))))
    return joined.select(*folded.columns, probit(at).alias(f"{column}_g"))


def quotas(df: DataFrame, by: list[str], most: int = MOST_TRAIN) -> DataFrame:
    """``*by, fold, positives, negatives``: how many train rows of each class a fold keeps; folds that lack a class are left out."""
    per_year = df.where("labelable = 1").groupBy(*by, "yr").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"))
    years = fold_years(df, by)
    match = [F.col(f"_b_{b}").eqNullSafe(F.col(b)) for b in by]
    earlier = years.withColumnsRenamed({b: f"_b_{b}" for b in by}).join(per_year, [*match, F.col("yr") < F.col("fold")]) if by else F.broadcast(years).join(per_year, F.col("yr") < F.col("fold"))
    sums = earlier.groupBy(*by, "fold").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")).where("_pos > 0 AND _neg > 0")
    first = F.least("_pos", F.lit(most // 2))
    negatives = F.least(F.col("_neg"), most - first)
    return sums.select(*by, "fold", F.least(F.col("_pos"), most - negatives).alias("positives"), negatives.alias("negatives"))


def train_samples(df: DataFrame, by: list[str], seeds: tuple[int, ...] = (0,), most: int = MOST_TRAIN) -> DataFrame:
    """The capped train rows of each seed and fold, those that ``cap_training`` keeps.

    The ``most`` rows of the least hash in each year and class are a sample that merges over years: a
    fold takes the least of its earlier years' samples. So the panel is read once and only samples,
    of a bounded size a year, are copied to the later folds.
    """
    columns = df.columns
    seeded = df.where("labelable = 1").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    order = [F.xxhash64("seed", "unit", "yr", "wn"), F.col("unit"), F.col("yr"), F.col("wn")]
    sample = seeded.withColumn("_nth", F.row_number().over(Window.partitionBy("seed", *by, "yr", "y").orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")
    wanted = quotas(df, by, most)
    later = sample.join(wanted, by).where("yr < fold") if by else sample.join(F.broadcast(wanted), F.col("yr") < F.col("fold"))
    nth = F.row_number().over(Window.partitionBy("seed", *by, "fold", "y").orderBy(*order))
    return later.withColumn("_nth", nth).where(F.col("_nth") <= F.when(F.col("y") == 1, F.col("positives")).otherwise(F.col("negatives"))).select("seed", "fold", *columns)


def fit_predict_sets(df: DataFrame, sets: dict[str, list[str]], by: list[str], seeds: tuple[int, ...] = (0,), calibrate: bool = True, settings: boosting.Settings = boosting.Settings(), most: int = MOST_TRAIN) -> DataFrame:
    """``rep, seed, *by, unit, yr, wn, fold, y, p``: out-of-fold scores of each set of columns, each seed and, with ``by``, each unit.

    Values are filled with the train median and go to boosted trees, which any rising transform of
    them leaves as they are, normal quantiles too. With ``calibrate`` scores go through rising steps
    fitted to the train rows' own scores. All sets, folds and seeds are groups of one job; sets of the
    same columns are fitted once. A fold whose train rows lack a class has no scores.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for name, columns in sets.items():
        alike.setdefault(tuple(dict.fromkeys(columns)), []).append(name)
    cells = F.array(*(F.struct(F.lit(i).alias("_set"), boosting.vector(list(columns)).alias("x")) for i, columns in enumerate(alike)))
    ids, keys = list(dict.fromkeys([*by, "unit", "yr", "wn"])), ["_set", "seed", *by, "fold"]
    train = train_samples(df, by, seeds, most).select("seed", "fold", *ids, "y", F.inline(cells))
    models = materialised(boosting.fit_groups(train, keys, ["unit", "yr", "wn"], settings, steps), "models")
    rows = df.where("labelable = 1").select(F.explode(F.array(*map(F.lit, seeds))).alias("seed"), F.col("yr").alias("fold"), *ids, "y", *dict.fromkeys(c for columns in alike for c in columns))
    rows = rows.select("seed", "fold", *ids, "y", F.inline(cells))
    named = F.array(*(F.array(*map(F.lit, names)) for names in alike.values()))
    scored = boosting.score_rows(rows, models, keys, calibrate)
    return scored.select(F.explode(F.get(named, F.col("_set"))).alias("rep"), "seed", *ids, "fold", F.col("y").cast("int").alias("y"), "p")


def steps(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct scores and the rising levels fitted to them."""
    points, at = np.unique(p, return_inverse=True)
    return points, pooled(np.bincount(at, y), np.bincount(at))


def pooled(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rising levels nearest to the means of neighbouring groups: pools of adjacent violators."""
    blocks: list[tuple[float, int, int]] = []
    for total, size in zip(sums.tolist(), sizes.tolist(), strict=True):
        blocks.append((total, size, 1))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            one, two = blocks.pop(), blocks.pop()
            blocks.append((one[0] + two[0], one[1] + two[1], one[2] + two[2]))
    return np.repeat([t / n for t, n, _ in blocks], [k for _, _, k in blocks])


def recalibrated(scores: DataFrame, by: list[str]) -> DataFrame:
    """Scores through a monotone step function fitted to (y, p): pools of adjacent violators.

    Spark sums up the distinct scores of a group; only these, to six places, are pooled in a task:
    a million of them at most, whatever the number of rows.
    """
    keys = ", ".join(f"`{c}` {t}" for c, t in scores.select(*by).dtypes)

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return frame[[*by, "place"]].assign(level=pooled(frame["y"].to_numpy(), frame["n"].to_numpy()))

    place = F.round(F.col("p"), 6)
    sums = scores.groupBy(*by, place.alias("place")).agg(F.sum("y").cast("double").alias("y"), F.count(F.lit(1)).alias("n"))
    levels = sums.groupBy(*by).applyInPandas(pool, f"{keys}, place double, level double")
    return scores.withColumn("place", place).join(levels, [*by, "place"]).select(*(F.col("level").alias("p") if c == "p" else F.col(c) for c in scores.columns))


def summarise(oof: DataFrame, by: list[str]) -> DataFrame:
    """``n_test, base_rate, auroc, auprc, brier`` of each group."""
    out = oof.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.avg("y").alias("base_rate"))
    for name in ("auroc", "auprc", "brier"):
        out = out.join(getattr(metrics, name)(oof, by), by)
    return out
