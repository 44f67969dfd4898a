"""Onset triggers on the count series, and rain thresholds that announce them.

Works on labelable rows, unit by unit. Thresholds are fitted for all units, features and leads in one
pass: a running sum over scores and candidate thresholds, no loop over candidates. A fold that leaves
a year out is the whole less that year: its counts are differences, no row is copied for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.windows import history, in_history
from ..session import materialised
from .metrics import auroc

# The trigger's windows and levels, and the candidates of the search.
ETA_ON, ETA_OFF = 1.33, 0.73
SHORT_TERM, GUARD, LONG_TERM = 4, 2, 26
ACCUMULATIONS, RATES, RATIOS = (4, 8, 12), (4, 8), ((3, 12), (4, 26))
LEADS = (4, 6, 8, 10)
LEAST_ROWS, MOST_VALUES, QUANTILES = 20, 120, 100
FEATURES = (*(f"rain_accum{w}w" for w in ACCUMULATIONS), *(f"rain_rate{w}w" for w in RATES), *(f"rain_stalta{s}_{n}" for s, n in RATIOS))


def constant_latch(panel: DataFrame, on: float = ETA_ON, off: float = ETA_OFF) -> DataFrame:
    """Adds ``ta``: on when the short mean reaches ``on`` times the long one, which then is frozen;
    off when it falls below ``off`` times the frozen mean, or the year ends.

    The one operator that needs a state: a fold over each year's sorted weeks.
    """
    first = SHORT_TERM + GUARD + LONG_TERM - 1
    ready = F.row_number().over(in_history()) > first
    means = panel.select(*panel.columns, F.avg("c").over(history(-(SHORT_TERM - 1), 0)).alias("sta"), F.when(ready, F.avg("c").over(history(-first, -(SHORT_TERM + GUARD)))).alias("lta"), ready.alias("ready"))
    years = means.groupBy("unit", "yr").agg(F.array_sort(F.collect_list(F.struct("wn", "sta", "lta", "ready"))).alias("weeks"))
    start = F.struct(F.lit(False).alias("on"), F.lit(None).cast("double").alias("base"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(state: Column, week: Column) -> Column:
        base = F.when(~state["on"] | state["base"].isNull(), week["lta"]).otherwise(state["base"])
        level = F.when(base > 0, week["sta"] / base)
        lit = F.coalesce(F.when(state["on"], ~F.coalesce(level < off, F.lit(False))).otherwise(F.coalesce(level >= on, F.lit(False))) & week["ready"], F.lit(False))
        return F.struct(lit.alias("on"), F.when(lit, base).alias("base"), F.concat(state["out"], F.array(lit.cast("int"))).alias("out"))

    states = years.select("unit", "yr", F.aggregate("weeks", start, step, lambda s: s["out"]).alias("states"), F.transform("weeks", lambda w: w["wn"]).alias("wns"))
    flat = states.select("unit", "yr", F.explode(F.arrays_zip("wns", "states")).alias("x")).select("unit", "yr", F.col("x.wns").alias("wn"), F.col("x.states").alias("ta"))
    return panel.join(flat, ["unit", "yr", "wn"])


def continuous_trigger(panel: DataFrame, on: float = ETA_ON) -> DataFrame:
    """Adds ``ta``: the 3-row mean is more than ``on`` times a positive 12-row mean."""
    short, long = F.avg("c").over(history(-2, 0)), F.avg("c").over(history(-11, 0))
    return panel.select("*", F.coalesce((long > 0) & (ratio(short, long) > on), F.lit(False)).cast("int").alias("ta"))


def rain_features(panel: DataFrame) -> DataFrame:
    """Adds accumulations, their rates of rise, and short over long means, across years; no rain is 0."""
    out = panel.select("*", F.coalesce("r", F.lit(0.0)).alias("_r"))
    total = lambda w: F.sum("_r").over(history(-(w - 1), 0))
    mean = lambda w: F.avg("_r").over(history(-(w - 1), 0))
    out = out.select("*", *(total(w).alias(f"rain_accum{w}w") for w in ACCUMULATIONS), *(ratio(mean(s), mean(n)).alias(f"rain_stalta{s}_{n}") for s, n in RATIOS))
    rates = [(F.col(f"rain_accum{w}w") - F.lag(f"rain_accum{w}w", w).over(in_history())).alias(f"rain_rate{w}w") for w in RATES]
    return out.select("*", *rates).drop("_r")


def onset_targets(triggered: DataFrame, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """Adds ``y<lead>``: the year's first trigger week lies 1 to ``lead`` weeks ahead; null in years without one."""
    year = Window.partitionBy("unit", "yr")
    ahead = F.min(F.when(F.col("ta") == 1, F.col("wn"))).over(year) - F.col("wn")
    return triggered.select("*", *(((ahead >= 1) & (ahead <= lead)).cast("int").alias(f"y{lead}") for lead in leads))


def long_form(df: DataFrame, features: tuple[str, ...] = FEATURES, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """A row for each row, feature and lead: feature, feature_ord, x, lead, y. Unknown x or y go."""
    xs = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("feature_ord"), F.col(f).alias("x")) for i, f in enumerate(features)))
    ys = F.array(*(F.struct(F.lit(lead).alias("lead"), F.col(f"y{lead}").alias("y")) for lead in leads))
    rows = df.select("unit", "yr", "wn", F.inline(xs), ys.alias("_ys")).select("unit", "yr", "wn", "feature", "feature_ord", "x", F.inline("_ys"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def fit_thresholds(rows: DataFrame, by: list[str]) -> DataFrame:
    """The threshold ``x >= t`` of the greatest Youden J in each group, the least t of equals.

    Candidates are the values of x, or 100 quantiles of them where there are over 120. Groups of
    fewer than 20 rows, or of one class, have none. Returns ``threshold, youden_j, sensitivity,
    specificity, n``.
    """
    sums = rows.groupBy(*by, "x").agg(F.sum("y").alias("wp"), F.sum(1 - F.col("y")).alias("wn"))
    shares = F.array(*(F.lit(0.02 + i * (0.96 / (QUANTILES - 1))) for i in range(QUANTILES)))
    held = F.col("wp") + F.col("wn")
    groups = sums.groupBy(*by).agg(F.sum(held).alias("n"), F.sum("wp").alias("pos"), F.count(F.lit(1)).alias("values"), F.percentile("x", shares, held).alias("quantiles"))
    groups = groups.where((F.col("n") >= LEAST_ROWS) & (F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    fit = groups.where(F.col("values") > MOST_VALUES).select(*by, F.explode("quantiles").alias("x")).distinct()
    own = sums.join(groups.where(F.col("values") <= MOST_VALUES).select(*by), by, "left_semi").select(*by, "x")
    candidates = fit.union(own).select(*by, "x", F.lit(0).cast("long").alias("wp"), F.lit(0).cast("long").alias("wn"), F.lit(1).alias("is_candidate"))
    both = sums.select(*by, "x", "wp", "wn", F.lit(0).alias("is_candidate")).unionByName(candidates)
    above = Window.partitionBy(*by).orderBy(F.desc("x"), "is_candidate").rowsBetween(Window.unboundedPreceding, 0)
    judged = both.select("*", F.sum("wp").over(above).alias("tp"), F.sum("wn").over(above).alias("fp")).where("is_candidate = 1").join(groups.select(*by, "n", "pos"), by)
    sens, spec = F.col("tp") / F.col("pos"), 1 - F.col("fp") / (F.col("n") - F.col("pos"))
    judged = judged.select(*by, "n", F.col("x").alias("threshold"), sens.alias("sensitivity"), spec.alias("specificity"), F.round(sens + spec - 1, 12).alias("youden_j"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("youden_j"), "threshold"))
    return judged.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def select_best(fits: DataFrame, by: list[str]) -> DataFrame:
    """The best feature and lead of each group; of equals the first feature, then the first lead."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("youden_j"), "feature_ord", "lead"))
    return fits.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def median_lead(rows: DataFrame, triggered: DataFrame, chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``median_lead``: weeks from the year's first crossing to its first trigger, where positive."""
    by = by or ["unit"]
    onset = triggered.where("ta = 1").groupBy("unit", "yr").agg(F.min("wn").alias("onset"))
    crossed = rows.join(chosen.select(*by, "feature", "threshold"), [*by, "feature"]).where(F.col("x") >= F.col("threshold")).groupBy(*by, "yr").agg(F.min("wn").alias("crossing"))
    leads = crossed.join(onset, ["unit", "yr"]).select(*by, (F.col("onset") - F.col("crossing")).alias("lead")).where("lead > 0")
    return leads.groupBy(*by).agg(F.percentile("lead", 0.5).alias("median_lead"))


def by_feature(df: DataFrame, features: tuple[str, ...] = FEATURES, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """A row for each row and feature: unit, yr, wn, feature, feature_ord, kind, x and all targets. Unknown x or targets go.

    ``kind`` is 0 for accumulations of rain and 1 for what tells of its dynamics.
    """
    xs = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("feature_ord"), F.lit(int("accum" not in f)).alias("kind"), F.col(f).alias("x")) for i, f in enumerate(features)))
    return df.where(f"y{leads[0]} IS NOT NULL").select("unit", "yr", "wn", *(f"y{k}" for k in leads), F.inline(xs)).where("x IS NOT NULL")


def _at(values: np.ndarray, upto: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value at each 0-based place of a sorted list in which ``upto`` values are this or less."""
    return values[np.searchsorted(upto, place, side="right")]


def thresholds_less_years(x: np.ndarray, y: np.ndarray, year: np.ndarray) -> list[tuple]:
    """(year left out or none, n, threshold, sensitivity, specificity, J, percentile of the threshold) for each fold that has a fit.

    Counts by value and year are made once; those of a fold are all less its year's.
    """
    values, at = np.unique(x, return_inverse=True)
    years, which = np.unique(year, return_inverse=True)
    own = np.zeros((2, len(values), len(years) + 1))  # the last one leaves no year out
    np.add.at(own, (y, at, which), 1)
    neg, pos = own.sum(axis=2, keepdims=True) - own
    shares = np.array([0.02 + i * (0.96 / (QUANTILES - 1)) for i in range(QUANTILES)])
    out = []
    for f, (p, m) in enumerate(zip(pos.T, neg.T, strict=True)):
        held, n, n_pos = p + m, int((p + m).sum()), p.sum()
        if n < LEAST_ROWS or not 0 < n_pos < n:
            continue
        marks, upto = values[held > 0], np.cumsum(held)
        if len(marks) > MOST_VALUES:
            place = (n - 1) * shares
            low, high = _at(values, upto, np.floor(place)), _at(values, upto, np.ceil(place))
            marks = np.unique(low + (high - low) * (place - np.floor(place)))
        first = np.searchsorted(values, marks, side="left")
        from_here = lambda c: np.r_[np.cumsum(c[::-1])[::-1], 0.0][first]  # noqa: E731, B023
        sens, spec = from_here(p) / n_pos, 1 - from_here(m) / (n - n_pos)
        j = np.round(sens + spec - 1, 12)
        k = int(np.argmax(j))
        out.append((None if f == len(years) else int(years[f]), n, float(marks[k]), float(sens[k]), float(spec[k]), float(j[k]), 100 * float(held[: first[k]].sum() / n)))
    return out


def fold_fits(rows: DataFrame, by: list[str], leads: tuple[int, ...] = LEADS) -> DataFrame:
    """The best threshold of each feature and lead on all years (``fold`` null) and on all but one.

    A group is a unit's weeks of one feature. Returns *by, feature, feature_ord, lead, fold, n, threshold,
    sensitivity, specificity, youden_j, threshold_pctl.
    """
    keys = [*by, "feature", "feature_ord"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes) + ", lead int, fold long, n long, threshold double, sensitivity double, specificity double, youden_j double, threshold_pctl double"

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        x, year = frame["x"].to_numpy(float), frame["yr"].to_numpy()
        found = [[*(frame[k].iloc[0] for k in keys), lead, *fit] for lead in leads for fit in thresholds_less_years(x, frame[f"y{lead}"].to_numpy(int), year)]
        out = pd.DataFrame(found, columns=[*keys, "lead", "fold", "n", "threshold", "sensitivity", "specificity", "youden_j", "threshold_pctl"])
        return out.astype({"fold": "Int64"})

    return rows.groupBy(*keys).applyInPandas(fitted, schema)


def target_of(lead: str, leads: tuple[int, ...] = LEADS) -> Column:
    return F.coalesce(*(F.when(F.col(lead) == k, F.col(f"y{k}")) for k in leads))


def leave_one_year_out(rows: DataFrame, fits: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(folds, out-of-fold rows): thresholds fitted without a year and judged on it.

    ``rows`` are those of ``by_feature``, ``fits`` their ``fold_fits``. ``folds``: *by, fold, feature,
    feature_ord, lead, threshold, threshold_pctl. ``out of fold``: *by, yr, wn, x, y, hit. ``by`` holds the
    unit, and what else keeps features apart of which each has its own best.
    """
    by = by or ["unit"]
    best = select_best(fits.where("fold IS NOT NULL"), [*by, "fold"])
    chosen = best.select(*by, F.col("fold").alias("yr"), "feature", "lead", "threshold")
    oof = rows.join(chosen, [*by, "yr", "feature"]).select(*by, "yr", "wn", "x", target_of("lead").alias("y"), (F.col("x") >= F.col("threshold")).cast("int").alias("hit"))
    folds = best.join(oof.select(*by, F.col("yr").alias("fold")).distinct(), [*by, "fold"], "left_semi")
    return folds.select(*by, "fold", "feature", "feature_ord", "lead", "threshold", "threshold_pctl"), oof


def fold_summary(folds: DataFrame, oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each unit: mean fold AUROC, pooled rates, modal feature, and how much the threshold varies."""
    by = by or ["unit"]
    areas = auroc(oof.select(*by, "yr", "y", F.col("x").alias("p")), [*by, "yr"], ranges=1).groupBy(*by).agg(F.avg("auroc").alias("auroc_loyo"))
    count = lambda h, y: F.sum(((F.col("hit") == h) & (F.col("y") == y)).cast("int"))
    rates = oof.groupBy(*by).agg(ratio(count(1, 1), count(1, 1) + count(0, 1)).alias("sens_loyo"), ratio(count(0, 0), count(0, 0) + count(1, 0)).alias("spec_loyo"))
    balanced = (F.coalesce("sens_loyo", "spec_loyo") + F.coalesce("spec_loyo", "sens_loyo")) / 2
    votes = folds.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("seen"))
    modal = votes.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))).where("_nth = 1").select(*by, F.col("feature").alias("modal_feature"))
    spread = folds.groupBy(*by).agg(ratio(F.stddev_pop("threshold_pctl"), F.avg("threshold_pctl")).alias("threshold_pctl_cv"))
    return rates.withColumn("balanced_acc_loyo", balanced).join(modal, by).join(spread, by).join(areas, by, "left").select(*by, "auroc_loyo", "balanced_acc_loyo", "sens_loyo", "spec_loyo", "modal_feature", "threshold_pctl_cv")


def prepared(labelled: DataFrame, mode: str = "constant") -> DataFrame:
    """Labelable rows with trigger, rain features and targets."""
    rows = labelled.where("labelable = 1").select("unit", "yr", "wn", "c", "r")
    return rain_features(onset_targets(constant_latch(rows) if mode == "constant" else continuous_trigger(rows)))


def unit_rows(ready: DataFrame) -> DataFrame:
    """The headline: each unit's best accumulation threshold, its checks, and the best dynamics beside it.

    Both kinds of features are groups of the same jobs.
    """
    rows, by = materialised(by_feature(ready), "long"), ["unit", "kind"]
    fits = materialised(fold_fits(rows, by), "fits")
    best = materialised(select_best(fits.where("fold IS NULL"), by).withColumnRenamed("threshold_pctl", "pctl"), "best")
    own = rows.join(best.select(*by, "feature", "lead"), [*by, "feature"]).select(*by, target_of("lead").alias("y"), F.col("x").alias("p"))
    area = auroc(own, by, ranges=1)  # a unit's weeks
    whole = best.join(area, by).join(median_lead(rows, ready, best, by), by, "left").join(fold_summary(*leave_one_year_out(rows, fits, by), by), by, "left")
    whole = materialised(whole, "kinds")

    def part(kind: int, name: str, places: int) -> DataFrame:
        return whole.where(F.col("kind") == kind).select(
            "unit", F.col("feature").alias(f"{name}feature"), F.col("lead").alias(f"{name}lead"), F.round("threshold", places).alias(f"{name}threshold"), F.round("pctl", 1).alias(f"{name}threshold_pctl"),
            F.round("auroc", 3).alias(f"{name}auroc_insample"), F.round("youden_j", 3).alias(f"{name}youden_j"), F.round("sensitivity", 3).alias(f"{name}sensitivity"), F.round("specificity", 3).alias(f"{name}specificity"),
            F.round("auroc_loyo", 3).alias(f"{name}auroc_loyo"), F.round("balanced_acc_loyo", 3).alias(f"{name}balanced_acc_loyo"), F.round("sens_loyo", 3).alias(f"{name}sens_loyo"), F.round("spec_loyo", 3).alias(f"{name}spec_loyo"),
            F.round("median_lead", 1).alias(f"{name}median_lead_weeks"), F.col("modal_feature").alias(f"{name}modal_feature"), F.round("threshold_pctl_cv", 3).alias(f"{name}threshold_pctl_cv"), F.col("n").alias(f"{name}n"),
        )

    return part(0, "", 1).join(part(1, "dyn_", 3), "unit", "left")


def with_median_row(rows: DataFrame, name: str = "(scale median)") -> DataFrame:
    """The rows and one of medians: of numbers the median, of texts the one found most, first by unit of equals."""
    numbers = [c for c, t in rows.dtypes if c != "unit" and t != "string"]
    texts = [c for c, t in rows.dtypes if c != "unit" and t == "string"]
    middle = rows.agg(*(F.round(F.percentile(c, 0.5), 3).alias(c) for c in numbers))
    for c in texts:
        votes = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.min("unit").alias("_u")).orderBy(F.desc("_n"), "_u").limit(1).select(c)
        middle = middle.join(votes, how="left", on=F.lit(True))
    return middle.select(F.lit(name).alias("unit"), *rows.columns[1:]).unionByName(rows.select("unit", *(F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in rows.columns[1:])))
