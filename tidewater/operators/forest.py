"""Permutation importance: what bagged trees lose when one column of unseen years is shuffled.

Years are dealt to at most four folds of about equal size. Trees of a fold grow on the other folds'
rows, in blocks: a block draws its bags from a sample of at most ``SAMPLE`` rows, those of the least
hash, and is a task of its own. A fold's rows are then scored as they are and with each column
shuffled, ``REPEATS`` times: in groups of about ``GROUP`` rows dealt by a hash, within which values
change places, and in slices of the columns. The areas are taken over whole folds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .boosting import cut_points, matrix, vector
from .catalogue import family_of
from .metrics import auroc
from .reporting import attribution

TREES, BLOCK, SAMPLE, BINS = 100, 25, 5000, 63
FOLDS, REPEATS, GROUP, SLICES = 4, 4, 4096, 4
_TREES = "feature array<int>, threshold array<double>, below array<int>, above array<int>, value array<double>, roots array<int>"


def deal_years(sizes: dict[int, int], folds: int = FOLDS) -> dict[int, int]:
    """Year -> fold: the largest years first, each to the fold of the fewest rows."""
    loads = [0] * max(2, min(folds, len(sizes)))
    out = {}
    for year, n in sorted(sizes.items(), key=lambda item: (-item[1], -item[0])):
        out[year] = loads.index(min(loads))
        loads[out[year]] += n
    return out


def grow(codes: np.ndarray, y: np.ndarray, columns: int, bins: int, rng: np.random.Generator) -> list[list]:
    """Nodes [column, cut, below, above, share of class 1] of a tree without a limit; each split tries ``columns`` columns drawn anew."""
    nodes, waiting = [[-1, 0, -1, -1, float(y.mean())]], [(0, np.arange(len(y)))]
    while waiting:
        at, rows = waiting.pop()
        ones = y[rows].sum()
        if not 0 < ones < len(rows):
            continue
        best = (1e-12, 0, 0)
        for tried, k in enumerate(rng.permutation(codes.shape[1])):  # constant columns don't count
            if tried >= columns and best[0] > 1e-12:
                break
            n = np.bincount(codes[rows, k], minlength=bins).cumsum()[:-1]
            p = np.bincount(codes[rows, k], y[rows], bins).cumsum()[:-1]
            fits = (n > 0) & (n < len(rows))
            if fits.any():
                nl, pl = n[fits], p[fits]
                nr, pr = len(rows) - nl, ones - pl
                gain = pl * pl / nl + pr * pr / nr + (nl - pl) ** 2 / nl + (nr - pr) ** 2 / nr - (ones * ones + (len(rows) - ones) ** 2) / len(rows)
                i = int(np.argmax(gain >= gain.max() - 1e-9))
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(k), int(np.flatnonzero(fits)[i]))
        if best[0] <= 1e-12:
            continue
        low = codes[rows, best[1]] <= best[2]
        nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
        for part in (rows[low], rows[~low]):
            waiting.append((len(nodes), part))
            nodes.append([-1, 0, -1, -1, float(y[part].mean())])
    return nodes


def fit_block(x: np.ndarray, y: np.ndarray, trees: int, seed: tuple[int, ...]) -> dict[str, list]:
    """Trees of one block, their nodes one after the other."""
    cuts = [cut_points(c, BINS) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    bins, rng = max((len(c) for c in cuts), default=0) + 1, np.random.default_rng(seed)
    out: dict[str, list] = {n: [] for n in ("feature", "threshold", "below", "above", "value", "roots")}
    for _ in range(trees):
        bag = rng.integers(0, len(y), len(y))
        start = len(out["feature"])
        out["roots"].append(start)
        for k, cut, below, above, value in grow(codes[bag], y[bag], max(1, int(np.sqrt(x.shape[1]))), bins, rng):
            for n, v in zip(out, (k, float(cuts[k][cut]) if k >= 0 else 0.0, below + start if k >= 0 else -1, above + start if k >= 0 else -1, value), strict=False):
                out[n].append(v)
    return out


def walk(trees: dict[str, np.ndarray], root: int, x: np.ndarray, column: int = -1, values: np.ndarray | None = None) -> np.ndarray:
    """A tree's values for rows of ``x``, whose ``column`` is ``values``."""
    at, row = np.full(len(x), root), np.arange(len(x))
    while (inner := trees["feature"][at] >= 0).any():
        k = np.where(inner, trees["feature"][at], 0)
        seen = x[row, k] if values is None else np.where(k == column, values, x[row, k])
        at = np.where(inner, np.where(seen <= trees["threshold"][at], trees["below"][at], trees["above"][at]), at)
    return trees["value"][at]


def shuffled_scores(trees: dict[str, np.ndarray], x: np.ndarray, columns: list[int], repeats: int, seed: tuple[int, ...]) -> np.ndarray:
    """Sums of the trees' values: as the rows are, then for each of ``columns`` and each repeat with its values shuffled."""
    shuffles = {k: [np.random.default_rng([*seed, k, r]).permutation(len(x)) for r in range(repeats)] for k in columns}
    plain, moved = np.zeros(len(x)), np.zeros((len(columns), repeats, len(x)))
    ends = [*trees["roots"][1:], len(trees["feature"])]
    tall = np.tile(x, (repeats, 1))
    for root, end in zip(trees["roots"], ends, strict=True):
        own = walk(trees, root, x)
        plain += own
        used = set(trees["feature"][root:end].tolist())
        for i, k in enumerate(columns):
            # a tree that doesn't ask for the column gives what it gave
            moved[i] += walk(trees, root, tall, k, np.concatenate([x[s, k] for s in shuffles[k]])).reshape(repeats, -1) if k in used else own
    return np.concatenate([plain[None, :], moved.reshape(-1, len(x))])


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each column: a group a column."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))
    return {r["feature"]: r["m"] for r in rows.select(F.inline(cells)).where("v IS NOT NULL").groupBy("feature").agg(F.percentile("v", 0.5).alias("m")).collect()}


def permutation_importance(df: DataFrame, columns: list[str], seed: int = 0, trees: int = TREES, group: int = GROUP) -> DataFrame:
    """``feature, importance``: the area lost by shuffling the column, the mean of the repeats, summed over folds that have both classes.

    Unknown values are filled with the column's median; columns without any value have no importance.
    """
    known = df.where("labelable = 1")
    middle = medians(known, columns)
    columns = [c for c in columns if middle.get(c) is not None]
    sizes = {r["yr"]: r["count"] for r in known.groupBy("yr").count().collect()}  # a row a year
    if not columns or len(sizes) < 2:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    folds = deal_years(sizes)
    n_folds = max(folds.values()) + 1
    of_year = F.element_at(F.create_map(*(F.lit(v) for item in folds.items() for v in item)), F.col("yr"))
    filled = known.select("unit", "yr", "wn", "y", of_year.alias("fold"), *(F.coalesce(F.col(c).cast("double"), F.lit(middle[c])).alias(c) for c in columns))
    rows = materialised(filled.select("unit", "yr", "wn", "y", "fold", vector(columns).alias("x")), "rows")

    others = rows.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where("fold <> _own").drop("_own")
    blocks = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // BLOCK) - 1))))
    order = [F.xxhash64(F.lit(seed), "block", "unit", "yr", "wn"), F.col("unit"), F.col("yr"), F.col("wn")]
    sample = blocks.withColumn("_nth", F.row_number().over(Window.partitionBy("fold", "block").orderBy(*order))).where(F.col("_nth") <= SAMPLE).drop("_nth")

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["unit", "yr", "wn"])
        fold, block = (int(frame[c].iloc[0]) for c in ("fold", "block"))
        found = fit_block(matrix(frame["x"]), frame["y"].to_numpy(float), min(BLOCK, trees - block * BLOCK), (seed, fold, block))
        return pd.DataFrame([[fold, block, *(found[n.split()[0]] for n in _TREES.split(", "))]], columns=["fold", "block", *(n.split()[0] for n in _TREES.split(", "))])

    grown = materialised(sample.groupBy("fold", "block").applyInPandas(fitted, f"fold int, block int, {_TREES}"), "trees")
    n_groups = -(-max(sum(n for y, n in sizes.items() if folds[y] == f) for f in range(n_folds)) // group)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.withColumn("group", F.pmod(F.xxhash64("unit", "yr", "wn"), F.lit(n_groups)).cast("int")).withColumn("slice", each(SLICES))
    sent = grown.withColumn("group", each(n_groups)).withColumn("slice", each(SLICES))
    names = [n.split()[0] for n in _TREES.split(", ")]

    def scored(frame: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame()
        frame = frame.sort_values(["unit", "yr", "wn"])
        fold, part, cut = (int(frame[c].iloc[0]) for c in ("fold", "group", "slice"))
        mine = list(range(cut, len(columns), SLICES))
        x, total = matrix(frame["x"]), 0.0
        for model in models.sort_values("block").to_dict("records"):
            total = total + shuffled_scores({n: np.array(model[n]) for n in names}, x, mine, REPEATS, (seed, fold, part))
        total = total / trees
        keep = slice(0 if cut == 0 else 1, None)  # the rows as they are come out once
        feature = np.r_[-1, np.repeat(mine, REPEATS)][keep]
        turn = np.r_[0, np.tile(np.arange(REPEATS), len(mine))][keep]
        p = np.round(total[keep], 12)
        return pd.DataFrame({"fold": fold, "column": np.repeat(feature, len(x)), "turn": np.repeat(turn, len(x)), "y": np.tile(frame["y"].to_numpy(), len(feature)), "p": p.ravel()})

    scores = asked.groupBy("fold", "group", "slice").cogroup(sent.groupBy("fold", "group", "slice")).applyInPandas(scored, "fold int, column int, turn int, y int, p double")
    areas = materialised(auroc(scores, ["fold", "column", "turn"], ranges=1).where("auroc IS NOT NULL"), "areas")
    base = areas.where("column < 0").select("fold", F.col("auroc").alias("base"))
    lost = areas.where("column >= 0").join(F.broadcast(base), "fold").groupBy("column", "fold").agg(F.avg(F.col("base") - F.col("auroc")).alias("lost"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("column") + 1)
    return lost.groupBy(name.alias("feature")).agg(F.sum("lost").alias("importance"))


def predictive_attribution(df: DataFrame, columns: list[str], most: int = 14, seed: int = 0, trees: int = TREES) -> DataFrame:
    """The ``most`` features by permutation importance, of equals by name; by single AUROC where none has any importance."""
    found = materialised(permutation_importance(df, columns, seed, trees), "importance")
    if found.where(F.abs("importance") > 1e-8).isEmpty():
        return attribution(df.where("labelable = 1"), columns, most).withColumn("method", F.lit("single"))
    ranked = found.select("feature", F.round("importance", 9).alias("importance"), family_of(F.col("feature")).alias("family"), F.lit("permutation").alias("method"))
    return ranked.orderBy(F.desc("importance"), "feature").limit(most)
