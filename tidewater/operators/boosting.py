"""Gradient-boosted trees for many training sets at once, each of a bounded number of rows.

The training cap bounds a set, so that each is fitted in a task of its own, all sets of all folds,
column lists, units and seeds in one job. A model is a row of arrays: the nodes of all its trees one
after the other. Rows to be scored, of which there is no bound, stream past the model of their group;
a large group is cut into slices.

Trees are grown leaf by leaf, the best split first, on histograms of the gradient and its second
derivative over at most ``bins`` bins a column. Classes are balanced by weight. Unknown values take
the column's train median; columns that no train row knows are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Into how many slices the rows of a group are cut for scoring.
SLICES = 8
_MODEL = "medians array<double>, roots array<int>, feature array<int>, threshold array<double>, below array<int>, above array<int>, value array<double>, points array<double>, levels array<double>"


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    least_rows: int = 20
    bins: int = 63
    least_curve: float = 1e-3


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a column is cut: between its distinct values, or their quantiles if there are too many."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.percentile(values, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


class _Leaf:
    """Rows of a leaf and its best split; ``sums`` are (gradient, curve, rows) by column and bin, none for a leaf too small to split."""

    def __init__(self, rows: np.ndarray, weights: np.ndarray, sums: np.ndarray | None, s: Settings) -> None:
        self.rows, self.sums = rows, sums
        self.g, self.h = (float(w[rows].sum()) for w in weights)
        self.value, self.gain = -s.rate * self.g / max(self.h, 1e-15), -np.inf
        if sums is None or sums.shape[2] < 2:
            return
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        right = sums.sum(axis=2, keepdims=True) - left
        fits = (np.minimum(left[2], right[2]) >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_curve)
        column, cut = np.nonzero(fits)
        if not len(column):
            return
        gl, hl, gr, hr = left[0][fits], left[1][fits], right[0][fits], right[1][fits]
        gain = gl * gl / hl + gr * gr / hr
        at = int(np.argmax(gain >= gain.max() - 1e-9))  # of equals the first column and cut, whatever the rounding
        self.column, self.cut, self.gain = int(column[at]), int(cut[at]), float(gain[at]) - self.g**2 / self.h


def _histogram(codes: np.ndarray, rows: np.ndarray, weights: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    flat = codes[rows].ravel()
    sums = [np.bincount(flat, np.repeat(w[rows], shape[0]), shape[0] * shape[1]) for w in weights]
    return np.stack([*sums, np.bincount(flat, minlength=shape[0] * shape[1])]).reshape(3, *shape)


def grow(codes: np.ndarray, shape: tuple[int, int], weights: np.ndarray, s: Settings) -> list[list]:
    """Nodes [column, cut, below, above, value, rows] of one tree; a leaf's column is -1. ``codes`` are column * bins + bin."""
    every = np.arange(len(codes))
    first = _Leaf(every, weights, _histogram(codes, every, weights, shape), s)
    nodes, open_leaves, n_leaves = [[-1, 0, -1, -1, first.value, every]], [(-first.gain, 0, first)], 1
    while n_leaves < s.leaves and open_leaves and open_leaves[0][0] < 0:
        _, at, leaf = heapq.heappop(open_leaves)
        low = codes[leaf.rows, leaf.column] <= leaf.column * shape[1] + leaf.cut
        sides = leaf.rows[low], leaf.rows[~low]
        small = int(len(sides[0]) > len(sides[1]))
        sums: list[np.ndarray | None] = [None, None]
        if len(sides[1 - small]) >= 2 * s.least_rows:  # the larger side is what the smaller leaves of its parent
            sums[small] = _histogram(codes, sides[small], weights, shape)
            sums[1 - small] = leaf.sums - sums[small]
            if len(sides[small]) < 2 * s.least_rows:
                sums[small] = None
        nodes[at][:4] = [leaf.column, leaf.cut, len(nodes), len(nodes) + 1]
        for rows, part in zip(sides, sums, strict=True):
            child = _Leaf(rows, weights, part, s)
            nodes.append([-1, 0, -1, -1, child.value, rows])
            heapq.heappush(open_leaves, (-child.gain, len(nodes) - 1, child))
        n_leaves += 1
    return nodes


def balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))


def filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """The model's arrays; ``points`` and ``levels`` are left to the caller."""
    known = ~np.isnan(x).all(axis=0)
    medians = np.full(x.shape[1], np.nan)
    medians[known] = np.nanmedian(x[:, known], axis=0)
    x = filled(x, medians)
    cuts = {k: c for k in np.flatnonzero(known) if len(c := cut_points(x[:, k], s.bins))}
    columns = list(cuts)
    shape = len(columns), max((len(c) for c in cuts.values()), default=0) + 1
    codes = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") + i * shape[1] for i, k in enumerate(columns)], axis=1) if columns else np.zeros((len(y), 0), np.int64)
    w, raw = balanced(y), np.zeros(len(y))
    roots, out = [], [[], [], [], [], []]
    for _ in range(s.rounds if columns else 0):
        p = 1 / (1 + np.exp(-raw))
        nodes, start = grow(codes, shape, np.stack([w * (p - y), w * p * (1 - p)]), s), len(out[0])
        roots.append(start)
        for column, cut, below, above, value, rows in nodes:
            k = columns[column] if column >= 0 else -1
            for c, v in zip(out, (k, cuts[k][cut] if k >= 0 else 0.0, below + start if k >= 0 else -1, above + start if k >= 0 else -1, value), strict=True):
                c.append(v)
            if k < 0:
                raw[rows] += value
    names = ("feature", "threshold", "below", "above", "value")
    return {"medians": medians, "roots": np.array(roots, np.int32), **{n: np.array(c, float if n in ("threshold", "value") else np.int32) for n, c in zip(names, out, strict=True)}}


def walk(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probability of class 1 for each row: all rows go down all trees together."""
    x = filled(x, model["medians"])
    at = np.repeat(model["roots"][None, :], len(x), axis=0)
    row = np.arange(len(x))[:, None]
    while at.size and (inner := model["feature"][at] >= 0).any():
        low = x[row, np.where(inner, model["feature"][at], 0)] <= model["threshold"][at]
        at = np.where(inner, np.where(low, model["below"][at], model["above"][at]), at)
    return 1 / (1 + np.exp(-model["value"][at].sum(axis=1))) if at.size else np.full(len(x), 0.5)


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Lists of numbers as rows; null is NaN."""
    lists = column if isinstance(column, pa.Array) else pa.array(list(column), pa.list_(pa.float64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def vector(columns: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))


def fit_groups(train: DataFrame, keys: list[str], order: list[str], settings: Settings, steps) -> DataFrame:
    """A model for each group of ``train`` (*keys, *order, y, x), of a bounded number of rows each; ``steps`` turns its train scores and labels into points and levels."""
    schema = ", ".join(f"`{c}` {t}" for c, t in train.select(*keys).dtypes) + ", " + _MODEL

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        x, y = matrix(frame["x"]), frame["y"].to_numpy(float)
        model = fit(x, y, settings)
        model["points"], model["levels"] = steps(walk(model, x), y)
        names = [f.strip().split()[0] for f in _MODEL.split(",")]
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), *(model[n].tolist() for n in names)]], columns=[*keys, *names])

    return train.groupBy(*keys).applyInPandas(one, schema)


def score_rows(rows: DataFrame, models: DataFrame, keys: list[str], calibrate: bool) -> DataFrame:
    """``rows`` (*keys, others, x) with ``p`` in place of ``x``; rows of groups without a model go."""
    others = [c for c in rows.columns if c not in (*keys, "x")]
    names = [f.strip().split()[0] for f in _MODEL.split(",")]
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    first = models.select(*keys, slices.alias("_slice"), F.lit(0).alias("_kind"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others), F.lit(None).cast("array<double>").alias("x"), F.struct(*names).alias("_model"))
    then = rows.select(*keys, F.pmod(F.xxhash64(*others), F.lit(SLICES)).cast("int").alias("_slice"), F.lit(1).alias("_kind"), *others, "x", F.lit(None).cast(first.schema["_model"].dataType).alias("_model"))
    both = first.unionByName(then).repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "_kind")
    out = rows.select(*keys, *others).schema.add("p", "double")
    kept = len(keys) + 2

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, model = None, None
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            marks = list(zip(*(frame.column(c).to_pylist() for c in [*keys, "_slice"]), strict=True))
            kinds = frame.column("_kind").to_pylist()
            at = 0
            while at < len(marks):
                if kinds[at] == 0:
                    group, model = marks[at], {k: np.array(v, np.int32 if k in ("roots", "feature", "below", "above") else float) for k, v in frame.column("_model")[at].as_py().items()}
                    at += 1
                    continue
                end = at
                while end < len(marks) and kinds[end] == 1 and marks[end] == marks[at]:
                    end += 1
                if marks[at] == group:
                    part = batch.slice(at, end - at)
                    p = walk(model, matrix(part.column(kept + len(others))))
                    if calibrate:
                        p = np.interp(p, model["points"], model["levels"])
                    columns = [part.column(i) for i in (*range(len(keys)), *range(kept, kept + len(others)))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64())], names=[*keys, *others, "p"])
                at = end

    return both.mapInArrow(scored, out)
