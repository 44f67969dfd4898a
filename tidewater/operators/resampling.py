"""Cluster bootstraps that put scores in order once, whatever the number of replicates.

A replicate draws whole clusters with replacement. Replicates come in blocks with a random stream of
their own, seeded by (seed, block), so that any task can make the multiplicities of a block from the
number of clusters alone: none are made on the driver, shuffled or written.

Scores are cut into chunks of ``CHUNK`` rows in the order of the score, equal scores together, and
written. Each chunk gives the weight of both classes in each replicate as arrays; running totals over
chunks tell what lies below; then each chunk adds its part of the metrics, a row a replicate. What is
written grows with the scores and, by a chunk, with the replicates, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..session import materialised
from . import metrics

REPLICATES, BLOCK, CHUNK = 2000, 250, 16_384
METRICS = ("auroc", "auprc", "brier")


@lru_cache(maxsize=16)
def multiplicities(n_clusters: int, block: int, seed: int, size: int) -> np.ndarray:
    """How often each cluster is drawn, a row a replicate of the block."""
    rng = np.random.default_rng([seed, block])
    return np.stack([np.bincount(rng.integers(0, n_clusters, n_clusters), minlength=n_clusters) for _ in range(size)]).astype(np.float64)


def blocks_of(replicates: int) -> list[tuple[int, int]]:
    """(block, size) of all blocks."""
    return [(b, min(BLOCK, replicates - b * BLOCK)) for b in range(-(-replicates // BLOCK))]


def with_places(oof: DataFrame, within: list[str]) -> DataFrame:
    """Adds ``place``, the cluster's number in the order of names, and ``clusters``, how many there are; for each group of ``within`` apart."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    names = oof.select(*within, "cluster").distinct()
    numbered = names.select(*within, "cluster", (F.row_number().over(group.orderBy("cluster")) - 1).alias("place"), F.count(F.lit(1)).over(group).cast("int").alias("clusters"))
    return oof.join(numbered, [*within, "cluster"])


def chunks(oof: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """``*by, chunk, p, y, place, clusters, n`` of (cluster, y, p): counts of equal rows, written in chunks in the order of ``p``."""
    known = with_places(oof.where("p IS NOT NULL AND y IS NOT NULL"), within or [])
    counts = known.groupBy(*by, "p", "y", "place", "clusters").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(*by, "p").sortWithinPartitions(*by, "p")
    n_by = len(by)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, group, score = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(n_by)), strict=True)) if n_by else [()] * batch.num_rows
            out = []
            for mark, p in zip(marks, batch.column(n_by).to_pylist(), strict=True):
                if group is not None and (mark != group or (size >= CHUNK and p != score)):
                    chunk, size = chunk + 1, 0
                group, score, size = mark, p, size + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "chunk"])

    return materialised(ordered.mapInArrow(numbered, _keyed(ordered, ordered.columns, "chunk long")), "chunks")


def _weights(frame: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    place, n, clusters = frame["place"].to_numpy(), frame["n"].to_numpy(float), int(frame["clusters"].iloc[0])
    for block, size in blocks_of(replicates):
        yield block, multiplicities(clusters, block, seed, size)[:, place] * n


def _keyed(df: DataFrame, by: list[str], fields: str) -> str:
    return ", ".join([f"`{c}` {t}" for c, t in df.select(*by).dtypes] + [fields])


def replicate_metrics(ordered: DataFrame, by: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``*by, b, auroc, auprc, brier`` of ``chunks``; null where a class is missing in a replicate."""
    keys = [*by, "chunk"]

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame["y"].to_numpy() == 1
        rows = [[b, w[:, one].sum(axis=1), w[:, ~one].sum(axis=1)] for b, w in _weights(frame, replicates, seed)]
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), b, wp.tolist(), wn.tolist()] for b, wp, wn in rows], columns=[*keys, "block", "wp", "wn"])

    sums = ordered.groupBy(*keys).applyInPandas(weigh, _keyed(ordered, keys, "block int, wp array<double>, wn array<double>"))
    each = sums.select(*keys, "block", F.posexplode(F.arrays_zip("wp", "wn")).alias("at", "w")).select(*keys, "block", "at", "w.wp", "w.wn")
    group = Window.partitionBy(*by, "block", "at")
    below = group.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.select(*keys, "block", "at", *(F.coalesce(F.sum(c).over(below), F.lit(0.0)).alias(f"below_{c}") for c in ("wp", "wn")), *(F.sum(c).over(group).alias(f"all_{c}") for c in ("wp", "wn")))

    def judge(frame: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame()
        frame = frame.sort_values("p", kind="stable")
        y, p = frame["y"].to_numpy(float), frame["p"].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, np.diff(p) > 0])
        error, out = (p - y) ** 2, []
        for block, w in _weights(frame, replicates, seed):
            at = before[before["block"] == block].sort_values("at")
            low_p, low_n, all_p, all_n = (at[c].to_numpy()[:, None] for c in ("below_wp", "below_wn", "all_wp", "all_wn"))
            wp, wn = np.add.reduceat(w * y, starts, axis=1), np.add.reduceat(w * (1 - y), starts, axis=1)
            under_p, under_n = low_p + np.cumsum(wp, axis=1) - wp, low_n + np.cumsum(wn, axis=1) - wn
            tp, fp = all_p - under_p, all_n - under_n
            precision = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
            out.append(np.stack([block * BLOCK + np.arange(len(w)), (wp * (under_n + wn / 2)).sum(axis=1), (wp * precision).sum(axis=1), w @ error, wp.sum(axis=1), wn.sum(axis=1)], axis=1))
        table = pd.DataFrame(np.concatenate(out), columns=["b", "pairs", "steps", "error", "wp", "wn"])
        for i, k in enumerate(by):
            table.insert(i, k, frame[k].iloc[0])
        return table

    parts = ordered.groupBy(*keys).cogroup(totals.groupBy(*keys)).applyInPandas(judge, _keyed(ordered, by, "b int, pairs double, steps double, error double, wp double, wn double"))
    whole = parts.groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in ("pairs", "steps", "error", "wp", "wn")))
    return whole.select(*by, "b", ratio(F.col("pairs"), F.col("wp") * F.col("wn")).alias("auroc"), F.when(F.col("wn") > 0, ratio(F.col("steps"), F.col("wp"))).alias("auprc"), ratio(F.col("error"), F.col("wp") + F.col("wn")).alias("brier"))


def replicate_calibration(ordered: DataFrame, by: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``*by, b, cox_intercept, cox_slope, brier, ece`` of ``chunks``; replicates that lack a class have none.

    The two coefficients of all replicates go through Newton's steps together: a step is five sums a
    replicate over all chunks, and a solution of two equations. Replicates without a solution have nulls.
    """
    keys, bins = [*by, "chunk"], metrics.BINS
    marks = np.array([i * (1.0 / bins) for i in range(bins)] + [1.0])

    def gaps(frame: pd.DataFrame) -> pd.DataFrame:
        y, p = frame["y"].to_numpy(float), frame["p"].to_numpy(float)
        at = np.where(p < 1, np.searchsorted(marks, p, side="right") - 1, bins)
        design, out = np.stack([np.ones_like(y), y, p, (p - y) ** 2], axis=1), []
        for block, w in _weights(frame, replicates, seed):
            for k in np.unique(at):
                s = w[:, at == k] @ design[at == k]
                out.append(np.c_[block * BLOCK + np.arange(len(w)), np.full(len(w), k), s])
        table = pd.DataFrame(np.concatenate(out), columns=["b", "bin", "n", "y", "p", "error"])
        for i, k in enumerate(by):
            table.insert(i, k, frame[k].iloc[0])
        return table

    binned = ordered.groupBy(*keys).applyInPandas(gaps, _keyed(ordered, by, "b int, bin int, n double, y double, p double, error double")).groupBy(*by, "b", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "y", "p", "error")))
    gap = F.when(F.col("bin") < bins, F.abs(F.col("y") - F.col("p"))).otherwise(0.0)
    point = binned.groupBy(*by, "b").agg(ratio(F.sum("error"), F.sum("n")).alias("brier"), ratio(F.sum(gap), F.sum("n")).alias("ece"), F.sum("y").alias("_pos"), F.sum("n").alias("_all"))
    point = materialised(point.where("_pos > 0 AND _pos < _all").drop("_pos", "_all"), "gaps")

    def step(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(state):
            return pd.DataFrame()
        y, p = frame["y"].to_numpy(float), frame["p"].to_numpy(float)
        q = p.clip(metrics.EPS, 1 - metrics.EPS)
        x, out = np.log(q / (1 - q)), []
        weights = dict(_weights(frame, replicates, seed))
        for block, part in state.groupby(state["b"] // BLOCK):
            w = weights[block][part["b"].to_numpy() % BLOCK]
            fit = 1 / (1 + np.exp(-np.clip(part["_a"].to_numpy()[:, None] + part["_s"].to_numpy()[:, None] * x, -30, 30)))
            curve, slack = w * fit * (1 - fit), w * (y - fit)
            out.append(np.stack([part["b"].to_numpy(), curve.sum(axis=1), curve @ x, curve @ (x * x), slack.sum(axis=1), slack @ x], axis=1))
        table = pd.DataFrame(np.concatenate(out), columns=["b", "_h", "_hx", "_hxx", "_g", "_gx"])
        for i, k in enumerate(by):
            table.insert(i, k, frame[k].iloc[0])
        return table

    pairs = materialised(ordered.select(*keys).distinct(), "pairs")

    def sums_of(moving: DataFrame) -> DataFrame:
        sent = pairs.join(moving, by) if by else pairs.crossJoin(moving)
        return ordered.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(step, _keyed(ordered, by, "b int, _h double, _hx double, _hxx double, _g double, _gx double"))

    found = newton(point.select(*by, "b"), [*by, "b"], sums_of)
    return point.join(found.withColumnsRenamed({"_a": "cox_intercept", "_s": "cox_slope"}), [*by, "b"])


def newton(groups: DataFrame, keys: list[str], sums_of: Callable[[DataFrame], DataFrame], steps: int = 25, close: float = 1e-9) -> DataFrame:
    """``*keys, _a, _s``: the constant and slope of a logistic regression in each group, null where there is no solution.

    ``sums_of`` gives the parts ``_h, _hx, _hxx, _g, _gx`` of five sums for the groups, each with its ``_a``
    and ``_s``. All groups step together; those that have arrived stay behind.
    """
    states = groups.select(*keys, F.lit(0.0).alias("_a"), F.lit(0.0).alias("_s"), F.lit(False).alias("_done"))
    for _ in range(steps):
        moving = states.where("NOT _done")
        sums = sums_of(moving.select(*keys, "_a", "_s")).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("_h", "_hx", "_hxx", "_g", "_gx")))
        det = F.col("_h") * F.col("_hxx") - F.col("_hx") * F.col("_hx")
        det = F.when(F.abs(det) > 1e-12, det)
        moved = sums.select(*keys, ratio(F.col("_g") * F.col("_hxx") - F.col("_gx") * F.col("_hx"), det).alias("_da"), ratio(F.col("_h") * F.col("_gx") - F.col("_hx") * F.col("_g"), det).alias("_ds"))
        after = moving.join(moved, keys).select(*keys, (F.col("_a") + F.col("_da")).alias("_a"), (F.col("_s") + F.col("_ds")).alias("_s"), F.coalesce(F.greatest(F.abs("_da"), F.abs("_ds")) < close, F.lit(True)).alias("_done"))
        states = materialised(states.where("_done").unionByName(after), "newton")
        if states.where("NOT _done").isEmpty():
            break
    return states.select(*keys, *(F.when(F.col("_done"), F.col(c)).alias(c) for c in ("_a", "_s")))
