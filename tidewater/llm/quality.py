"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in one pass. The trees are grown from the rows with labels
outside the held-out fold; where there are more than ``SAMPLE`` of them, from the ``SAMPLE`` of the
least hash of their id, so that the fit takes as long whatever the size of the corpus. The trees are
complete and flattened into arrays of features, thresholds and values, which numpy walks down for
all rows and trees of a batch at once.

Defined cases: a null text counts as empty, and an empty text has a score like any other. Rows that
share an id share the fold, and equal texts share the score. A null id is never held out nor learnt
from. Labels that are null are left out; without labels of both kinds the score is a smoothed share
of 1. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage, text_or_empty, utf8

#: Rows with labels that a model is fitted on, at most.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_sd", "longest_word", "short_words", "unique_words", "top_word", "unique_pairs", "repeated_next", "unique_lines", "short_lines",
    "line_words", "letters", "capitals", "digits", "spaces", "beyond_ascii", "enders", "commas", "bars", "marks", "symbols", "brackets", "entropy", "bare_words", "shouted_words", "capital_words", "ended_lines", "deflated",
)

_CLASSES = np.zeros((256, 11))
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", bytes(range(128, 256)), b".?", b",;", b"|", b"!", b"#$%&*+=@^_~<>\\/", b"()[]{}")):
    _CLASSES[list(_bytes), _k] = 1


def statistics(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    lower, upper, digits, spaces, beyond, enders, commas, bars, marks, symbols, brackets = (counts @ _CLASSES / n).tolist()
    some = counts[counts > 0] / n
    words, lines = text.split(), text.split(b"\n")
    n_words, n_lines = max(len(words), 1), len(lines)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    frequent = Counter(words).most_common(1)
    filled = [x for x in (y.strip() for y in lines) if x]
    n_filled = max(len(filled), 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(n_lines), sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 3).mean(),
        len(set(words)) / n_words, (frequent[0][1] if frequent else 0) / n_words, len(set(zip(words, words[1:], strict=False))) / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words, len(set(filled)) / n_filled, sum(len(x) < 40 for x in filled) / n_filled, np.log1p(n_words / n_lines),
        lower + upper, upper, digits, spaces, beyond, enders, commas, bars, marks, symbols, brackets, -(some * np.log2(some)).sum(),
        sum(not x.isalnum() and len(x) < 3 for x in words) / n_words, sum(map(bytes.isupper, words)) / n_words, sum(map(bytes.istitle, words)) / n_words,
        sum(x[-1:] in b".?!" for x in filled) / n_filled, len(zlib.compress(text, 1)) / n,
    ]


@dataclass
class Trees:
    """Complete trees of one depth. Node i has children 2i + 1 and 2i + 2; a row goes right where it is above."""

    prior: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if len(self.value) and len(x):
            trees, rows = np.arange(len(self.value)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.value)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.value[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least_rows: int = 10) -> Trees:
    """Boosted trees for the log loss, each level's splits found in histograms of all its nodes."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    share = (y.sum() + 1) / (n + 2)
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)  # bin b: above edge b - 1, not above edge b
    cell = binned + np.arange(width) * bins
    total, found = np.full(n, model.prior), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)  # no split: all go left
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            place = (((node - nodes + 1) * width * bins)[:, None] + cell).ravel()
            sums = [np.bincount(place, np.repeat(w, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for w in (gradient, hessian, np.ones(n))]
            (gl, hl, nl), (g, h, m) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(nl < least_rows) | (m - nl < least_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-6):
                f, b = divmod(int(best[k]), bins)
                feature[nodes - 1 + k], threshold[nodes - 1 + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + ridge)
        total += value[leaf]
        found.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(z) for z in zip(*found, strict=True))
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, features`` of each row, from its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("features", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([statistics(t) for t in utf8(batch.column(2))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], schema=schema)

    clean = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(clean), clean).mapInArrow(measure, "doc_id long, version long, features array<double>")


def learn(features: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, **options) -> Trees:
    """A model from the labelled rows outside the held-out fold; at most ``sample`` reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    rows = features.where(~held_out(F.col("doc_id"))).join(known, "doc_id").orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id", "version", "y").limit(sample).select("features", "y").toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy(), **options)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """A row for each row: ``doc_id, version, held_out, score, predicted``; version is a hash of the text."""
    bound_batches(docs.sparkSession)
    features = stage(measured(docs, id_col, text_col), "features")
    model = docs.sparkSession.sparkContext.broadcast(learn(features, labels, **options))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(FEATURES))
            parts = [model.value.score(x[at : at + 500]) for at in range(0, len(x), 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([*parts, np.empty(0)]))], names=["doc_id", "version", "score"])

    out = features.mapInArrow(scored, "doc_id long, version long, score double")
    return out.select("doc_id", "version", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
