"""Exact top-k search by inner product, block at a time.

Components are taken as integers, ``floor(scale * x)``.

1. Rows are ordered by the nearest of at most ``PIVOTS`` pivots (a bounded sample, the rows of the
   least hash of their id) and by id. Pivots only decide how tight bounds are, never the result.
2. Ranges of ``BLOCK_ROWS`` rows of that order are blocks. A shard is a row of the staged index: the
   forward index of some blocks (ids and components) and the largest and smallest component of each
   block in each dimension, the term maxima of the signed components.
3. Each query meets its own shard first, which gives it k partners and so a first bound.
4. Then it meets all groups of shards, in tiles of queries: the blocks of a group are ordered by the
   sum over dimensions of the largest product that the block allows, and scored from their forward
   index until these sums fall below the k-th score, or equal it where all ids are larger. A task
   holds one group (``GROUP_BYTES``) and streams the tiles; its answers are k rows a query at most.
5. The best k of all answers of a query are its result.

Where nothing can be left out (components without any structure), each query is scored against each
row, in blocks; the work is then that of all products.

Defined cases: a vector that is null, or holds a null or non-finite component (before or after
scaling), takes no part. Vectors of fewer components count as followed by zeros, an empty one as
all zeros. Rows of equal id and vector count once. Rows of equal id but other vectors ask together,
for the best of all their scores; a row of the query's own id is no candidate. A row without an id can
be found, after all others of its score, but doesn't ask. Scores outside of long are given as its
nearest end. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stage

PIVOTS = 256
BLOCK_ROWS = 256
SHARD_BYTES = 1 << 20
GROUP_BYTES = 32 << 20
#: Queries that are looked at together, and queries of one task.
TILE, SLICE = 2048, 500_000
_NO_ID = np.iinfo(np.int64).max
_LONG = np.iinfo(np.int64)
#: Owner, score, id, and whether found here, one place an entry; sorted by owner, best first.
Entries = tuple[np.ndarray, ...]

_PLACED = pa.schema([("pivot", pa.int32()), ("id", pa.int64()), ("asks", pa.bool_()), ("vec", pa.binary())])
_SHARDS = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("asks", pa.binary()), ("vecs", pa.binary())])
_TILES = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("top", pa.binary())])
_ANSWERS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def packed(values: np.ndarray) -> bytes:
    """Integers held in doubles: two bytes each where all fit, with a byte that tells which."""
    if not values.size or np.abs(values).max() < 1 << 15:
        return b"2" + values.astype("<i2").tobytes()
    return b"8" + values.astype("<f8").tobytes()


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    flat = np.frombuffer(blob, "<i2" if blob[:1] == b"2" else "<f8", offset=1)
    return flat.astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def widened(rows: np.ndarray, dim: int) -> np.ndarray:
    return rows if rows.shape[1] == dim else np.pad(rows, ((0, 0), (0, dim - rows.shape[1])))


def scaled(vectors: list, scale: float) -> list[np.ndarray]:
    return [np.floor(scale * np.asarray(v, np.float64)) for v in vectors]


def stacked(vectors: list[np.ndarray]) -> np.ndarray:
    dim = max((len(v) for v in vectors), default=0)
    if all(len(v) == dim for v in vectors):
        return np.array(vectors, np.float64).reshape(len(vectors), dim)
    return np.stack([np.pad(v, (0, dim - len(v))) for v in vectors])


def chained(pivots: np.ndarray) -> np.ndarray:
    """Pivots so ordered that each is followed by the nearest of those left."""
    left, order = list(range(1, len(pivots))), [0]
    while left:
        at = int(np.argmin(((pivots[left] - pivots[order[-1]]) ** 2).sum(axis=1)))
        order.append(left.pop(at))
    return pivots[order]


def _placed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, scale: float) -> Iterator[pa.RecordBatch]:
    with np.errstate(all="ignore"):  # a poor pivot does no harm
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            ints = scaled(batch.column(2).to_pylist(), scale)
            rows = stacked(ints)
            common = min(rows.shape[1], pivots.shape[1])
            near = np.argmax(rows[:, :common] @ pivots[:, :common].T - half, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1), pa.array([packed(v) for v in ints], pa.binary())], schema=_PLACED)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows -> shards; within a block by id, rows of equal id and vector once."""
    ids, asks, vecs, size, n_shards = [], [], [], 0, 0
    part = TaskContext.get().partitionId() << 32

    def shard() -> pa.RecordBatch:
        rows = stacked([unpacked(v, (len(v) - 1) // int(v[:1]) or 1).ravel() for v in vecs])
        key = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        order = np.lexsort((key, np.arange(len(key)) // BLOCK_ROWS))
        return pa.RecordBatch.from_arrays([[part + n_shards], pa.array([rows.shape[1]], pa.int32()), [key[order].astype("<i8").tobytes()], [np.array(asks, bool)[order].tobytes()], [packed(rows[order])]], schema=_SHARDS)

    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if row == last:
                continue
            last = row
            ids.append(row[0])
            asks.append(row[1])
            vecs.append(row[2])
            size += len(row[2])
            if size >= SHARD_BYTES and len(ids) % BLOCK_ROWS == 0:
                yield shard()
                ids, asks, vecs, size, n_shards = [], [], [], 0, n_shards + 1
    if ids:
        yield shard()


class Blocks:
    """The forward index of some blocks, and their term maxima."""

    def __init__(self, shards: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.dim = max(rows.shape[1] for _, _, rows in shards)
        self.rows = np.concatenate([widened(rows, self.dim) for _, _, rows in shards])
        self.ids = np.concatenate([ids for _, ids, _ in shards])
        lengths = [n for _, ids, _ in shards for n in [BLOCK_ROWS] * (len(ids) // BLOCK_ROWS) + [len(ids) % BLOCK_ROWS] * (len(ids) % BLOCK_ROWS > 0)]
        self.start = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.shard = np.repeat([s for s, _, _ in shards], [-(-len(ids) // BLOCK_ROWS) for _, ids, _ in shards])
        self.least_id = self.ids[self.start[:-1]]
        self.most = np.maximum.reduceat(self.rows, self.start[:-1]) if self.dim else np.zeros((len(lengths), 0))
        self.least = np.minimum.reduceat(self.rows, self.start[:-1]) if self.dim else np.zeros((len(lengths), 0))
        self.peak = float(np.abs(self.rows).max(initial=0.0))
        self._as: dict[type, np.ndarray] = {np.float64: self.rows}

    def held(self, kind: type) -> np.ndarray:
        """The rows in numbers of this kind; plain integers of any size where no float is exact."""
        if kind not in self._as:
            self._as[kind] = np.array([[int(x) for x in r] for r in self.rows], object).reshape(self.rows.shape) if kind is object else self.rows.astype(kind)
        return self._as[kind]


def exact_kind(queries: np.ndarray, blocks: Blocks) -> type:
    largest = float(np.abs(queries).sum(axis=1).max(initial=0.0)) * blocks.peak
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


def best_of(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each owner, by score and id, sorted by owner."""
    order = np.lexsort((ids, ~scores, owner))
    first = np.flatnonzero(np.r_[True, np.diff(owner[order]) > 0]) if len(order) else order
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[nth < k]


def limits(entries: Entries, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of each query's k-th entry; without one, what every row exceeds."""
    owner, scores, ids, _ = entries
    last = np.cumsum(np.bincount(owner, minlength=n)) - 1
    full = np.bincount(owner, minlength=n) >= k
    kth, kth_id = np.full(n, -np.inf), np.full(n, _NO_ID)
    kth[full], kth_id[full] = scores[last[full]], ids[last[full]]
    return kth, kth_id


def products(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if rows.dtype != object:
        return asked @ rows.T
    return np.array([[min(max(sum(map(int.__mul__, q, r)), _LONG.min), _LONG.max) for r in rows] for q in asked], object).astype(np.int64).reshape(len(asked), len(rows))


def searched(blocks: Blocks, q_ids: np.ndarray, queries: np.ndarray, own: np.ndarray, entries: Entries, k: int) -> Entries:
    """The k best of ``entries`` and of the rows of all blocks, but for those of a query's ``own`` shard."""
    queries = widened(queries[:, : blocks.dim], blocks.dim)  # what the blocks lack is zero
    kind = exact_kind(queries, blocks)
    n, n_blocks = len(queries), len(blocks.least_id)
    if kind is object:
        asked, bound = np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape), np.full((n, n_blocks), np.inf)
    else:
        asked, bound = queries.astype(kind), np.maximum(queries, 0) @ blocks.most.T + np.minimum(queries, 0) @ blocks.least.T
    rows = blocks.held(kind)
    bound[blocks.shard[None, :] == own[:, None]] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    done, step = 0, 1
    while done < n_blocks:
        kth, kth_id = limits(entries, n, k)
        turn = order[:, done : done + step]
        reach = np.take_along_axis(bound, turn, axis=1)
        wanted = (reach > kth[:, None]) | ((reach == kth[:, None]) & (reach > -np.inf) & (blocks.least_id[turn] < kth_id[:, None]))
        if not wanted.any():  # later blocks have lower bounds, or as low ones
            if not (reach == kth[:, None]).any():
                break
            done += step
            continue
        who, nth = np.nonzero(wanted)
        block = turn[who, nth]
        by = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(block[by]) > 0, True])
        found = [entries]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, q = block[by[a]], who[by[a:b]]
            lo, hi = blocks.start[at], blocks.start[at + 1]
            here, score = blocks.ids[lo:hi], products(asked[q], rows[lo:hi])
            fine = np.ones(score.shape, bool)
            place = np.searchsorted(here, q_ids[q])
            while len(hit := np.flatnonzero((place < hi - lo) & (here[np.minimum(place, hi - lo - 1)] == q_ids[q]))):
                fine[hit, place[hit]] = False
                place[hit] += 1
            fine &= score >= kth[q][:, None]
            if hi - lo > k + 1 and fine.sum() > 2 * k * len(q):  # the k best of the block itself, and one for the query's own row
                fine &= score >= np.partition(score, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1][:, None]
            i, j = np.nonzero(fine)
            value = score[i, j].astype(np.int64)
            soon = (value > kth[q[i]]) | (here[j] < kth_id[q[i]])
            i, j, value = i[soon], j[soon], value[soon]
            found.append((q[i], value, here[j], np.ones(len(i), bool)))
        entries = tuple(np.concatenate([f[c] for f in found]) for c in range(4))
        best = best_of(*entries[:3], k)
        entries = tuple(c[best] for c in entries)
        done, step = done + step, step * 2
    return entries


def _rows(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(ids, "<i8")
    return key, unpacked(vecs, dim) if dim else np.zeros((len(key), 0))


def _first(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shards -> tiles: the queries of a shard, each with its best k within it."""
    nothing = np.zeros(0, np.int64)
    for batch in batches:
        for shard, dim, ids, asks, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine = np.flatnonzero(np.frombuffer(asks, bool))
            blocks = Blocks([(shard, *_rows(ids, vecs, dim))]) if len(mine) else None
            for a in range(0, len(mine), TILE):
                q = mine[a : a + TILE]
                owner, scores, found, _ = searched(blocks, blocks.ids[q], blocks.rows[q], np.full(len(q), -1), (nothing, nothing, nothing, nothing.astype(bool)), k)
                yield pa.RecordBatch.from_arrays([[shard], pa.array([dim], pa.int32()), [blocks.ids[q].astype("<i8").tobytes()], [packed(blocks.rows[q])], [np.stack([owner, scores, found]).astype("<i8").tobytes()]], schema=_TILES)


def _top(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(3, -1)


def _answers(q_ids: np.ndarray, owner: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids[owner], pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(scores, pa.int64())], schema=_ANSWERS)


def _of_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield _answers(np.frombuffer(ids, "<i8"), *_top(top))


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of one cell after the other (cell, slice, kind, shard, dim, ids, vecs, top): the shards of the group, then tiles."""
    cell, shards, blocks, waiting = None, [], None, []

    def flush() -> pa.RecordBatch:
        dim = max(v.shape[1] for _, _, v, _ in waiting)
        sizes = [len(i) for _, i, _, _ in waiting]
        q_ids = np.concatenate([i for _, i, _, _ in waiting])
        shift = np.repeat(np.cumsum([0, *sizes[:-1]]), [t.shape[1] for *_, t in waiting])
        top = np.concatenate([t for *_, t in waiting], axis=1)
        entries = (top[0] + shift, top[1], top[2], np.zeros(top.shape[1], bool))
        owner, scores, ids, fresh = searched(blocks, q_ids, np.concatenate([widened(v, dim) for _, _, v, _ in waiting]), np.repeat([s for s, *_ in waiting], sizes), entries, k)
        return _answers(q_ids, owner[fresh], scores[fresh], ids[fresh])

    for batch in batches:
        for group, part, kind, shard, dim, ids, vecs, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, part) != cell:
                if waiting:
                    yield flush()
                cell, shards, blocks, waiting = (group, part), [], None, []
            if kind == 0:
                shards.append((shard, *_rows(ids, vecs, dim)))
                continue
            if shards:
                blocks, shards = Blocks(shards), []
            if blocks is None:  # a group without shards
                continue
            waiting.append((shard, *_rows(ids, vecs, dim), _top(top)))
            if sum(len(i) for _, i, _, _ in waiting) >= TILE:
                yield flush()
                waiting = []
    if waiting:
        yield flush()


def search(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row of which ``asks`` holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    vec = F.col(vector_col).cast("array<double>")
    key = F.col(id_col).cast("long")
    whole = vectors.select(key.alias("id"), (F.coalesce(asks, F.lit(False)) & key.isNotNull()).alias("asks"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x * F.lit(scale)) < F.lit(float("inf"))))  # NaN is above infinity
    whole = whole.where(F.col("vec").isNotNull() & fine)
    sample = [r[0] for r in whole.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vec").collect()]
    pivots = chained(np.unique(stacked(scaled(sample, scale)), axis=0)) if sample else np.zeros((1, 0))
    placed = whole.mapInArrow(lambda it: _placed(it, pivots, scale), "pivot int, id long, asks boolean, vec binary")
    ranged = placed.repartitionByRange("pivot", "id", "vec").sortWithinPartitions("pivot", "id", "vec")
    index = stage(ranged.mapInArrow(_shards, "shard long, dim int, ids binary, asks binary, vecs binary"), "shards")
    tiles = stage(index.mapInArrow(lambda it: _first(it, k), "shard long, dim int, ids binary, vecs binary, top binary"), "tiles")
    held, asking = (t.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0] for t, c in ((index, "vecs"), (tiles, "ids")))
    # groups of shards that a task can hold, and slices of queries that it can get through; as many tasks as there are cores, at least
    n_groups = max(-(-held // GROUP_BYTES), spark.sparkContext.defaultParallelism)
    n_slices = -(-asking // (8 * SLICE)) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = index.select(F.pmod(F.xxhash64("shard"), F.lit(n_groups)).cast("long").alias("cell"), each(n_slices).alias("slice"), F.lit(0).alias("kind"), "shard", "dim", "ids", "vecs", F.lit(None).cast("binary").alias("top"))
    asked = tiles.select(each(n_groups).alias("cell"), F.pmod(F.xxhash64("shard"), F.lit(n_slices)).cast("long").alias("slice"), F.lit(1).alias("kind"), "shard", "dim", "ids", "vecs", "top")
    cells = rows.unionByName(asked).repartition(n_groups * n_slices, "cell", "slice").sortWithinPartitions("cell", "slice", "kind")
    others = cells.mapInArrow(lambda it: _met(it, k), "query_id long, vec_id long, score long")
    first = tiles.select("ids", "top").mapInArrow(_of_first, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return first.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
