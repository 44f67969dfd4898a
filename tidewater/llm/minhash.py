"""Near-duplicate search by MinHash, and connected components.

1. A pass over the texts takes each document's set of word shingles as 64-bit hashes, and from it
   ``bands * rows`` minima of universal hash functions (multiply-shift), the buckets of the bands,
   and one byte of each minimum as the signature. With the standard 40 bands of 7 rows a pair of
   similarity 0.8 is missed with a probability of 8e-5, one of 0.85 with 2e-7; one of 0.5 meets in a
   bucket with 0.27.
2. Documents of equal sets are one class, found by the digest of the set with partial aggregation;
   only the class goes on. So exact copies make no pairs.
3. In each bucket the member with most neighbours in all its buckets is the centre: in a group of
   near copies, one with few edits. A member is compared with the centre of most of its buckets, and
   what is linked by then is put into components; then with its other centres of other components.
   That is at most one pair for each class and bucket, whatever the size of groups.
4. Buckets that hold more than one component by then are *mixed*. All pairs of their members that can
   be linked at all are found exactly: shingles are ordered by how many of these members hold them,
   rare ones first. Two sets that are similar enough must share one of the first fifth of each, and
   from the first one that they share on, enough must be left in both. So members of a large group of
   near copies that have edits of their own aren't compared with the group.
5. A compared pair must agree in its signatures to within about five standard deviations of the
   threshold; only then full sets are sent and compared.
6. Components come from alternating large-star and small-star steps.

No pair is dropped by a cap or a sample: what 3. doesn't compare is left to 4.

Defined cases: null texts count as empty; a text without words has no shingles and is linked with
nothing. One of fewer words than a shingle has is one shingle. Rows that share an id are judged one
by one. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, scramble, scratch, stage, text_or_empty, utf8, window_hashes

BANDS, ROWS = 40, 7
_BASE = 0x9E3779B97F4A7C15
_SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_SETS_SQL = "uid long, doc_id long, version long, n_shingles long, digest binary, signature binary, buckets array<long>"


def shingle_set(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """The sorted hashes of the distinct ``size``-word shingles, A-Z lower-cased."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return words
    width = min(size, len(words))
    return np.unique(scramble(window_hashes(words, width, _BASE) + np.uint64(width)))


class Minima:
    """Minima of universal hash functions over sets, as signature bytes and buckets."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def of(self, shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
        upper = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 2**32 - 1, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(upper), 512):
                hashed = upper[at : at + 512, None] * self.a
                hashed += self.b
                np.minimum(least, hashed.min(0), out=least)
            band = np.arange(self.bands, dtype=np.uint64)
            for column in least.reshape(self.bands, self.rows).T:
                band = scramble(band + column)
        return (least >> np.uint32(24)).astype(np.uint8).tobytes(), band.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes, minima = WordHashes(), Minima(bands, rows)
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        sizes, digests, signatures, buckets = [], [], [], []
        for text in utf8(batch.column(2)):
            shingles = shingle_set(text, hashes, size)
            signature, found = minima.of(shingles) if len(shingles) else (None, None)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signatures.append(signature)
            buckets.append(found)
        uids = np.arange(uid, uid + batch.num_rows, dtype=np.int64)
        uid += batch.num_rows
        columns = [pa.array(uids), batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip((sizes, digests, signatures, buckets), list(_SETS)[3:], strict=True))]
        yield pa.RecordBatch.from_arrays(columns, schema=_SETS)


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes, size).tobytes() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch], percent: int, n_minima: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, signature, signature) the pairs whose signatures agree closely enough."""
    share = percent / 100
    least = share - 5 * (share * (1 - share) / n_minima) ** 0.5
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n_minima) for i in (2, 3))
        fit = pa.array((left == right).mean(1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(fit) for i in (0, 1)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set, set) the pairs that are similar enough."""
    for batch in batches:
        fit = []
        for i in range(batch.num_rows):
            left, right = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
            common = len(np.intersect1d(left, right, assume_unique=True))
            fit.append(100 * common >= percent * (len(left) + len(right) - common))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(fit, pa.bool_())) for i in (0, 1)], names=["a", "b"])


def _sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``a, b`` and what ``of`` (node, column) has of each."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, n_minima: int) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``percent``: by signature, then on full sets."""
    alike = _sides(pairs, nodes, "signature").mapInArrow(lambda it: _alike(it, percent, n_minima), "a long, b long")
    return _sides(alike, sets, "shingles").mapInArrow(lambda it: _confirm(it, percent), "a long, b long")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the least of them; needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    links = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (a, b), root being the least node reachable.

    Large-star and small-star steps by turns until a turn changes nothing; then all is stars.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    with scratch(links.sparkSession, "stars") as folder:
        edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", folder)
        before = mark(edges)
        while before[0]:
            edges = stage(small_star(large_star(edges)), "edges", folder)
            after = mark(edges)
            if after == before:
                break
            before = after
        return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), "roots")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) for x in sets])
        for at in range(0, len(sets), 500):
            part = slice(at, at + 500)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets[part])), *(pa.array(np.repeat(x[part], sizes[part])) for x in (nodes, sizes))], names=["token", "node", "size"])


def star_pairs(buckets: DataFrame, folder: str) -> DataFrame:
    """``a, b, nth``: each member of ``buckets`` (bucket, node, n) with the centres of its buckets, 1 being that of most of them."""
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    heaviest = F.min(F.struct(-F.col("weight"), "node")).alias("heaviest")
    # written, so that the join has exchanges of its own and Spark can split a bucket that many nodes share
    centres = stage(buckets.join(weights, "node").groupBy("bucket").agg(heaviest).select("bucket", F.col("heaviest.node").alias("centre")), "centres", folder)
    met = buckets.join(centres, "bucket").where("node <> centre").repartition("node").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "centre"))
    return met.select(F.col("node").alias("a"), F.col("centre").alias("b"), nth.alias("nth"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b").select("a", "b")


def mixed_members(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` of the members of buckets that hold more than one component."""
    rooted = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return rooted.join(mixed, "bucket", "left_semi").select("node", "root").distinct()


def prefixes(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, root, size, left``: the rarest shingles of each of ``live`` (node, root).

    ``left`` is how many shingles a set has from there on. Shingles that no other has are passed over;
    of the rest as many are taken as leave ``percent`` of the set.
    """
    held = sets.join(live.select("node"), "node", "left_semi").select("node", "shingles").mapInArrow(_tokens, "token long, node long, size long")
    shared = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = Window.partitionBy("node")
    left = (F.count(F.lit(1)).over(whole) - F.row_number().over(whole.orderBy("n", "token")) + 1).alias("left")
    placed = held.join(shared, "token").select("token", "node", "size", left)
    return placed.where(100 * F.col("left") >= percent * F.col("size")).join(live, "node")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of different components among ``prefixes`` that can be linked."""
    other = rows.select("token", *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "size", "left")))
    total = F.col("size") + F.col("o_size")
    enough = (100 + percent) * F.least("left", "o_left") >= percent * total
    near = 100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size")
    met = rows.join(other, (rows["token"] == other["token"]) & (F.col("node") < F.col("o_node")) & (F.col("root") != F.col("o_root")) & near & enough)
    return met.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def linked(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, n_minima: int, folder: str) -> DataFrame:
    """``node, root`` of all nodes that are linked with another; see 3. to 6. above."""
    stars = stage(star_pairs(buckets, folder), "stars", folder)
    links = stage(confirmed(stars.where("nth = 1").select("a", "b"), nodes, sets, percent, n_minima), "links", folder)
    links = links.union(stage(confirmed(apart(stars.where("nth > 1"), components(links)), nodes, sets, percent, n_minima), "links", folder))
    live = stage(mixed_members(buckets, components(links)), "live", folder)
    rows = stage(prefixes(live, sets, percent), "prefixes", folder)
    rest = stage(confirmed(prefix_pairs(rows, percent), nodes, sets, percent, n_minima), "links", folder)
    return components(links.union(rest))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row: ``doc_id, version, n_shingles, component_id, group_id``.

    ``version`` is a hash of the text, ``component_id`` the least id of the group. ``group_id`` tells
    groups apart also where rows share an id or have none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    clean = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(clean).alias("version"), clean.alias("text"))
    with scratch(spark, "near") as folder:
        whole = stage(base.mapInArrow(lambda it: _signed(it, shingle, bands, rows), _SETS_SQL), "signatures", folder)
        # of a class, the row of the least uid stands for it
        stands = F.min(F.struct("uid", "doc_id", "version", "signature", "buckets")).alias("rep")
        classes = stage(whole.where("n_shingles > 0").groupBy("digest").agg(stands, F.min("doc_id").alias("least_id")).select("digest", F.col("rep.uid").alias("node"), "least_id", "rep.doc_id", "rep.version", "rep.signature", "rep.buckets"), "classes", folder)
        dealt = classes.select(F.explode("buckets").alias("bucket"), "node")
        shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        buckets = stage(dealt.join(shared, "bucket"), "buckets", folder)
        nodes = stage(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "version", "signature"), "nodes", folder)
        wanted = nodes.select("node", F.col("doc_id").alias("_d"), F.col("version").alias("_v")).hint("shuffle_hash")
        texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v"))).select("node", "text")
        sets = stage(texts.mapInArrow(lambda it: _full_sets(it, shingle), "node long, shingles binary").dropDuplicates(["node"]), "sets", folder)
        roots = linked(buckets, nodes, sets, percent, bands * rows, folder)
        members = classes.select("digest", "node", "least_id").join(roots, "node", "left")
        least = stage(members.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("component_id")), "least", folder)
        labels = members.join(least, "root", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
        out = whole.select("uid", "doc_id", "version", "n_shingles", "digest").join(labels, "digest", "left")
        alone = F.col("root").isNull()
        return stage(out.select("doc_id", "version", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "uid").alias("group_id")), "near")
