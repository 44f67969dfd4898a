"""Substring deduplication: windows of ``width`` words that also start earlier lose their words.

Earlier means in a document of smaller id, or at an earlier place of the same document.

1. Documents of equal word sequences: all but the first lose every word that a window covers, that
   is all of them, from ``width`` words on. They are found by a digest and take no further part.
2. A window can only repeat if its minimizer does, the ``GRAM``-word run in it of the least hash.
   Minimizers are about a tenth of all runs; their hashes are counted in Spark, and windows of
   minimizers that occur once are out. This is exact: equal windows have equal minimizers.
3. The windows left over are hashed (Rabin-Karp, 64 bits, compared under one 64-bit minimizer only)
   and, by hash and place, all but the first of equal windows are marked. Neighbours that share a
   minimizer are shuffled as one row. Equal windows within one batch of documents are found before
   the shuffle, and one of them goes on, so that a passage in a third of all documents reaches a
   task once for each batch and not once for each document.
4. The marked windows of a document merge into maximal intervals, whose words go.

Defined cases: a null text has no words. Rows that share id and text are one document, and each row
comes out; of rows that share an id only, the one with the smaller hash of its text counts as
earlier. A null id is above all others. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, scramble, stage, text_or_empty, utf8, window_hashes

GRAM = 3
#: Words of the documents that are looked at together.
CHUNK = 2_000_000
_BASE_1, _BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_DOC = [("doc_id", pa.int64()), ("version", pa.int64())]
_DIGESTS = pa.schema([*_DOC, ("n_words", pa.int64()), ("digest", pa.binary())])
_GRAMS = pa.schema([("gram", pa.int64()), ("repeats", pa.bool_()), *_DOC, ("start", pa.int32()), ("end", pa.int32())])
_RUNS = pa.schema([("gram", pa.int64()), *_DOC, ("start", pa.int32()), ("n", pa.int32()), ("windows", pa.list_(pa.int64()))])


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, version, words, ...) of up to ``CHUNK`` words, by id and version, nulls last; rows that share both come once."""
    rows: dict[tuple, tuple] = {}
    size = 0
    for batch in batches:
        for d, v, text, *rest in zip(*(c.to_pylist() for c in batch.columns[:2]), utf8(batch.column(2)), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
            words = text.split()
            rows[d is None, d or 0, v] = (d, v, words, *rest)
            size += len(words)
            if size > CHUNK:
                yield [rows[k] for k in sorted(rows)]
                rows, size = {}, 0
    if rows:
        yield [rows[k] for k in sorted(rows)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [t.split() for t in utf8(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([digest_of(w) for w in words], pa.binary())], schema=_DIGESTS)


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` consecutive values, leftmost on ties, by doubling."""
    place, width = np.arange(len(values)), 1
    while 2 * width <= span:
        left, right = place[:-width], place[width:]
        place = np.where(values[right] < values[left], right, left)
        width *= 2
    if width < span:
        left, right = place[: len(values) - span + 1], place[span - width :]
        place = np.where(values[right] < values[left], right, left)
    return place


def minimizers(words: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer, in texts laid end to end: (document, hash, place, first window, last + 1).

    Places and windows count from the document's start.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    grams = scramble(window_hashes(words, gram, _BASE_1))
    place = sliding_least(grams, width - gram + 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(place)]
    valid = np.arange(len(place)) + width <= ends[owner]
    first = np.flatnonzero(valid & np.r_[True, ~valid[:-1] | (place[1:] != place[:-1])])
    count = np.diff(np.r_[np.cumsum(valid)[first] - 1, valid.sum()])
    doc = owner[first]
    return doc, grams[place[first]], place[first] - starts[doc], first - starts[doc], first - starts[doc] + count


def _joined(hashes: WordHashes, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([hashes.of(r[2]) for r in rows]), np.array([len(r[2]) for r in rows], np.int64)


def _keys(rows: list[tuple], doc: np.ndarray) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], pa.int64()).take(pa.array(doc)) for i in (0, 1)]


def _grams(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows in _chunks(batches):
        one_each = {digest_of(r[2]): r for r in reversed(rows) if len(r[2]) >= width}
        rows = list(one_each.values())
        if not rows:
            continue
        doc, h, place, first, end = minimizers(*_joined(hashes, rows), width, gram)
        kinds, at, n = np.unique(h, return_inverse=True, return_counts=True)
        again = n[at] > 1  # found twice here already: candidates, and one bare row tells the others
        bare = pa.array(kinds[n > 1].view(np.int64))
        none = pa.nulls(len(bare))
        own = np.where(again, scramble(h + place.astype(np.uint64) + np.uint64(1)), h)  # candidates already meet nothing, so that they don't pile up
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(again), *_keys(rows, doc), pa.array(first, pa.int32()), pa.array(end, pa.int32())], schema=_GRAMS)
        yield pa.RecordBatch.from_arrays([bare, pa.array(np.ones(len(bare), bool)), *(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], schema=_GRAMS)


def _runs(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, version, words, spans) -> runs of neighbouring windows with one minimizer and, unless they repeat here already, their hashes."""
    hashes = WordHashes()
    for rows in _chunks(batches):
        words, lengths = _joined(hashes, rows)
        begins = np.cumsum(lengths) - lengths
        spans = [(d, s["start"], s["end"]) for d, r in enumerate(rows) for s in r[3]]
        span_doc, start, end = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        start, n = begins[span_doc] + start, end - start
        grams = np.r_[scramble(window_hashes(words, gram, _BASE_1)), np.uint64(0)]
        key = np.minimum.reduceat(grams, np.stack([start, start + width - gram + 1], 1).ravel())[::2]
        span = np.repeat(np.arange(len(n)), n)
        at = start[span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        h = scramble(window_hashes(words, width, _BASE_2))[at]
        order = np.lexsort((at, h))
        again = np.zeros(len(at), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        first = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (again[1:] != again[:-1])])
        count = np.diff(np.r_[first, len(at)])
        known, doc = again[first], span_doc[span[first]]
        # those known to repeat only have to come through: under a key of their own they meet nothing
        own = np.where(known, scramble(key[span[first]] + at[first].astype(np.uint64) + np.uint64(1)), key[span[first]])
        sizes = np.where(known, 0, count)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(h[~again].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *_keys(rows, doc), pa.array(at[first] - begins[doc], pa.int32()), pa.array(count, pa.int32()), lists], schema=_RUNS)


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows at ``starts`` (sorted) cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist(), strict=True))


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts, copy in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            left, at = [], 0
            for start, end in intervals(np.unique(starts or []).astype(np.int64), width) if not copy else [(0, len(words))]:
                left += words[at:start]
                at = end
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("version").asc()]


def repeated_windows(base: DataFrame, width: int, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(copies, starts) of ``base`` (doc_id, version, text).

    ``copies``: doc_id, version of documents whose words are, all in all, an earlier document's.
    ``starts``: doc_id, version and the array of starts of repeated windows, for the others.
    """
    digests = stage(base.mapInArrow(_digests, "doc_id long, version long, n_words long, digest binary"), "digests").where(F.col("n_words") >= width)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    # written, so that the join has exchanges of its own and Spark can split a digest that many documents have
    first = stage(digests.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    copies = stage(digests.join(first, "digest").where(place != F.col("first")).select("doc_id", "version").distinct(), "copies")
    grams = base.mapInArrow(lambda it: _grams(it, width, gram), "gram long, repeats boolean, doc_id long, version long, start int, end int")
    same = Window.partitionBy("gram")
    known = F.max("repeats").over(same) | (F.min("version").over(same) != F.max("version").over(same)) | (F.min("start").over(same) != F.max("start").over(same))
    spans = grams.withColumn("known", known).where("known AND start IS NOT NULL").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    match = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("version") == F.col("_version"))
    spans = spans.join(copies.withColumnsRenamed({"doc_id": "_of", "version": "_version"}), match, "left_anti")
    wanted = base.join(spans.withColumnsRenamed({"doc_id": "_of", "version": "_version"}).hint("shuffle_hash"), match).select("doc_id", "version", "text", "spans")
    runs = wanted.mapInArrow(lambda it: _runs(it, width, gram), "gram long, doc_id long, version long, start int, n int, windows array<long>").repartition("gram")
    # a window's hash is only compared under its minimizer's; where there are no hashes, the run is known to repeat
    windows = runs.select("gram", "doc_id", "version", "start", F.posexplode(F.when(F.size("windows") > 0, F.col("windows")).otherwise(F.expr("array_repeat(cast(null AS long), n)"))).alias("pos", "h"))
    windows = windows.select("gram", "h", "doc_id", "version", (F.col("start") + F.col("pos")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("gram", "h").orderBy(*_order(), "start"))
    marked = windows.withColumn("nth", nth).where("h IS NULL OR nth > 1")
    return copies, marked.groupBy("doc_id", "version").agg(F.collect_list("start").alias("starts"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """A row for each row: ``doc_id, n_words, n_removed, kept_text``."""
    bound_batches(docs.sparkSession)
    clean = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(clean).alias("version"), clean.alias("text"))
    copies, starts = repeated_windows(base, width)
    marks = starts.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "version", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    marks = marks.withColumnsRenamed({"doc_id": "_of", "version": "_version"}).hint("shuffle_hash")
    joined = base.join(marks, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("version") == F.col("_version")), "left")
    return joined.select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(lambda it: _kept(it, width), "doc_id long, n_words long, n_removed long, kept_text string")
