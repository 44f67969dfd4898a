"""Exact deduplication by Grace hashing.

1. Each map task folds the rows it reads into an open-addressing table (a ``dict``, whose probes
   compare complete contents) of bounded size, each entry counted with a fixed cost: equal texts of one task become one *record*. So a
   text that a third of all rows share reaches the shuffle once a task, not once a row.
2. Records are dealt into buckets by the hash of their digest. A bucket whose contents are larger
   than ``bucket_bytes`` is dealt again by another hash, and so on until each fits or holds one
   text only. The recursion runs on the sizes, so that contents move once, to their last bucket;
   the spill files are Spark's shuffle files.
3. Each bucket goes through an open-addressing table that compares complete contents.

Defined cases: a null text counts as empty. A null id is larger than any other. Of rows that share
both id and text, one stays. An empty table gives an empty table. Other columns of the input are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage, utf8

#: What an entry of a table, with its record, takes beside its content.
ENTRY_BYTES = 1024
#: Bytes of entries that a map task's table holds before its records go out.
COMBINE_BYTES = 16 << 20
#: Bytes of entries in a bucket's table.
BUCKET_BYTES = 8 << 20
#: Buckets that one too large is dealt into at each further level.
FANOUT = 16

_ROWS = pa.schema(
    [("uid", pa.int64()), ("rec", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("content", pa.large_binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64())]
)
_ROWS_SQL = "uid long, rec long, doc_id long, digest string, size long, content binary, n long, keep_id long, keep_uid long"
_VERDICTS = pa.schema([("rec", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_uid", pa.int64())])


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space; ``bytes.split`` knows just the six characters meant."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return b" " * text[:1].isspace() + out + b" " * text[-1:].isspace()


def _first(a: tuple, b: tuple) -> tuple:
    """Of two (id, uid), the one that stays."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _combine(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    uid = rec = TaskContext.get().partitionId() << 40
    found: dict[bytes, list] = {}
    size = 0

    def records() -> Iterator[pa.RecordBatch]:
        entries = iter(found.items())
        while rows := [{"rec": r, "digest": d, "size": len(c) + ENTRY_BYTES, "content": c, "n": n, "keep_id": k[0], "keep_uid": k[1]} for c, (r, d, n, k) in islice(entries, 1000)]:
            yield pa.RecordBatch.from_pylist(rows, _ROWS)

    for batch in batches:
        members = []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            content = normalise(text)
            entry = found.get(content)
            if entry is None:
                entry = found[content] = [rec, hashlib.sha256(content).hexdigest(), 0, (doc_id, uid)]
                rec, size = rec + 1, size + len(content) + ENTRY_BYTES
            entry[2] += 1
            entry[3] = _first(entry[3], (doc_id, uid))
            members.append({"uid": uid, "rec": entry[0], "doc_id": doc_id, "digest": entry[1]})
            uid += 1
        yield pa.RecordBatch.from_pylist(members, _ROWS)
        if size > limit:
            yield from records()
            found, size = {}, 0
    yield from records()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: rec, path, content, n, keep_id, keep_uid."""
    path, groups, recs = None, {}, []

    def verdicts() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"rec": r, "keep_id": g[1][0], "group_size": g[0], "keep_uid": g[1][1]} for r, g in recs], _VERDICTS)

    for batch in batches:
        for rec, at, content, n, keep_id, keep_uid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != path:
                if recs:
                    yield verdicts()
                path, groups, recs = at, {}, []
            group = groups.get(content)
            if group is None:
                group = groups[content] = [0, (keep_id, keep_uid)]
            group[0] += n
            group[1] = _first(group[1], (keep_id, keep_uid))
            recs.append((rec, group))
    if recs:
        yield verdicts()


def _deal(level: int, fanout: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col("digest")), F.lit(fanout)).cast("string")


def deal(records: DataFrame, bucket_bytes: int, fanout: int = FANOUT) -> DataFrame:
    """Adds each record's bucket, ``path``: level after level, until each bucket fits or holds one digest.

    A level's too large buckets are found by their sizes and joined to the records; where none is
    too large, as is usual, the first level's hash is all there is.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    path = _deal(0, 2 * total // bucket_bytes + 1)
    level, dealt = 0, records.withColumn("path", path)
    while True:
        sizes = dealt.groupBy("path").agg(F.sum("size").alias("bytes"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        large = stage(sizes.where((F.col("bytes") > bucket_bytes) & (F.col("a") != F.col("b"))).select("path", F.lit(True).alias("large")), "grace-large")
        if large.isEmpty():
            return dealt
        level += 1
        deeper = F.concat_ws("/", "path", _deal(level, fanout))
        dealt = dealt.join(large, "path", "left").withColumn("path", F.when(F.col("large"), deeper).otherwise(F.col("path"))).drop("large")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = stage(rows.mapInArrow(lambda it: _combine(it, combine_bytes), _ROWS_SQL), "grace-rows")
    members = staged.where("uid IS NOT NULL").select("uid", "rec", "doc_id", F.col("digest").alias("text_sha256"))
    records = staged.where("uid IS NULL").select("rec", "digest", "size", "content", "n", "keep_id", "keep_uid")
    dealt = deal(records, bucket_bytes)
    verdicts = dealt.select("rec", "path", "content", "n", "keep_id", "keep_uid").repartition("path").sortWithinPartitions("path").mapInArrow(_resolve, "rec long, keep_id long, group_size long, keep_uid long")
    return members.join(verdicts, "rec").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
