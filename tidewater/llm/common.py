"""What the corpus operators share: tables, the shared folder, and small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none and all runs in one process (tests), a folder of the warehouse is set for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidewater"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, and survives lost executors.

    ``within`` is the folder of a ``scratch``, for tables that later steps don't need.
    """
    spark = df.sparkSession
    path = f"{within or shared_dir(spark) + '/stage'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of the shared folder that is deleted at the end, with all that was staged within."""
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds what Spark hands to Python workers at once in bytes, unless the session already does.

    Without it a batch is 10,000 rows, whatever their length.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; forgets all when it holds too many."""

    def __init__(self, seed: int = 0, most: int = 200_000) -> None:
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash, modulo 2 to the 64, of each ``width`` consecutive words.

    Built from the hashes of windows of 1, 2, 4, ... words.
    """
    n = len(words) - width + 1
    if n < 1:
        return words[:0]
    with np.errstate(over="ignore"):
        out, done, power, span = None, 0, words, 1
        rest = width
        while rest:
            if rest & 1:
                piece = power[done : done + n]
                out = piece if out is None else out * np.uint64(pow(base, span, 1 << 64)) + piece
                done += span
            rest >>= 1
            if rest:
                power = power[:-span] * np.uint64(pow(base, span, 1 << 64)) + power[span:]
                span *= 2
        return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def version_of(text_col: str) -> Column:
    """A hash of the text, which tells rows apart that share an id."""
    return F.xxhash64(text_or_empty(text_col))


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, version) is in ``chosen``, with all their columns."""
    of, version = unused(docs, "_of"), unused(docs, "_version")
    wanted = chosen.select(F.col("doc_id").alias(of), F.col("version").alias(version)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(of)) & (version_of(text_col) == F.col(version))
    return docs.join(wanted.hint("shuffle_hash"), same, "left_semi")
