"""Importance resampling: documents drawn by how much likelier their words are in a target text.

1. Each batch of texts goes through DuckDB in its task: words are unnested, windows over them make
   the runs of 1 to ``longest`` words, a registered function gives the CRC-32 of each, and counts by
   text and bucket come out. They are written as Parquet, a row a text, for both tables.
2. Spark adds up the buckets, on the map side first, and gives each bucket its gain, the logarithm
   of target against raw likelihood in thousandths. There are ``buckets`` gains, whatever the input.
3. A text's weight is the sum of gains over its counts. Its score adds the noise of its id, so that
   the best scores are a draw without replacement.
4. Scores are ordered by ranges. A row's rank is its place in its range, after the rows of the ranges
   before; no task sees all rows.

Defined cases: a null text has no words, a null id counts as empty in the noise and comes last among
equal scores. Every row is a document, repeated rows too; they have equal scores and neighbouring
ranks. An empty target gives every feature of the raw texts the gain of a count of none. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stage, text_or_empty
from .source_divergence import LOWER, UPPER

#: Digits, letters A-Z and a-z, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one statement reads.
PIECE = 2 << 20
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _crc(grams: pa.ChunkedArray) -> pa.Array:
    """CRC-32 of each text, read in place."""
    out, crc = [], zlib.crc32
    for chunk in grams.cast(pa.large_binary()).chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        held, start = chunk.buffers()[2].to_pybytes() if chunk.buffers()[2] else b"", at[0]
        for end in at[1:]:
            out.append(crc(held[start:end]))
            start = end
    return pa.array(np.array(out, np.int64))


def _statement(buckets: int, longest: int) -> str:
    """Words stay in the order of their texts, so that the windows need no sort; a run ends with its text."""
    runs, grams = [], ["word"]
    for n in range(1, longest):
        runs.append(f"CASE WHEN lead(nr, {n}) OVER () = nr THEN lead(word, {n}) OVER () END AS word{n}")
        grams.append(" || ' ' || ".join(["word", *(f"word{i}" for i in range(1, n + 1))]))
    return f"""
WITH texts AS (
  SELECT nr, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM batch
), words AS (
  SELECT nr, unnest(words) AS word FROM texts
), windows AS (
  SELECT {", ".join(["nr", "word", *runs])} FROM words
), grams AS (
  SELECT nr, unnest([{", ".join(grams)}]) AS gram FROM windows
), counted AS (
  SELECT nr, CAST(crc(gram) % {buckets} AS INTEGER) AS bucket, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL
), listed AS (
  SELECT nr, list(n * {buckets} + bucket) AS held, CAST(sum(n) AS BIGINT) AS n_features FROM counted GROUP BY nr
)
SELECT nr, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(held, []) AS held FROM texts LEFT JOIN listed USING (nr) ORDER BY nr
"""


def _pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``PIECE`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < rows.num_rows:
        end = max(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE)), start + 1)
        yield rows.slice(start, end - start)
        start = end


def _counted(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    statement = _statement(buckets, longest)
    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as engine:  # a piece is small enough for memory
        engine.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        for rows in (piece for batch in batches for piece in _pieces(batch)):
            batch = pa.table({"nr": np.arange(rows.num_rows), "text": rows.column(1)})
            engine.register("batch", batch)
            found = engine.sql(statement).to_arrow_table()
            engine.unregister("batch")
            held = found.column("held").combine_chunks().cast(pa.list_(pa.int64()))
            both, at = held.flatten().to_numpy(), held.offsets
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in ((both % buckets).astype(np.int32), both // buckets)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(found.column(c).combine_chunks().cast(pa.int64()) for c in ("n_words", "n_features")), *lists], schema=_COUNTS)


def bucket_counts(rows: DataFrame, id_col: str, text_col: str, buckets: int, longest: int, name: str) -> DataFrame:
    """``doc_id, n_words, n_features, buckets, counts``, written to the shared folder."""
    base = rows.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stage(base.mapInArrow(lambda it: _counted(it, buckets, longest), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"), name)


def bucket_sums(counts: DataFrame) -> DataFrame:
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("of")).groupBy(F.col("of.buckets").alias("bucket")).agg(F.sum("of.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row, ``gains``: the gain of each bucket in thousandths, at the bucket's place."""
    spark = raw.sparkSession
    totals = [c.agg(F.coalesce(F.sum("n_features"), F.lit(0)).cast("double")).first()[0] for c in (raw, target)]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(totals[0] + buckets) / ((s + 1) * F.lit(totals[1] + buckets))
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(bucket_sums(raw).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_sums(target).withColumnRenamed("n", "t"), "bucket", "left")
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    return both.select("bucket", gain.alias("gain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda e: e["gain"]).alias("gains"))


def noise(id_col: str, seed: int) -> Column:
    """A Gumbel variable of the id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: of the N documents of ``min_words`` words or more, the best floor(percent * N / 100) have a rank."""
    bound_batches(docs.sparkSession)
    raw = bucket_counts(docs, id_col, text_col, buckets, longest, "raw")
    wanted = bucket_counts(target, target_id, target_text, buckets, longest, "target")
    row = stage(gains(raw, wanted, buckets), "gains")  # one row of as many numbers as there are buckets
    parts = F.zip_with("buckets", "counts", lambda bucket, n: F.get("gains", bucket) * n)
    weight = F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part)
    weighed = raw.crossJoin(F.broadcast(row)).select("doc_id", "n_features", weight.alias("weight"), (F.col("n_words") >= min_words).alias("long_enough"))
    # written, as ranges are first sampled and then filled
    scored = stage(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score"), "long_enough"), "scored")
    order = [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # the number of a row holds its partition and, in the low 33 bits, its place there
    ranged = stage(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    placed = ranged.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("long_enough"), 1)).alias("eligible"))
    ahead = Window.orderBy("range")  # a row a partition
    starts = sizes.select("range", (F.sum("n").over(ahead) - F.col("n")).alias("before"), F.sum("eligible").over(Window.partitionBy()).alias("eligible"))
    nth = F.col("before") + F.col("place") + 1
    drawn = F.col("long_enough") & (nth <= F.floor(F.lit(percent) * F.col("eligible") / 100))
    return placed.join(F.broadcast(starts), "range").select("doc_id", "n_features", "weight", "score", F.when(drawn, nth).alias("rank"))
