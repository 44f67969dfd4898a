"""Line deduplication over a corpus, in DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except
those in the largest document id that holds them.

1. Candidate lines become 128-bit hashes with document and position; no text is shuffled for them.
2. The hashes are range-partitioned by hash, then document, and sorted by hash, document and
   position, so that a line found everywhere spreads over many ranges. Each range streams the first
   occurrence of a key in each document; these are counted, with a partial count in each range.
3. Lines of frequent keys are set in a bitmap for each document, 64 lines a word; words without
   a dropped line are left out. The bitmaps, not texts, are what the search returns.

Defined cases: a null or empty text is one empty line. Rows that share an id count as one document,
and each is judged; a null id is an id of its own, below all others. An empty table gives an empty
table. Columns of the input other than id and text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stage, text_or_empty, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["_h1", "_h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z only: ``lower`` where all characters are ASCII, else the slower ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))


def candidate_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``_doc, _version, _pos, _h1, _h2`` of each line whose key is long enough.

    ``_version`` hashes the text, so that rows which share an id don't mix their lines.
    """
    lines = _rows(docs, id_col, text_col).select("_doc", F.xxhash64("_text").alias("_version"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keys = lines.select("_doc", "_version", "_pos", F.btrim("_line", F.lit(SPACES)).alias("_key")).where(F.length("_key") >= min_chars)
    keys = keys.withColumn("_key", ascii_lower(F.col("_key")))
    return keys.select("_doc", "_version", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def frequent_keys(candidates: DataFrame, min_docs: int) -> DataFrame:
    """``_h1, _h2, _keeper`` of the keys that at least ``min_docs`` documents hold."""
    dealt = candidates.select(*_HASH, "_doc", "_pos").repartitionByRange(*_HASH, "_doc")
    place = F.row_number().over(Window.partitionBy(*_HASH, "_doc").orderBy("_pos"))
    firsts = dealt.withColumn("_nth", place).where("_nth = 1")
    return firsts.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_keeper")).where(F.col("_docs") >= min_docs).drop("_docs")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``_doc, _version, drop_words``: for each document that loses lines, the words of its bitmap.

    ``drop_words`` is an array of (word, bits): bit i of word w is set where line 64 w + i goes.
    """
    candidates = stage(candidate_lines(docs, id_col, text_col, min_chars), "lines")
    # written, so that the join has exchanges of its own and Spark can split a line that many documents have
    frequent = stage(frequent_keys(candidates, min_docs), "frequent")
    found = candidates.join(frequent, _HASH).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))
    words = found.groupBy("_doc", "_version", F.floor(F.col("_pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("bits"))
    return words.groupBy("_doc", "_version").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drop_words"))


def _judged(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """The rows joined to their bitmaps, and from them the lines, the dropped lines and the shortened text."""
    of, version, words, bits = (unused(docs, c) for c in ("_of", "_of_version", "_words", "_bits"))
    bitmaps = drop_bitmaps(docs, id_col, text_col, min_chars, min_docs).toDF(of, version, words)
    clean = text_or_empty(text_col)
    joined = docs.join(bitmaps.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(of)) & (F.xxhash64(clean) == F.col(version)), "left")
    joined = joined.withColumn(bits, F.map_from_entries(words))
    bit = f"shiftright(coalesce(try_element_at({bits}, cast(i div 64 AS int)), 0L), cast(i % 64 AS int)) & 1"
    kept = F.when(F.col(words).isNull(), clean).otherwise(F.expr(f"array_join(filter(split(cast(`{text_col}` AS string), '\n'), (line, i) -> ({bit}) = 0), '\n')"))
    dropped = F.expr(f"aggregate(coalesce({words}, array()), 0L, (n, w) -> n + bit_count(w.bits))")
    n_lines = (F.length(clean) - F.length(F.replace(clean, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined, n_lines, dropped, kept


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows and columns, and ``_n_lines``, ``_n_dropped`` and the shortened ``_kept`` (in place of columns named so)."""
    docs = docs.drop("_n_lines", "_n_dropped", "_kept")
    joined, n_lines, dropped, kept = _judged(docs, id_col, text_col, min_chars, min_docs)
    return joined.select(*docs.columns, n_lines.alias("_n_lines"), dropped.alias("_n_dropped"), kept.alias("_kept"))


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows and columns of ``docs``, each text (but a null) without its dropped lines."""
    joined, _, _, kept = _judged(docs, id_col, text_col, min_chars, min_docs)
    return joined.select(*(F.when(F.col(c).isNotNull(), kept).alias(c) if c == text_col else docs[c] for c in docs.columns))
