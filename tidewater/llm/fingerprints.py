"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words, each weighted by its number of occurrences. For each of ``SAMPLES``
samples k and each word, r and c are Gamma(2, 1) and b is uniform, all taken from hashes of the word
and k. With t = floor(ln(weight) / r + b), the word's value is ln a = ln c - r (t - b + 1), and the
least value of the document is the sample. It only depends on the word and t, so two documents share
it with a probability that is their generalised Jaccard similarity, sum of minima by sum of maxima
of the weights. A fingerprint is 32 bits of each sample's hash.

Words are exploded and counted by document where the document's text already lies, so that counts
and minima need no shuffle of words. The document that follows is found by range partitions and a
table of their first documents, never in one sorted task.

Defined cases: a null text counts as empty. A text without words has an empty fingerprint, whose
likeness is 1 to another empty one and 0 to all others. Rows that share id and text are one document
in the order, and each row comes out; of rows that share an id, the one with the smaller hash comes
first; null ids come last. A single document follows itself. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

SAMPLES = 32
_KEY = ["k1", "k2"]


def sample_value(k: int) -> Column:
    """ln a of the word with hash ``term`` and log weight ``log_weight``, for sample k."""
    one, two = f"xxhash64(term, {2 * k})", f"xxhash64(term, {2 * k + 1})"
    r = f"(-ln((shiftrightunsigned({one}, 32) + 0.5D) / 4294967296D * ((({one}) & 4294967295L) + 0.5D) / 4294967296D))"
    c = f"(-ln((shiftrightunsigned({two}, 43) + 0.5D) / 2097152D * ((shiftrightunsigned({two}, 22) & 2097151L) + 0.5D) / 2097152D))"
    b = f"((({two}) & 4194303L) / 4194304D)"
    return F.expr(f"ln({c}) - {r} * (floor(log_weight / {r} + {b}) - {b} + 1D)")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the keys k1 (the id) and k2 (a hash of the text, and whether the id is null)."""
    clean, doc_id = text_or_empty(text_col), F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), clean.alias("text"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("k1"), F.xxhash64(clean, doc_id.isNull()).alias("k2"))


def in_order(keyed: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n_chars, n_rows, next_k1, next_k2`` by descending id, the last followed by the first."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("k2").asc()]
    rows = keyed.groupBy("doc_id", *_KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.length("text")).cast("long").alias("n_chars"))
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(*order)
    firsts = dealt.withColumn("nth", F.row_number().over(within)).where("nth = 1").select("part", F.struct(*_KEY).alias("first"))
    parts = Window.orderBy("part")  # one row for each partition
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"))
    chained = dealt.withColumn("follows", F.lead(F.struct(*_KEY)).over(within)).join(after, "part")
    follows = F.coalesce("follows", "after")
    return chained.select("doc_id", *_KEY, "n_chars", "n_rows", follows["k1"].alias("next_k1"), follows["k2"].alias("next_k2"))


def sampled(texts: DataFrame, samples: int) -> DataFrame:
    """From (k1, k2, which, words) clustered by key: (k1, k2, which, fingerprint).

    ``fingerprint`` is an array of ``samples`` 32-bit numbers. All that is aggregated has a fixed
    size, so that both aggregations are hash aggregations.
    """
    words = texts.select(*_KEY, "which", F.explode("words").alias("word")).where("word <> ''")
    counted = words.groupBy(*_KEY, "which", "word").agg(F.count(F.lit(1)).alias("n"))
    terms = counted.select(*_KEY, "which", F.xxhash64("word").alias("term"), F.log(F.col("n").cast("double")).alias("log_weight"))
    least = terms.groupBy(*_KEY, "which").agg(*(F.min(sample_value(k)).alias(f"s{k}") for k in range(samples)))
    bits = F.array(*(F.xxhash64(f"s{k}").bitwiseAND(F.lit(4294967295)) for k in range(samples)))
    return least.select(*_KEY, "which", bits.alias("fingerprint"))


def hexed(fingerprint: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """A row for each row, of the text and its edited text: half replaced by the next document's start.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    keyed = _keyed(docs, id_col, text_col)
    order = stage(in_order(keyed), "order")
    texts = keyed.select(*_KEY, "text")
    if order.where("n_rows > 1").isEmpty() is False:
        texts = texts.groupBy(*_KEY).agg(F.max("text").alias("text"))
    wanted = order.select(F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"), F.col("k1").alias("for_k1"), F.col("k2").alias("for_k2"), F.col("n_chars").alias("of_chars"))
    heads = texts.join(wanted.hint("shuffle_hash"), _KEY).select(F.col("for_k1").alias("k1"), F.col("for_k2").alias("k2"), "of_chars", F.expr("left(text, cast(of_chars div 2 AS int))").alias("head"))
    edited = F.expr("concat(left(text, cast(of_chars - of_chars div 2 AS int)), head)")
    both = texts.join(heads.hint("shuffle_hash"), _KEY).select(*_KEY, "text", edited.alias("edited"))
    split = lambda c: F.split(c, "[\\x20\\x09-\\x0D]+")
    kinds = F.array(F.struct(F.lit(True).alias("which"), split("text").alias("words")), F.struct(F.lit(False).alias("which"), split("edited").alias("words")))
    found = sampled(both.select(*_KEY, F.inline(kinds)), samples)
    pick = lambda which, name: F.max(F.when(F.col("which") == which, F.col("fingerprint"))).alias(name)
    marks = both.select(*_KEY, F.sha2("edited", 256).alias("edited_sha256")).join(found.groupBy(*_KEY).agg(pick(True, "own"), pick(False, "edit")), _KEY, "left")
    marks = stage(marks, "fingerprints")
    following = marks.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("own").alias("next_own"))
    joined = order.join(marks, _KEY).join(following, ["next_k1", "next_k2"])
    out = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
