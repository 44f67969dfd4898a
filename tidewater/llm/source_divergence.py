"""How far the sources of a language differ in their words, pair by pair and term by term.

1. Each text becomes its sorted terms; a first occurrence also counts one document. Counts by
   (lang, source, term) are summed on the map side before they are shuffled.
2. Terms in at least ``min_docs`` documents of their language are pivoted: one row a (lang, term),
   with an array that has the count of each source of the language at the source's place.
3. A group's likelihood of a term, ``p = 1 + floor(scale * (count + 2) / (N + 2 V))``, is an array
   as well. Higher-order functions emit what a term adds to each pair of sources, one source against
   all later ones at a time, and sums by pair are taken on the map side first.
4. The same arrays hold each source against the language: the terms it uses most in excess.

All numbers are whole: products of counts are decimals, the rest fits in long.

Defined cases: a null text, lang or source counts as empty; every row is a document, repeated rows too.
A language without kept terms has pairs of value 0 and no terms; a source alone in its language has no
pairs. An empty table gives an empty table. Other columns are not read, ids neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

#: What parts terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A language's totals are copied under so many keys, that its terms spread over as many tasks.
SALTS = 32


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``."""
    terms = docs.select("lang", "source", F.sort_array(F.split(F.translate("text", UPPER, LOWER), BETWEEN)).alias("terms"))
    each = terms.select("lang", "source", "terms", F.posexplode("terms").alias("pos", "term")).where("term <> ''")
    first = ~F.col("term").eqNullSafe(F.get("terms", F.col("pos") - 1))
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(first, 1)).alias("docs"))


def likelihood(n: Column, total: Column, kept: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 * kept)), exactly."""
    up = (n + F.lit(2)).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + F.lit(2) * kept).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_counts(counts: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, total, ns``: one row a kept term, ``ns`` with the count of each source at its place."""
    placed = counts.join(groups.select("lang", "source", "place", "n_sources"), ["lang", "source"])
    entries = F.array_sort(F.collect_list(F.struct("place", "n")))
    rows = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.max("n_sources").alias("n_sources"), entries.alias("entries")).where(F.col("docs") >= min_docs)
    before = F.concat(F.array(F.lit(0)), F.transform("entries", lambda e: e["place"]))
    none = F.lit(0).cast("long")
    # the entries in order, each after the zeros of the sources between
    filled = F.flatten(F.zip_with(F.slice(before, 1, F.size("entries")), F.col("entries"), lambda last, e: F.concat(F.array_repeat(none, e["place"] - last - 1), F.array(e["n"]))))
    tail = F.array_repeat(none, F.col("n_sources") - F.element_at("entries", -1)["place"])
    return rows.select("lang", "term", "total", F.concat(filled, tail).alias("ns"))


def divergence(docs: DataFrame, min_docs: int = 10, scale: int = 1_000_000_000, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: part "pair" for each other source, part "term" for the ``top`` terms of each source."""
    base = docs.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text")))
    by_lang = Window.partitionBy("lang")
    groups = stage(base.select("lang", "source").distinct().select("lang", "source", F.row_number().over(by_lang.orderBy("source")).alias("place"), F.count(F.lit(1)).over(by_lang).cast("int").alias("n_sources")), "groups")
    wide = stage(wide_counts(counted(base), groups, min_docs), "wide")
    sums = wide.select("lang", F.posexplode("ns").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda e: e["n"]).alias("totals"), F.max("kept").alias("kept"), F.sum("n").alias("whole"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_totals = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    p = F.transform("ns", lambda n, i: likelihood(n, F.get("totals", i), F.col("kept"), scale))
    likely = stage(with_totals.select("lang", "term", "ns", p.alias("p"), likelihood(F.col("total"), F.col("whole"), F.col("kept"), scale).alias("q")), "likely")

    one = likely.select("lang", "p", F.posexplode("p").alias("i", "p_i"))
    added = one.select("lang", "i", F.posexplode(F.transform(F.expr("slice(p, i + 2, size(p))"), lambda other: distance(F.col("p_i"), other))).alias("j", "value"))
    pairs = added.groupBy("lang", (F.col("i") + 1).alias("i"), (F.col("i") + F.col("j") + 2).alias("j")).agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.inline(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"))))
    sources = groups.select("lang", "source", "place")
    others = sources.join(sources.select("lang", F.col("source").alias("item"), F.col("place").alias("j")), "lang").where("place <> j").withColumnRenamed("place", "i")
    paired = others.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    used = likely.select("lang", "term", "q", F.posexplode(F.arrays_zip("ns", "p")).alias("at", "of")).where("of.ns > 0 AND of.p > q")
    excess = used.select("lang", (F.col("at") + 1).alias("place"), F.col("term").alias("item"), distance(F.col("of.p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "place").orderBy(F.col("value").desc(), "item")
    terms = excess.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(sources, ["lang", "place"])

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return paired.withColumn("rank", rank).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
