"""Importance resampling, top-k search and source divergence against plain Python, odd rows included."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import importance, queries, source_divergence, topk_search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ["at", "pos", "term", "n", "p", "q", "place", "range", "rank", "score", "weight", "gains", "shard", "cell", "pivot", "vec", "id", "asks", "buckets", "long_enough", "item", "value"]

TEXTS = [(1, "The quick brown fox, the quick RED fox. " * 4, "en", "s1"), (1, "The quick brown fox, the quick RED fox. " * 4, "en", "s1"), (2, None, None, None), (None, "No id here but words " * 6, "en", None), (3, "", "en", "s1"), (4, "Äpfel ÄPFEL naïve \x00 nul\x00nul 漢字 x9y \U0001f600 one", "de", "s2"), (5, "... --- !!!", "fr", "s3"), (6, "w " * 30_000 + "long" * 10_000, "en", "s2")]
TEXTS += [(100 + i, f"shared words in every text {'zebra ' * (i % 3)} number n{i} of the lot and some twenty more words to be long enough for a draw okay yes", "en", f"s{i % 4}") for i in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string"
TARGET = [(0, "quick brown zebra words"), (1, None), (2, "shared words in every text"), (2, "")]


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("taken"))
    return df


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def drawn_by_hand(docs, target, percent, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    raw, wanted = [features(t) for _, t in docs], [features(t) for _, t in target]
    s, t = sum((c for _, c in raw), Counter()), sum((c for _, c in wanted), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for (d, _), (n, c) in zip(docs, raw, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * m for b, m in c.items())
        rows.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("percent", [5, 60])
def test_resample(spark, percent):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(5)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    expected = drawn_by_hand([r[:2] for r in TEXTS], [r[:2] for r in TARGET], percent)
    same([tuple(r) for r in importance.resample(docs, target, percent).collect()], expected)
    same([tuple(r) for r in importance.resample(clashing(docs), clashing(target), percent).collect()], expected)


def test_resample_empty(spark):
    docs, target = spark.createDataFrame(TEXTS, SCHEMA), spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(docs.limit(0), target).collect() == []
    same([tuple(r) for r in importance.resample(docs, target.limit(0), 50).collect()], drawn_by_hand([r[:2] for r in TEXTS], [], 50))


def test_op11(spark, sf):
    docs, target = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    same([tuple(r) for r in queries.op11_importance_resampling(spark, sf).collect()], drawn_by_hand(docs, target, 5))


def found_by_hand(rows, k, every=50):
    fine, seen = [], set()
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v) and (i, str(v)) not in seen:
            seen.add((i, str(v)))
            fine.append((i, [math.floor(256 * x) for x in v]))
    asked, out = defaultdict(list), []
    for q, a in fine:
        if q is not None and q % every == 0:
            scores = [sum(x * y for x, y in zip(a, b, strict=False)) for _, b in fine]
            asked[q] += [(-min(max(s, -(1 << 63)), (1 << 63) - 1), c is None, c or 0) for (c, _), s in zip(fine, scores, strict=True) if c != q]
    for q, scores in asked.items():
        out += [(q, n + 1, None if none else c, -s) for n, (s, none, c) in enumerate(sorted(scores)[:k])]
    return out


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        centres = rng.normal(size=(5, 8))
        return [(i, (centres[i % 5] + rng.normal(size=8) * 0.05).tolist()) for i in range(900)]
    if kind == "ties":
        return [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(900)]
    if kind == "copies":
        return [(i, [0.5, -0.25, 0.125] if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    if kind == "large":
        return [(i, (rng.normal(size=4) * (1e30 if i % 2 else 1e6)).tolist()) for i in range(120)]
    if kind == "few":
        return [(0, [1.0, 2.0]), (50, [1.0]), (7, [])]
    odd = [(None, [1.0] * 4), (None, [2.0] * 4), (50, None), (100, [1.0, None]), (150, [float("nan")] * 4), (200, [float("inf"), 0.0]), (1, [float("-inf")]), (250, []), (300, [1.0, 2.0]), (300, [1.0, 2.0]), (300, [5.0, 1.0, 1.0, 1.0]), (350, [-1.0] * 6), (2, [1e308]), (-50, [0.001, -0.001])]
    return odd + [(400 + i, rng.normal(size=4).tolist()) for i in range(40)]


@pytest.mark.parametrize("kind", ["clustered", "ties", "copies", "large", "few", "odd"])
def test_search(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk_search.search(clashing(df), F.col("vec_id") % 50 == 0, k=5)
    same([tuple(r) for r in got.collect()], found_by_hand(rows, 5))
    assert topk_search.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_search_leaves_blocks_out():
    """Blocks whose bound is below the k-th score aren't scored."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 200
    rows = np.round(np.concatenate([c + rng.normal(size=(256, 8)) * 3 for c in centres]))
    blocks = topk_search.Blocks([(0, np.arange(len(rows)), rows)])
    scored, plain = [], topk_search.products
    try:
        topk_search.products = lambda asked, of: scored.append(len(asked)) or plain(asked, of)
        none = np.zeros(0, np.int64)
        owner, scores, ids, _ = topk_search.searched(blocks, np.array([5]), rows[5:6], np.array([-1]), (none, none, none, none.astype(bool)), 5)
    finally:
        topk_search.products = plain
    assert scored == [1]
    expected = sorted(((-int(r @ rows[5]), i) for i, r in enumerate(rows) if i != 5))[:5]
    assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == expected and not owner.any()


def test_op12(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same([tuple(r) for r in queries.op12_topk_search(spark, sf).collect()], found_by_hand(rows, 5))


def diverged_by_hand(docs, min_docs, top, scale=1_000_000_000):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def likely(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: likely(counts[lang, s]) for s in sources}, likely(whole)
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(rows)]
    return out


@pytest.mark.parametrize("min_docs", [1, 4, 1000])
def test_divergence(spark, min_docs):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(5)
    expected = diverged_by_hand([r[1:] for r in TEXTS], min_docs, 10)
    for df in (docs, clashing(docs)):
        same([tuple(r) for r in source_divergence.divergence(df, min_docs).collect()], expected)
    assert source_divergence.divergence(docs.limit(0)).collect() == []


def test_op13(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    same([tuple(r) for r in queries.op13_source_divergence(spark, sf).collect()], diverged_by_hand(docs, 10, 10))
