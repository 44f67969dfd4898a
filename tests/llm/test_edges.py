"""Nulls in any column, repeated rows, empty tables and clashing column names, for each operator and stage."""

from __future__ import annotations

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_brute_force import sha
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import exact_dedup, fingerprints, html_extract, line_dedup, minhash, packing, quality, queries, secret_scan, sentencepieces, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line of more than forty characters that is found again and again"
ROWS = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (2, None, None, None, None), (None, "no id here, but words", "en", None, 5), (None, None, None, None, None), (3, "", "en", "s", 0)]
ROWS += [(10 + i, f"{LINE}\nnumber {i}", "en", f"s{i}", 70) for i in range(6)]
#: Names that the operators use within.
CLASHES = ["_kept", "_words", "_bits", "_version", "_spans", "version", "uid", "rank", "path", "_doc", "_of", "_text", "bucket", "node", "k1", "host", "ids", "piece", "spans", "word", "n", "value", "owner"]


def named(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("taken"))
    return df


def labelled(spark):
    return spark.createDataFrame([(10 + i, i % 2, 0) for i in range(6)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda spark, d: packing.pack_documents(d, queries.tokenizer("byte_bpe_50k.json")),
    "lines": lambda spark, d: line_dedup.drop_lines(d),
    "secrets": lambda spark, d: secret_scan.scan_secrets(d),
    "redact": lambda spark, d: secret_scan.redact(d),
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
    "near": lambda spark, d: minhash.near_duplicates(d),
    "fingerprints": lambda spark, d: fingerprints.fingerprints(d),
    "quality": lambda spark, d: quality.score_quality(d, labelled(spark)),
    "substrings": lambda spark, d: substring_dedup.drop_repeated(d),
    "sentencepiece": lambda spark, d: sentencepieces.encode_documents(d, queries.tokenizer("piece_bpe_32k.model"), decoded=True),
}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, size=5):
    words = words_of(text.lower())
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_groups(texts):
    """Text -> the texts it is linked with, by way of others too."""
    groups = {t: {t} for _, t in texts}
    for s in groups:
        for t in groups:
            a, b = shingles(s), shingles(t)
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and groups[s] is not groups[t]:
                joined = groups[s] | groups[t]
                for x in joined:
                    groups[x] = joined
    return groups


def expected(name):
    """(columns, rows) that an operator gives for ``ROWS``, as its docstring defines them; repeated rows once each."""
    texts = [(d, t or "") for d, t, *_ in ROWS]
    if name == "lines":
        kept = {d: max(i for i, t in texts if i is not None and LINE in t.split("\n")) for d in [LINE]}
        out = []
        for d, t in texts:
            lines = t.split("\n")
            left = [x for x in lines if x != LINE or d == kept[LINE]]
            out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
        return ["doc_id", "_n_lines", "_n_dropped", "_kept"], out
    if name == "exact":
        normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
        first = lambda t: min((d for d, o in texts if normal(o) == normal(t)), key=lambda d: (d is None, d or 0))
        return ["doc_id", "keep_id", "group_size", "text_sha256"], [(d, first(t), sum(normal(o) == normal(t) for _, o in texts), sha(normal(t))) for d, t in texts]
    if name == "near":
        groups = near_groups(texts)
        least = lambda t: min((d for d, o in texts if o in groups[t] and d is not None), default=None)
        return ["doc_id", "n_shingles", "component_id"], [(d, len(shingles(t)), least(t) if shingles(t) else d) for d, t in texts]
    if name == "substrings":
        return ["doc_id", "n_words", "n_removed", "kept_text"], [(d, len(words_of(t)), 0, " ".join(words_of(t))) for d, t in texts]
    if name == "packing":
        tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
        return ["doc_id", "piece", "start", "length"], [(d, 0, 0, len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in texts]
    if name == "fingerprints":
        return ["doc_id", "n_chars"], [(d, len(t)) for d, t in texts]
    if name == "sentencepiece":
        model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
        return ["doc_id", "ids", "text"], [(d, model.encode(t), t) for d, t in texts]
    if name == "redact":
        return ["doc_id", "text"], [(d, t) for d, t, *_ in ROWS]  # there are no secrets
    return ["doc_id"], [(d,) for d, _ in texts]


#: What differs from run to run or counts from anywhere.
FREE = {"sequence_id", "offset", "group_id", "uid"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    plain = OPERATORS[name](spark, docs)
    columns, want = expected(name)
    rows = plain.collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want))
    if name == "secrets":
        assert all(not r["findings"] for r in rows)
    if name == "quality":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    if name == "exact":
        assert sum(r["kept"] for r in rows) == len({t or "" for _, t, *_ in ROWS})  # none differ by white space alone
    clashing = OPERATORS[name](spark, named(docs))
    fixed = [c for c in plain.columns if c not in FREE]
    assert sorted(repr(tuple(r)) for r in clashing.select(*fixed).collect()) == sorted(repr(tuple(r[c] for c in fixed)) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "https://h/x", "<p>text</p>"), (2, "odd url", ""), (3, "https://h/y", "<div><p>unclosed <b>text"), (3, "https://h/y", "<div><p>unclosed <b>text"), (4, "https://h/z", "<!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_extract.extract(pages.withColumn("host", F.lit("taken")).withColumn("content", F.lit("taken")))
    assert out.count() == len(rows)
    assert html_extract.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_stages(spark, tmp_path, kind):
    """Each stage on the odd rows: which stay, and with what text."""
    labelled(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ROWS if kind != "empty" else [], SCHEMA)
    if kind == "clashing":
        docs = named(docs)
    rows = [(d, t) for d, t, *_ in ROWS] if kind != "empty" else []
    scores = {(r["doc_id"], r["version"]): r["predicted"] for r in quality.score_quality(docs, labelled(spark)).collect()}
    versions = {(d, t): spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t")).first()[0] for d, t in set(rows)}
    largest = max((d for d, t in rows if d is not None and t and LINE in t), default=None)
    near, groups = {}, near_groups([(d, t or "") for d, t in rows])
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        near.setdefault(frozenset(groups[t]) if words_of(t) else (d, t), (d, t))
    want = {
        "quality_classifier": [(d, t) for d, t in rows if scores[d, versions[d, t]]],
        "line_dedup": [(d, t if d == largest or not t or LINE not in t else t.split("\n", 1)[1]) for d, t in rows],
        "minhash_near_dedup": list(near.values()),
        "secret_scans": rows,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        blank = (lambda x: [(d, t or "") for d, t in x]) if name == "line_dedup" else (lambda x: x)
        assert sorted(map(repr, blank(got))) == sorted(map(repr, blank(want[name]))), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_stage_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert kept == {d: t for d, t in texts.items() if scores[d]}
    lines = {r["doc_id"]: r["_kept"] for r in line_dedup.drop_lines(docs).collect()}
    assert {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.line_stage(spark, docs, sf).collect()} == lines
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, sf).collect()} == {d for d, c in groups.items() if d == c}
    found = {r["doc_id"]: r["findings"] for r in secret_scan.scan_secrets(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_stage(spark, docs, sf).collect()}
    assert all((clean[d] == texts[d]) == (not found[d]) for d in texts)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) > 50
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(out[0].asDict())
