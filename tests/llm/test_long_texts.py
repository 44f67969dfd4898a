"""Texts of up to two million characters, of odd kinds, through each operator and stage."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import extracted, sha

import corpus_pipeline
from tidewater.llm import exact_dedup, fingerprints, html_extract, line_dedup, minhash, packing, quality, queries, secret_scan, sentencepieces, substring_dedup

N = 2_000_000
TEXTS = {
    "spaces": " " * N, "newlines": "\n" * N, "tabs": "\t \n" * (N // 3), "one letter": "a" * (N // 4), "digits": "0123456789" * (N // 40), "words": " ".join(f"w{i}" for i in range(N // 8)), "same word": "the " * (N // 4),
    "long lines": "\n".join([f"the same long line of more than forty characters {i % 3}" for i in range(N // 60)]), "many letters": "".join(chr(c) for c in range(0x100, 0x12000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace() and c != 0x2581), "keys": "token=abcdef0123 " * (N // 40),
}


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS.values())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/long")
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(long):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, crc = Tokenizer.from_file(path), {}
    for r in sorted(packing.pack_documents(long, path).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        crc.setdefault(r["doc_id"], []).append((r["length"], r["ids_crc32"]))
    for d, t in enumerate(TEXTS.values()):
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for length, want in crc[d]:
            assert zlib.crc32(ids[at : at + length].tobytes()) == want
            at += length
        assert at == len(ids)


def test_encoders_agree_on_all_pairs_of_letters():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(path), packing._encoder(path)
    for a in range(0x250):
        text = "\n".join(chr(a) + chr(b) for b in range(0x250))
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids
    for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, packing.LONG_SPACE + 1):
        for c in " \n\t":
            assert encode(f"x{c * n}y") == tok.encode(f"x{c * n}y", add_special_tokens=False).ids


def test_lines_secrets_and_exact(long):
    lines, secrets, exact = by_id(line_dedup.drop_lines(long)), by_id(secret_scan.scan_secrets(long)), by_id(exact_dedup.exact_dedup(long))
    for d, t in enumerate(TEXTS.values()):
        assert (lines[d]["_n_lines"], lines[d]["_n_dropped"]) == (t.count("\n") + 1, 0) and lines[d]["_kept"] == t
        assert sum(f["kind"] == "assign" for f in secrets[d]["findings"] or []) == t.count("token=")
        assert exact[d]["text_sha256"] == sha(re.sub("[\x20\x09-\x0d]+", " ", t))
    assert sum(r["kept"] for r in exact.values()) == len({re.sub("[\x20\x09-\x0d]+", " ", t) for t in TEXTS.values()})


def test_near_and_substrings(long):
    near, rest = by_id(minhash.near_duplicates(long)), by_id(substring_dedup.drop_repeated(long))
    for d, t in enumerate(TEXTS.values()):
        words = t.lower().split() if t.isascii() else [t]
        assert near[d]["n_shingles"] == (len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else 0)
        assert near[d]["component_id"] == d
        assert rest[d]["n_words"] == len(words)
    assert [rest[d]["n_removed"] for d, k in enumerate(TEXTS) if k == "words"] == [0]
    same = list(TEXTS).index("same word")
    assert rest[same]["n_words"] - rest[same]["n_removed"] == 1  # all windows but the first, which covers the first word alone


def test_fingerprints_quality_and_pieces(spark, long):
    import sentencepiece

    marks, scores = by_id(fingerprints.fingerprints(long)), by_id(quality.score_quality(long, spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")))
    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    short = long.where(F.length("text") < 600_000)
    pieces = by_id(sentencepieces.encode_documents(short, path, decoded=True))
    for d, t in enumerate(TEXTS.values()):
        assert marks[d]["n_chars"] == len(t) and 0 <= scores[d]["score"] <= 1
        if d in pieces:
            assert pieces[d]["ids"] == model.encode(t) and pieces[d]["text"] == t.replace("▁", " ")
    assert len(pieces) == 3
    again = sentencepieces.decode_documents(sentencepieces.encode_documents(short, path).withColumn("kept", F.lit(1)), path)
    assert all(r["text"] == pieces[r["doc_id"]]["text"] and r["kept"] == 1 for r in again.collect())


def test_stages(spark, long, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, long, str(tmp_path)).select("doc_id").distinct().count() <= len(TEXTS), name


PAGES = {
    "unclosed tags": "<a " * 300_000, "quotes": '<a b="' * 100_000, "scripts": "<script " * 100_000, "comments": "<!-- " * 100_000, "nested": "<div><p>x</p>" * 10_000, "end tags": "<div>" * 10_000 + "</x>" * 10_000, "inline": "<b>" * 20_000 + "<p>x</p>" * 20_000,
}


@pytest.mark.parametrize("kind", PAGES)
def test_html(spark, kind):
    """Bad pages take time in proportion to their length, and leave the others of their host alone."""
    good = ["<article><h1>T{0}</h1><p>text {0}</p></article>".format(i) for i in range(3)]
    got = extracted(spark, [("https://h/x", g) for g in good] + [("https://h/x", PAGES[kind])])
    assert got[:3] == [f"T{i}\ntext {i}" for i in range(3)]


def test_html_deep_paths_are_bounded():
    stream, found = html_extract.blocks("<div class='a'>" * 20_000 + "<p>x</p>")
    assert len(found) == 1 and len(found[0][0]) < 10_000


def test_many_small_texts_in_bounded_tables(monkeypatch):
    """A million texts of five characters: what a map task's table holds stays below 300 MB."""
    import tracemalloc

    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return type("Context", (), {"partitionId": staticmethod(lambda: 0)})

    monkeypatch.setattr(exact_dedup, "TaskContext", Task)
    batches = (pa.RecordBatch.from_arrays([pa.array(range(a, a + 10_000)), pa.array([f"{i:05x}" for i in range(a, a + 10_000)])], names=["doc_id", "text"]) for a in range(0, 1_000_000, 10_000))
    tracemalloc.start()
    records = sum(len(b) - b.column("uid").null_count == 0 and len(b) for b in exact_dedup._combine(batches, exact_dedup.COMBINE_BYTES))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert records == 1_000_000 and peak < 300e6
