"""The registered queries over the smallest tables, held against plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from test_brute_force import near_by_hand, pairs, sha

from tidewater.llm import queries


@pytest.fixture(scope="module")
def texts(spark, sf):
    return sorted(pairs(spark.read.parquet(f"{sf}/documents.parquet")))


def rows_of(spark, sf, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    out = queries.op1_best_fit_packing(spark, sf).collect()
    got = {(r["doc_id"], r["piece"]): r for r in out}
    assert len(got) == len(out)
    for d, t in texts:
        ids, start, piece = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0, 0
        while start < len(ids):
            r = got.pop((d, piece))
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
            start, piece = start + r["length"], piece + 1
    assert not got
    at: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    # no two sequences could be one, but for the last few: best fit leaves at most one half empty
    assert sum(n <= 512 for n in at.values()) <= 1


def test_op3(spark, sf, texts):
    patterns = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": r"(AKIA[A-Z0-9]+) 20".split(), "hex": r"([0-9a-f]+) 24".split()}
    got = rows_of(spark, sf, "op3_secret_scans")
    assert len(got) == len(texts)
    for d, t in texts:
        found = sorted((m.start(), i, k, m.end()) for i, (k, (p, least)) in enumerate(patterns.items()) for m in re.finditer(p, t) if len(m[1]) >= int(least))
        base = [f"{k}:{s}:{e}" for s, _, k, e in found]
        r = got[d]
        assert [r[f"n_{k}"] for k in patterns] == [sum(f[2] == k for f in found) for k in patterns]
        assert r["base_sha256"] == sha(",".join(base))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("token")] == base
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ["assign", "access", "hex", "token"].index(s.split(":")[0])))


def test_op6(spark, sf, texts):
    got = rows_of(spark, sf, "op6_minhash_near_dedup")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == near_by_hand(texts, 2)
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_op7(spark, sf, texts):
    got, down = rows_of(spark, sf, "op7_document_fingerprints"), texts[::-1]
    for i, (d, t) in enumerate(down):
        half = len(t) // 2
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + down[(i + 1) % len(down)][1][:half]))
    of = {}
    for d, t in texts:
        assert of.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_op9(spark, sf, texts):
    got, seen = rows_of(spark, sf, "op9_substring_dedup"), set()
    for d, t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", t)
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(words), sum(gone), sha(kept))


def test_op10(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    got = rows_of(spark, sf, "op10_sentencepiece")
    for d, t in texts:
        ids = model.encode(t)
        assert (got[d]["n_ids"], got[d]["ids"], got[d]["ids_crc32"]) == (len(ids), ids, zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert got[d]["decoded_sha256"] == sha(t.replace("▁", " "))
