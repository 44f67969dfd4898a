"""The corpus operators against plain Python that does the same the long way."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import exact_dedup, fingerprints, html_extract, line_dedup, minhash, packing, quality, queries, secret_scan, sentencepieces, substring_dedup

LONG = "the same long line that many of the documents hold, word for word"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
PROSE = " ".join(f"word{i % 37}x{i}" for i in range(120))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared lines and passages, nulls, empty and long texts."""
    texts = [None, "", " ", "\n\n", "one", "One", "a b", f"{LONG}\nown line", f"{LONG.upper()} \n{LONG}\nmore", f"  {LONG}", f"{LONG}\t", f"{LONG}\n", LONG]
    texts += [PROSE, PROSE, PROSE + " tail", PROSE.replace("word5x5", "other"), PROSE.upper(), f"{PASSAGE} unique tail one", f"head of two {PASSAGE}", f"{PASSAGE} {PASSAGE}"]
    texts += ["x  y\tz", "x y z", "password = hunter2hunter2 and AKIA" + "Q7" * 9, "deadbeef" * 4 + " token: 'abcdef123'", "key aB3dE5fG7hJ9kL1mN2pQ4rS6 here", "key aB3dE5fG7hJ9kL1mN2pQ4rS6 there"]
    texts += ["naïve café — 漢字 \U0001f600 end", "wide space here", " ".join(f"long{i}" for i in range(5000)), "aaaa " * 400]
    return [(i * 3 + 1, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module", params=["rows", "corpus"])
def both(request, docs, corpus):
    return docs if request.param == "rows" else corpus


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_packing(both):
    from tokenizers import Tokenizer

    path, cap = queries.tokenizer("byte_bpe_50k.json"), 1024
    tok = Tokenizer.from_file(path)
    out = packing.pack_documents(both, path, end_id=2, max_tokens=cap, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in pairs(both):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r["piece"])
        assert [x for p in pieces for x in p["ids"]] == ids
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert all(p["length"] == cap for p in pieces[1:]) and len(pieces) == -(-len(ids) // cap)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    assert not by_doc
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    # as many sequences as best-fit decreasing, taken literally
    bins: list[int] = []
    for n in sorted((r["length"] for r in out), reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(cap - n)
    assert len(by_sequence) == len(bins)


def test_lines(both):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    texts = pairs(both)
    held = defaultdict(set)
    for d, t in texts:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    frequent = {k: max(d) for k, d in held.items() if len(d) >= 5}
    assert frequent
    got = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["_kept"]) for r in line_dedup.drop_lines(both).collect()}
    for d, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if frequent.get(key(x), d) == d]
        assert got[d] == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_secrets(both):
    patterns = {
        "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"(AKIA[A-Z0-9]+)",
        "hex": r"([0-9a-f]+)",
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    got = {r["doc_id"]: r["findings"] or [] for r in secret_scan.scan_secrets(both).collect()}
    tokens = 0
    for d, t in pairs(both):
        want = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if len(m[1]) >= least[k]]
        mine = [(f["start"], f["kind"], f["end"]) for f in got[d] if f["kind"] != "token"]
        assert mine == [(s, k, e) for s, _, k, e in sorted(want)]
        tokens += sum(f["kind"] == "token" for f in got[d])
    assert tokens or len(got) > 100


def test_widespread_values_are_no_tokens(spark):
    value = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    for owners, tokens in ((2, 4), (3, 0)):
        df = spark.createDataFrame([(i, f"see {value}", "en", f"o{i % owners}") for i in range(4)], "doc_id long, text string, lang string, source string")
        found = [f for r in secret_scan.scan_secrets(df).collect() for f in r["findings"] or []]
        assert len(found) == tokens


def test_many_owners_of_one_repository_share_one_copy(spark):
    value = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    for repositories, tokens in ((1, 4), (2, 4), (4, 0)):
        df = spark.createDataFrame([(i, f"see {value}", f"o{i}", f"r{i % repositories}") for i in range(4)], "doc_id long, text string, source string, repo string")
        found = [f for r in secret_scan.scan_secrets(df, repository_cols=("repo",)).collect() for f in r["findings"] or []]
        assert len(found) == tokens


def test_exact(both):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    groups = defaultdict(list)
    for d, t in pairs(both):
        groups[norm(t)].append(d)
    for sizes in ({}, {"combine_bytes": 300, "bucket_bytes": 500}):
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(both, **sizes).collect()}
        for t, members in groups.items():
            for d in members:
                r = got[d]
                assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(members), len(members), d == min(members), sha(t))


def near_by_hand(texts, size):
    """{doc_id: (set size, component)} by comparing all pairs of (doc_id, text)."""
    ids, sets = [], []
    for d, t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)}))
        ids.append(d)
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("size", [2, 5])
def test_near(both, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(both, shingle=size).collect()}
    assert got == near_by_hand(pairs(both), size)


def test_near_at_the_threshold(spark):
    """One text with edits that others share: most pairs collide, some are linked, and several rounds are needed."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(240):
        words = [f"w{k}" for k in range(150)]
        for k in rng.choice(150, rng.integers(6, 15), replace=False):
            words[k] = f"v{k}.{rng.integers(0, 3)}"
        texts.append((i, " ".join(words)))
    wanted = near_by_hand(texts, 2)
    assert 1 < len({c for _, c in wanted.values()}) < len(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=2).collect()}
    assert got == wanted


def test_fingerprints(both):
    texts = sorted(pairs(both), reverse=True)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(both).collect()}
    by_text = {}
    for i, (d, t) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        bag = lambda s: Counter(re.findall("[^\x20\x09-\x0d]+", s))
        for name, other in (("near_edited", edited), ("near_next", follow)):
            a, b = bag(t), bag(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0
            assert 0 <= r[name] <= 1
            assert abs(r[name] - true) <= 0.45  # 32 samples: five standard deviations
    found = [abs(rows[d]["near_edited"] - 0) for d, _ in texts]
    assert np.mean(found) > 0.2


def test_fingerprint_bias(corpus):
    """Over all documents the estimates are right on average."""
    texts = sorted(pairs(corpus), reverse=True)
    rows = {r["doc_id"]: r["near_edited"] for r in fingerprints.fingerprints(corpus).collect()}
    off = []
    for i, (d, t) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        a, b = Counter(t.split()), Counter(edited.split())
        if a | b:
            off.append(rows[d] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.03


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(got[d]["score"], y) for d, y in truth.items() if got[d]["held_out"]]
    up, down = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) > 0.85
    # labels of the held-out fold, and columns other than the text, have no say
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = quality.score_quality(docs.selectExpr("doc_id", "text", "'x' AS lang", "'x' AS source", "n_chars"), other)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {d: r["score"] for d, r in got.items()}


def test_trees_walk_as_written():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    model = quality.fit(x, (x[:, 1] + x[:, 2] ** 2 > 0.5).astype(float), n_trees=20)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.prior
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_substrings(both):
    width, seen, want = 20, set(), {}
    for d, t in sorted(pairs(both)):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        want[d] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    assert sum(w[1] for w in want.values()) > 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.drop_repeated(both, width=width).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_substrings_small_alphabet(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(rng.choice(list("ab"), rng.integers(0, 60)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for d, t in rows:
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - 4):
            if (window := tuple(words[i : i + 5])) in seen:
                gone[i : i + 5] = [True] * 5
            seen.add(window)
        want[d] = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    assert {r["doc_id"]: r["kept_text"] for r in substring_dedup.drop_repeated(df, width=5).collect()} == want


def test_sentencepiece(both):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in sentencepieces.encode_documents(both, path, decoded=True).collect()}
    for d, t in pairs(both):
        assert got[d]["ids"] == model.encode(t)
        assert got[d]["text"] == t.replace("▁", " ")
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(got[d]["ids"], "<u4").tobytes())


def test_html():
    menu = '<nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav>'
    page = lambda title, *paras: f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header><div>Site</div></header>{menu}<article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paras)}</article><aside>Ads</aside><div class='comments'><p>me too</p></div><footer>(c)</footer></body></html>"
    host = html_extract.Host()
    pages = [page("A &amp; B", "one\n  two", "x <b>y</b> z"), page("C", "only"), page("D", "p", "q", "r")]
    for p in pages:
        host.add(p)
    paths = set(host.content())
    texts = ["\n".join(t for path, t in html_extract.blocks(p)[1] if path in paths) for p in pages]
    assert texts == ["A & B\none two\nx y z", "C\nonly", "D\np\nq\nr"]
    assert "+" in html_extract.shown(host.wrapper)


def test_html_pages(spark, sf):
    out = html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(out) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert np.mean([r["n_chars"] > 100 for r in out]) > 0.7
    assert not any(re.search(r"</?(p|div|li|script)\b", r["text"]) for r in out)


def extracted(spark, pages):
    rows = [(i, url, f"<html><body>{body}</body></html>") for i, (url, body) in enumerate(pages)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


def test_html_slots_of_the_wrapper_decide(spark):
    """The slogan and the text have one path; their places in the wrapper tell them apart. A menu is one run of texts."""
    body = "<div>Slogan</div><h1>Title {0}</h1><div>text {0}</div><ul><li>Home</li><li>News</li></ul>"
    extra = "<div>Slogan</div><h1>Title {0}</h1><div>text {0}</div><p>more {0}</p><p>still {0}</p><ul><li>Home</li><li>News</li></ul>"
    got = extracted(spark, [("https://h/x", (body if i % 2 else extra).format(i)) for i in range(8)])
    assert got == [f"Title {i}\ntext {i}" + (f"\nmore {i}\nstill {i}" if i % 2 == 0 else "") for i in range(8)]


def test_wrapper_covers_its_pages():
    rng = np.random.default_rng(5)
    parts = ["<p>a</p>", "<ul><li>a</li><li>b</li></ul>", "<h2>h</h2><p>b</p>", "<div><p>x</p><p>y</p></div>", "<table><tr><td>1</td></tr></table>", "text"]
    for _ in range(20):
        pages = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(12)]
        host, other = html_extract.Host(), html_extract.Host()
        for i, p in enumerate(pages):
            (host if i % 2 else other).add(p)
        whole = html_extract.Host.load(host.dump())
        whole.join(html_extract.Host.load(other.dump()))
        matcher, paths = html_extract.Matcher(whole.wrapper), [s[1:] for s in html_extract.slots(whole.wrapper)]
        for p in pages:
            stream, found = html_extract.blocks(p)
            assert [paths[i] for i in matcher.slots_of(stream)] == [path for path, _ in found]




def test_html_each_structure_of_a_host_has_its_rule(spark):
    """An article on some pages leaves the others as they are."""
    plain, article = "<div>Slogan</div><h1>P{0}</h1><p>own {0}</p>", "<div>Slogan</div><article><h1>A{0}</h1><p>own {0}</p></article>"
    got = extracted(spark, [("https://h/x", (article if i % 2 else plain).format(i)) for i in range(8)])
    assert got == [f"{'A' if i % 2 else 'P'}{i}\nown {i}" for i in range(8)]


@pytest.mark.parametrize("url", [None, "odd", "https:///x", "//"])
def test_html_pages_without_a_host_have_none_in_common(spark, url):
    bodies = ["<article><p>one</p></article>"] + ["<div><p>same</p></div>", "<h1>x</h1><p>same</p>"] * 3
    assert extracted(spark, [(url, b) for b in bodies]) == ["one"] + ["same", "x\nsame"] * 3


def test_html_copies_are_no_evidence(spark):
    copy = "<h1>Title</h1><p>whole text</p>"
    assert extracted(spark, [("https://h/x", copy)] * 6) == ["Title\nwhole text"] * 6
    # two different pages, one of them often
    assert extracted(spark, [("https://h/x", copy)] * 6 + [("https://h/y", "<h1>Title</h1><p>other</p>")]) == ["Title\nwhole text"] * 6 + ["Title\nother"]


def test_html_constant_subheading_stays(spark):
    page = "<h1>T{0}</h1><p>a {0}</p><h2>Summary</h2><p>b {0}</p><div>(c) Site</div>"
    assert extracted(spark, [("https://h/x", page.format(i)) for i in range(5)]) == [f"T{i}\na {i}\nSummary\nb {i}" for i in range(5)]


def test_html_class_words_do_not_override_an_article(spark):
    inner = "<div class='layout with-sidebar'><article><p>text {0}</p></article></div><div class='sidebar'><p>teaser {0}</p></div>"
    assert extracted(spark, [("https://h/x", inner.format(i)) for i in range(4)]) == [f"text {i}" for i in range(4)]
    outer = "<article><h1>T{0}</h1><p class='notice'>own {0}</p><div class='share'>Share this</div></article>"
    assert extracted(spark, [("https://h/x", outer.format(i)) for i in range(4)]) == [f"T{i}\nown {i}" for i in range(4)]
    comments = "<main><p>text {0}</p></main><article class='comment'><p>me too {0}</p></article>"
    assert extracted(spark, [("https://h/x", comments.format(i)) for i in range(4)]) == [f"text {i}" for i in range(4)]
    layout = "<div class='page with-sidebar'><h1>T{0}</h1><p>text {0}</p></div>"
    assert extracted(spark, [("https://h/x", layout.format(i)) for i in range(4)]) == [f"T{i}\ntext {i}" for i in range(4)]
    assert extracted(spark, [("https://h/x", (layout + "<p>(c) Site {0}</p>").format(i)) for i in range(4)]) == [f"T{i}\ntext {i}\n(c) Site {i}" for i in range(4)]


LAYOUTS = {
    "within": lambda i: f"<article><h1>T{i}</h1><p>body {i}</p><div class='comments'><p>nice post {i}</p></div><form><label>Email {i}</label></form><div class='ad'>Buy {i}</div></article>",
    "beside": lambda i: f"<main><article><h1>T{i}</h1><p>body {i}</p></article><div id='comments'><h3>Comments</h3><ol><li class='comment'><article class='comment-body'><p>hi {i}</p></article></li></ol></div><div class='related'><a href='x'>Related {i}</a></div><form>Form {i}</form></main>",
    "links": lambda i: f"<article><div class='article-header'><h1>T{i}</h1></div><p>body {i}</p><ul><li><a href='1'>See {i}</a></li><li><a href='2'>And {i}</a></li></ul><div class='cookie-notice'>We use cookies</div></article>",
}


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_parts_of_an_article_that_are_none(spark, layout, n):
    """Comments, forms, adverts, related links and notices within an article or main, though their texts differ by page."""
    assert extracted(spark, [(f"https://h{layout}/{i}", LAYOUTS[layout](i)) for i in range(n)]) == [f"T{i}\nbody {i}" for i in range(n)]


def test_html_slots_decide_within_articles(spark, monkeypatch):
    """What all pages of a host share is the template's, within an article too; without the slots' evidence it would come out."""
    pages = [(f"https://h/{i}", f"<article><h1>T{i}</h1><p>body {i}</p><p>more {i}</p><h2>Part {i}</h2><div><b>Thanks for reading</b></div></article>") for i in range(5)]
    want = [f"T{i}\nbody {i}\nmore {i}\nPart {i}" for i in range(5)]
    assert extracted(spark, pages) == want
    assert extracted(spark, pages[:2]) == [f"{w}\nThanks for reading" for w in want[:2]]
    # all but copies of one page are no evidence against its text
    near = [(f"https://n/{i}", f"<article><h1>Same title</h1><div>same text</div><section>own {i}</section></article>") for i in range(5)]
    assert extracted(spark, near) == [f"Same title\nsame text\nown {i}" for i in range(5)]


def test_wrappers_grow_with_the_kinds_of_blocks():
    """Pages of the same blocks in any order: the wrapper doesn't grow with the pages and still covers them."""
    rng = np.random.default_rng(1)
    kinds = ["<p>x {}</p>", "<div class='a'><p>y {}</p></div>", "<ul><li>z {}</li></ul>", "<blockquote>q {}</blockquote>", "<h2>h {}</h2>", "<pre>c {}</pre>"]
    pages = ["<body>" + "".join(kinds[k].format(rng.random()) for k in rng.integers(0, 6, 40)) + "</body>" for _ in range(160)]
    sizes, host, other = [], html_extract.Host(), html_extract.Host()
    for i, p in enumerate(pages):
        (host if i % 3 else other).add(p)
        if i + 1 in (10, 40, 160):
            whole = html_extract.Host.load(host.dump())
            whole.join(html_extract.Host.load(other.dump()))
            sizes.append(len(html_extract.Matcher(whole.wrapper).steps))
    matcher = html_extract.Matcher(whole.wrapper)
    for p in pages:
        stream, found = html_extract.blocks(p)
        paths = [s[1:] for s in html_extract.slots(whole.wrapper)]
        assert [paths[i] for i in matcher.slots_of(stream)] == [path for path, _ in found]
    assert max(sizes) < 2000 and sizes[2] <= sizes[1]
