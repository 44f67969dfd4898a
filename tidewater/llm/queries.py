"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, html_extract, importance, line_dedup, minhash, packing, quality, secret_scan, sentencepieces, source_divergence, substring_dedup, topk_search
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, max_tokens=1024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    all_spans = F.coalesce("findings", F.expr("array()").cast(found.schema["findings"].dataType))
    base = F.filter(all_spans, lambda f: f["kind"] != "token")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(all_spans, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(all_spans).alias("spans"), count("token"), F.size(F.filter(all_spans, lambda f: f["widespread"])).cast("long").alias("n_widespread"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("version")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeated(table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of every document, decoded again."""
    model = tokenizer("piece_bpe_32k.model")
    out = sentencepieces.encode_documents(table(spark, sf_dir, "documents"), model, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, buckets=10_000, longest=3, seed=42)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"), min_docs=10, scale=1_000_000_000, top=10)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_topk_search": op12_topk_search,
    "op13_source_divergence": op13_source_divergence,
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op4_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
""",
    # the CRC of a text is the exclusive or of what each of its bytes adds at its distance from the end
    "op11_importance_resampling": r"""
WITH RECURSIVE texts AS (
  SELECT 'raw' AS side, row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'target', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), words AS (
  SELECT side, id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), runs AS (
  SELECT side, id, unnest([word, word || ' ' || lead(word, 1) OVER doc, word || ' ' || lead(word, 1) OVER doc || ' ' || lead(word, 2) OVER doc]) AS gram
  FROM words WINDOW doc AS (PARTITION BY side, id ORDER BY pos)
), features AS (
  SELECT side, id, gram, count(*) AS n FROM runs WHERE gram IS NOT NULL GROUP BY ALL
), grams AS (
  SELECT gram, regexp_extract_all(hex(encode(gram)), '..') AS bytes FROM (SELECT DISTINCT gram FROM features)
), bits AS (
  SELECT byte::BIGINT AS byte, 0 AS step, byte::BIGINT AS value FROM range(256) r(byte)
  UNION ALL SELECT byte, step + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END FROM bits WHERE step < 8
), first AS (
  SELECT byte, value FROM bits WHERE step = 8
), longest AS (
  SELECT max(len(bytes)) AS most FROM grams
), shifted AS (
  SELECT byte, 0 AS distance, value FROM first
  UNION ALL SELECT s.byte, s.distance + 1, xor(s.value // 256, f.value) FROM shifted s JOIN first f ON f.byte = s.value % 256, longest WHERE s.distance < most
), ones AS (
  SELECT 0 AS size, 4294967295::BIGINT AS value
  UNION ALL SELECT o.size + 1, xor(o.value // 256, f.value) FROM ones o JOIN first f ON f.byte = o.value % 256, longest WHERE o.size < most
), exploded AS (
  SELECT gram, len(bytes) AS size, unnest(bytes) AS byte, generate_subscripts(bytes, 1) AS pos FROM grams
), table_of AS (
  SELECT upper(lpad(to_hex(byte), 2, '0')) AS byte, distance, value FROM shifted
), crcs AS (
  SELECT e.gram, xor(4294967295, xor(bit_xor(t.value), any_value(o.value))) AS crc
  FROM exploded e JOIN table_of t ON t.byte = e.byte AND t.distance = e.size - e.pos JOIN ones o ON o.size = e.size GROUP BY e.gram
), hashed AS (
  SELECT side, id, crc % 10000 AS bucket, n FROM features JOIN crcs USING (gram)
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'raw'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'target'), 0) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM hashed JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY id
), noise AS (
  SELECT id, doc_id, len(words) >= 20 AS long_enough, ('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM split WHERE side = 'raw'
), scored AS (
  SELECT doc_id, long_enough, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (WHERE long_enough) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND nth <= 5 * eligible // 100 THEN nth END AS rank FROM ranked
""",
    "op12_topk_search": """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ranked
)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
""",
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), terms AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM terms GROUP BY ALL HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), likely AS (
  SELECT lang, source, term, d.n,
         1 + (1000000000::HUGEINT * (d.n + 2)) // (sum(d.n) OVER (PARTITION BY lang, source) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (d.total + 2)) // (l.n + 2 * l.v) AS q
  FROM dense d JOIN langs l USING (lang)
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM likely x JOIN likely y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM likely WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
