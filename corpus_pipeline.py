"""From raw documents to packed training sequences, one operator after the other.

Each stage reads the documents its predecessor wrote to the shared folder. All but the last return
the columns of ``documents``. Rows are told apart by id and text; a stage that changes texts brings
``n_chars`` up to date.

Defined cases of all stages: a null text counts as empty, a null id as an id of its own; an empty
table gives an empty table; further columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, minhash, packing, quality, secret_scan
from tidewater.llm.common import rows_of, stage, table
from tidewater.llm.queries import tokenizer

#: No SQL has tokenisation or a classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    Empty and null texts are scored like others. Repeated rows have one score and stay or go together.
    """
    scores = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return rows_of(docs, scores.where("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share.

    A document that loses all its lines stays, with an empty text. Repeated rows count as one
    document for a line and lose the same lines.
    """
    return _recounted(line_dedup.shortened(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id, a null id last.

    Documents without words are linked with nothing and all stay. Of repeated rows, or equal ids with
    equal texts, one stays; of equal ids with near texts, the one whose text has the least hash.
    """
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version"))
    chosen = found.groupBy("group_id").agg(first.alias("first")).select("first.doc_id", "first.version")
    kept = rows_of(docs, chosen)
    repeated = found.agg((F.count(F.lit(1)) > F.count_distinct(F.struct("doc_id", "version"))).alias("repeated")).first()[0]
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked: those of one owner, and widely copied examples, each by a mask of its own.

    A null text stays null. Repeated rows are masked alike.
    """
    return _recounted(secret_scan.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of 1024-token sequences.

    An empty or null text is a piece of one token, the end. Repeated rows are packed once each.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2, max_tokens=1024, with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
