"""Secret scans with corpus-wide ownership frequency.

1. A pass over the texts finds three base kinds (assignments, access keys, long hex runs) and
   *loose* candidates: long runs of key-like characters outside the base spans that look live
   (digits, lower and upper case, and enough entropy), such as a credential pasted without its name.
2. Each candidate's value is hashed. Hashes are counted by distinct repositories and distinct
   owners; pairs of hash and repository are made distinct before any count, with partial sums in
   each task, so that a value which a third of all rows hold is no hot group.
3. A value of at least ``widespread_owners`` owners in at least ``widespread_repositories``
   repositories is a widely copied example: many owners of one shared repository have no copies of
   their own. Other loose candidates are owner-specific and become spans of kind ``token``; base
   spans always stay.

Defined cases: a null text counts as empty. A null owner or repository counts as one of its own.
Each row is judged for itself, also where rows share an id. Spans count code points, end exclusive.
An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage, text_or_empty, unused

# The patterns of the base kinds and the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are whole, so this is AKIA[A-Z0-9]+ of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")  # likewise [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "token")
MIN_VALUE = 6

LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits of entropy a character that a loose candidate has at least.
MIN_ENTROPY = 3.5
#: A value that so many owners have, in so many repositories, is a widely copied example.
WIDESPREAD_OWNERS = 3
WIDESPREAD_REPOSITORIES = 3

_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_ROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("findings", pa.list_(_FINDING))])
_ROW_SQL = "uid long, doc_id long, version long, owner string, repository string, findings array<struct<kind: string, start: long, end: long, value: string>>"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed."""
    spans = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    spans += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping intervals joined, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def loose_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Live-looking runs that touch no base span."""
    found, taken = [], merged([s[:2] for s in base])
    starts = [s[0] for s in taken]
    for m in LOOSE.finditer(text):
        before = bisect.bisect_left(starts, m.end()) - 1
        if before >= 0 and taken[before][1] > m.start():
            continue
        value = m[0]
        if re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value) and entropy(value) >= MIN_ENTROPY:
            found.append((m.start(), m.end(), "token", value))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for doc_id, version, text, owner, repository in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = base_spans(text or "")
            spans = base + loose_spans(text or "", base)
            rows.append({"uid": uid, "doc_id": doc_id, "version": version, "owner": owner, "repository": repository, "findings": [{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in spans]})
            uid += 1
        yield pa.RecordBatch.from_pylist(rows, _ROW)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), widespread_owners: int = WIDESPREAD_OWNERS, widespread_repositories: int = WIDESPREAD_REPOSITORIES) -> DataFrame:
    """A row for each row: ``doc_id``, ``version`` (a hash of the text) and ``findings``.

    Findings are structs (start, rank of kind, kind, end, value hash, n_owners, n_repositories,
    widespread), sorted; null where there are none.
    """
    bound_batches(docs.sparkSession)
    repository = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repository_cols))))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), F.col(owner_col).cast("string").alias("owner"), repository.alias("repository"))
    scanned = stage(rows.mapInArrow(_scan, _ROW_SQL), "secrets")
    found = scanned.select("uid", "owner", "repository", F.inline("findings"))
    owned = found.select("value", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), "repository").distinct()
    # written, so that the join has exchanges of its own and Spark can split a value that many documents have
    counts = stage(owned.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories")), "owned")
    widespread = (F.col("n_owners") >= widespread_owners) & (F.col("n_repositories") >= widespread_repositories)
    judged = found.join(counts, "value").withColumn("widespread", widespread).where("kind <> 'token' OR NOT widespread")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank")
    spans = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", rank, "kind", "end", "value", "n_owners", "n_repositories", "widespread"))).alias("findings"))
    return scanned.select("uid", "doc_id", "version").join(spans, "uid", "left").drop("uid")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masks: tuple[str, str] = ("[SECRET]", "[EXAMPLE]"), **options) -> DataFrame:
    """The rows and columns of ``docs`` with each span masked: by ``masks[1]`` where it is widely copied."""
    found = scan_secrets(docs, id_col, text_col, **options).where("findings IS NOT NULL").dropDuplicates(["doc_id", "version"])
    of, version, marks = (unused(docs, c) for c in ("_of", "_version", "_spans"))
    spans = found.select(F.col("doc_id").alias(of), F.col("version").alias(version), F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["widespread"].alias("example"))).alias(marks))
    joined = docs.join(spans.hint("shuffle_hash"), docs[id_col].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_or_empty(text_col)) == F.col(version)), "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else mask(t, s, masks) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return joined.select(*(masked(F.col(c).cast("string"), marks).alias(c) if c == text_col else docs[c] for c in docs.columns))


def mask(text: str, spans: list[dict], masks: tuple[str, str]) -> str:
    out, at = [], 0
    for start, end in merged([(s["start"], s["end"]) for s in spans]):
        live = any(not s["example"] for s in spans if start <= s["start"] < end)
        out += [text[at:start], masks[0] if live else masks[1]]
        at = end
    return "".join([*out, text[at:]])
