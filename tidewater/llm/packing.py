"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing only asks for the lengths: pieces go by falling length, each to the tightest
open bin it fits. So the plan is made from the number of pieces of each length, at most ``capacity``
numbers whatever the size of the corpus: a segment tree over the remaining capacities counts the
open bins of each and finds the tightest one that fits in logarithmic time, and all pieces of one
length that meet bins of the same remaining capacity are placed by one *rule*. There are at most
``capacity`` squared rules, which bounds what is broadcast. The plan is that of best-fit decreasing
over the whole corpus, not over shards of it.

Any numbering of the pieces of one length will do for their ranks. So each task that cuts texts
numbers its pieces of each length, Spark adds up the counts of the tasks before it, and the ranks are
looked up in the rules. Neither a sort nor a group of all pieces of one length is needed.

Defined cases: a null text counts as empty, and an empty text is one piece of the end token. Equal
rows are packed each for itself, and so are rows without an id. A text of any length and of any
characters is encoded whole. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stage

#: Runs of so many characters of white space go to the slower encoder, as the faster one's stack can't hold longer ones.
LONG_SPACE = 2_000


class OpenBins:
    """A segment tree over remaining capacities: leaf r counts the open bins with r left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining -> (first bin, bins)

    def put(self, remaining: int, first: int, n: int) -> None:
        if remaining and n:
            self.bins[remaining].append((first, n))
            self._add(remaining, n)

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` neighbouring bins with so much left."""
        first, n = self.bins[remaining].pop()
        got = min(n, most)
        if got < n:
            self.bins[remaining].append((first + got, n - got))
        self._add(remaining, -got)
        return first, got

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity, at least ``length``, that an open bin has."""
        node = length + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: what lies further right is above
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves

    def _add(self, remaining: int, n: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += n
            node >>= 1


def plan_rules(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces to a sequence, offset), by length and rank."""
    bins, rules, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = bins.tightest(length)
            if remaining is None:
                remaining = capacity
                bins.put(capacity, opened, need := -(-left // (capacity // length)))
                opened += need
            fit = remaining // length
            first, n = bins.take(remaining, max(1, left // fit))
            placed = min(left, n * fit)
            rules.append((length, rank, first, fit, capacity - remaining))
            full, rest = divmod(placed, fit)
            bins.put(remaining - fit * length, first, full)
            if rest:
                bins.put(remaining - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    rules.sort()
    return np.array(rules, dtype=np.int64).reshape(-1, 5)


def best_fit_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` in place of the columns ``part`` and ``nth`` of ``pieces``.

    Pieces have a ``length`` of 1 to ``capacity`` tokens; ``nth`` numbers those of one length in a part from 0.
    """
    sc = pieces.sparkSession.sparkContext
    per_part = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in per_part.groupBy("length").agg(F.sum("n")).collect()}
    rules = sc.broadcast(plan_rules(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(starts, ["part", "length"]).select(*names, (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, sequence, fit, offset = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            nth = rank - first
            placed = pa.array(sequence + nth // fit), pa.array(offset + nth % fit * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> ids of a byte-level BPE file of the ``tokenizers`` library.

    ``tiktoken`` gives the same ids three times faster where both split a text alike. Texts with
    letters beyond U+024F, on which their Unicode tables may differ, and such with long runs of white
    space go to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        text = file.read()
    slow, spec = Tokenizer.from_str(text), json.loads(text)
    pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    to_ids = lambda t: slow.encode(t, add_special_tokens=False).ids
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    plain = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
    by_rank = sorted((i, p) for p, i in vocab.items() if p not in special)
    if not plain or merged != [i for i, p in by_rank if len(p) > 1]:  # ranks must be the merges' order
        return to_ids
    # The letters that byte-level files write for bytes 0 to 255, and their pattern.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    assert set(ByteLevel.alphabet()) == set(letters)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(letters[c] for c in p): i for i, p in by_rank}, special_tokens={})
    odd = re.compile("|".join([r"[^\x00-\u024F]", *map(re.escape, special), rf"\s{{{LONG_SPACE}}}"])).search
    return lambda t: to_ids(t) if odd(t) else fast.encode_ordinary(t)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth[, ids]``: each document's ids and the end id.

    Longer ones are cut into pieces of ``max_tokens``; the first piece takes what is left over.
    ``nth`` numbers the pieces of one length within the task ``part``.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    fields = [(c, pa.int32() if c in ("piece", "part") else pa.int64()) for c in names] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, met = _encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                start, piece = 0, 0
                while start < len(ids):
                    end = start + ((len(ids) - start - 1) % max_tokens + 1)
                    part = ids[start:end]
                    row = [doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), task, met[len(part)]] + [part.astype(np.int32)] * with_ids
                    met[len(part)] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, piece = end, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents as pieces, each with its ``sequence_id`` and ``offset``."""
    bound_batches(docs.sparkSession)
    pieces = stage(token_pieces(docs, tokenizer_path, end_id, max_tokens, id_col, text_col, with_ids), "pieces")
    return best_fit_pack(pieces, max_tokens)
