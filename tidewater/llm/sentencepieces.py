"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut where no piece can reach across: before each space. For a batch of documents, the
distinct words not met before are joined into one text, and

1. a suffix array indexes it, as deep as the longest piece;
2. every piece is searched by bisection; its range in the array is where it occurs, an *edge*;
3. edges are sorted by their end, and relaxed word by word position for all words at once.

The model is a BPE, which takes merges by rank, so that the cheapest path is not its encoding.
Relaxation therefore keeps, for each position, the one last piece of the encoding of the prefix up to
there: an edge holds if its piece could stand next to the last piece of the prefix where it begins,
that is if no merge across their border comes before the merges that make the two. This gives just
the ids of the ``sentencepiece`` library. (A model of the unigram kind is refused.)

Defined cases: a null text counts as empty and has no ids. Characters without a piece become bytes.
Rows are encoded one by one, also where they repeat. An empty table gives an empty table. Other
columns are not read. Decoding gives the text back, with U+2581 as space as the library has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SPACE = "▁"
#: Words whose ids a worker remembers since it last set older ones aside; of those, used ones stay.
MEMO = 200_000
#: Documents and characters of new words in one index, at most.
DOCS, CHARS = 500, 400_000
_CACHE = 1 << 21


class Pieces:
    """A model's pieces, what they merge from, and which may follow one another."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.space = model.piece_to_id(SPACE)
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [model.id_to_piece(i) for i in range(n)]
        if any(model.get_score(i) % 1 for i in range(n)):
            raise ValueError("scores aren't ranks of merges: not a BPE model")
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        runs = {i for i in plain if len(self.text[i]) > 1 and set(self.text[i]) == {SPACE}}
        self.runs = {len(self.text[i]): i for i in runs} | {1: self.space}
        if any(SPACE in self.text[i][1:] for i in plain if i not in runs):
            raise ValueError("a piece goes on over a space: words can't be encoded one by one")
        if model.encode(SPACE * 3) != self.run(4) or model.is_unknown(self.byte_ids[0]):
            raise ValueError("the model merges spaces otherwise, or has no bytes to fall back to")
        self.rank = {self.text[i]: -model.get_score(i) for i in plain if i not in runs}
        self.made: dict[str, tuple[list[tuple[float, str, str]], bool]] = {}
        # pieces that can come out: the merges of their own text end in one piece
        self.ids = np.array([i for i in plain if i not in runs and self._merges(self.text[i])[1]])
        self.points = np.frombuffer("".join(self.text[i] for i in self.ids).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(self.text[i]) for i in self.ids], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.bytes_of = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([self.byte_ids.index(i)]) if model.is_byte(i) else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.keys, self.values = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)

    def run(self, n: int) -> list[int]:
        """Ids of n spaces: merged from the left, as long as pieces go."""
        most = max(self.runs)
        return [self.runs[most]] * (n // most) + ([self.runs[n % most]] if n % most else [])

    def _merges(self, text: str) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges of one piece's text in their order, as (rank, first part, last part) after each; whether one part is left."""
        if text not in self.made:
            parts, steps = list(text), []
            while len(parts) > 1:
                rank, at = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((rank, parts[0], parts[-1]))
            self.made[text] = steps, len(parts) == 1
        return self.made[text]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a and b stay two pieces: run both merge lists by rank, and look across the border between."""
        left, right = self._merges(a)[0], self._merges(b)[0]
        i, j, last, first = 0, 0, a[-1], b[0]
        while True:
            r_left = left[i][0] if i < len(left) else np.inf
            r_right = right[j][0] if j < len(right) else np.inf
            across = self.rank.get(last + first, np.inf)
            if across < r_left and across <= r_right:  # of equal ranks, the leftmost goes first
                return False
            if r_left == r_right == np.inf:
                return True
            if r_left <= r_right:
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1

    def all_may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` of ids, remembered in a table with a place for each hash of a pair."""
        n = len(self.text)
        key = a * n + b
        place = (key * 0x9E3779B97F4A7C1) >> 13 & (_CACHE - 1)
        out = self.values[place]
        missed = np.flatnonzero(self.keys[place] != key)
        if len(missed):
            fresh, at = np.unique(key[missed], return_inverse=True)
            found = np.fromiter((self.may_follow(self.text[k // n], self.text[k % n]) for k in fresh.tolist()), bool, len(fresh))
            out[missed] = found[at]
            self.keys[place[missed]], self.values[place[missed]] = key[missed], found[at]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model, if it is one whose ids this way of encoding gives: probes would show another kind or normalizer."""
    import sentencepiece

    own, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    probes = ["\ufb01 \u212b \u00bd\tx  y ", " A\u00a0B\u3000c", "e\u0301 \u00e9 \uff21", "a\nb\r\nc", "lower UPPER 12,345.67"]
    if encode(probes, own, Memo()) != [library.encode(p) for p in probes]:
        raise ValueError("the model changes text before it encodes, or encodes otherwise than by merges")
    return own


def suffix_index(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array to a depth, and the sorted suffixes as byte strings of that depth.

    Codes are above 0, of 8 or 16 bits; 64 bits of them at a time make one sort key.
    """
    step = 8 // codes.itemsize
    depth = -(-depth // step) * step
    padded = np.r_[codes, np.zeros(depth, codes.dtype)].astype(codes.dtype.newbyteorder(">"))
    table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(codes)])
    order = np.lexsort(table.view(">u8").astype(np.uint64).T[::-1])
    return order, table.view(f"S{codes.itemsize * depth}").ravel()[order]


def edges(codes: np.ndarray, spelled: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, place) of every occurrence of the patterns, which are spelled one after the other."""
    depth = int(sizes.max())
    order, suffixes = suffix_index(codes, depth)
    depth = suffixes.dtype.itemsize // codes.itemsize
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    column = np.arange(len(spelled)) - first[row]
    bounds = []
    for fill in (0, np.iinfo(codes.dtype).max):
        table = np.full((len(sizes), depth), fill, codes.dtype.newbyteorder(">"))
        table[row, column] = spelled
        bounds.append(table.view(suffixes.dtype).ravel())
    low, high = np.searchsorted(suffixes, bounds[0]), np.searchsorted(suffixes, bounds[1], "right")
    n = high - low
    which = np.repeat(np.arange(len(sizes), dtype=np.int32), n)
    return which, order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n - low, n)].astype(np.int32)


def encode_words(words: list[str], model: Pieces) -> list[bytes]:
    """The ids of each word as 32-bit numbers, a space before it included."""
    text = "".join(f"{SPACE}{w}\x00" for w in words)  # the zero at a word's end gets a code of its own
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int32, len(words)) + 2
    ends = np.cumsum(lengths, dtype=np.int32)
    starts = ends - lengths
    alphabet, codes = np.unique(points, return_inverse=True)
    if len(alphabet) > 0xFF00:  # characters that no piece has may share a code
        alphabet, codes = np.unique(np.where(np.isin(points, model.points), points, 0x110000), return_inverse=True)
    kind = np.uint8 if len(alphabet) < 250 else np.uint16
    codes = (codes + 2).astype(kind)
    codes[ends - 1] = 1
    near = np.minimum(np.searchsorted(alphabet, model.points), len(alphabet) - 1)
    fits = np.minimum.reduceat(alphabet[near] == model.points, model.offsets[:-1])
    ids, sizes = model.ids[fits].astype(np.int32), model.sizes[fits].astype(np.int32)
    which, start = edges(codes, (near + 2).astype(kind)[np.repeat(fits, model.sizes)], sizes)
    piece, end = ids[which], start + sizes[which]
    # characters without a piece of one character: edges that nothing merges with
    n = len(model.text)
    bare = codes != 1
    bare[start[end == start + 1]] = False
    bare = np.flatnonzero(bare).astype(np.int32)
    piece, start, end = np.r_[piece, np.full(len(bare), n, np.int32)], np.r_[start, bare], np.r_[end, bare + 1]
    owner = np.repeat(starts, lengths)
    begin = owner[start]
    at = np.minimum(end - begin, 0xFFFF).astype(np.uint16) if lengths.max() <= 0xFFFF else end - begin
    order = np.argsort(at, kind="stable")
    piece, start, end, begin, at = piece[order], start[order], end[order], begin[order], at[order]
    last, back = np.full(len(codes) + 1, -1, np.int32), np.zeros(len(codes) + 1, np.int32)
    bounds = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        p, s, e = piece[lo:hi], start[lo:hi], end[lo:hi]
        before = np.where(s == begin[lo:hi], n, last[s])  # a word's start is a border like one of a bare character
        holds = before >= 0
        ask = np.flatnonzero(holds & (before < n) & (p < n))
        holds[ask] = model.all_may_follow(before[ask].astype(np.int64), p[ask])
        last[e[holds]], back[e[holds]] = p[holds], s[holds]
    # walk back from the words' ends, all at once
    current, word = ends - 1, np.arange(len(words), dtype=np.int32)
    tokens, owners = [], []
    while len(current):
        tokens.append(np.where(last[current] < n, last[current], -1 - points[current - 1].astype(np.int64)).astype(np.int32))
        owners.append(word)
        current = back[current]
        more = current > starts[word]
        current, word = current[more], word[more]
    token, owned = np.concatenate(tokens)[::-1], np.concatenate(owners)[::-1]
    token = token[np.argsort(owned, kind="stable")]
    stops = np.cumsum(np.bincount(owned, minlength=len(words)))
    raw, marks = token.astype("<i4").tobytes(), (4 * np.r_[0, stops]).tolist()
    out = [raw[lo:hi] for lo, hi in zip(marks, marks[1:], strict=False)]
    for w in np.unique(np.searchsorted(stops, np.flatnonzero(token < 0), "right")).tolist():  # words with bytes
        own = np.frombuffer(out[w], "<i4").tolist()
        out[w] = np.array([x for t in own for x in ([t] if t >= 0 else [model.byte_ids[b] for b in chr(-1 - t).encode()])], "<i4").tobytes()
    return out


class Memo(dict):
    """Word -> ids, in two generations: what is used stays, the rest is forgotten in time."""

    def __init__(self) -> None:
        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str], model: Pieces) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        fresh = words - self.keys()
        held = fresh & self.older.keys()
        self.update((w, self.older[w]) for w in held)
        rest, at = list(fresh - held), 0
        while at < len(rest):
            size, to = 0, at
            while to < len(rest) and size <= CHARS:
                size, to = size + len(rest[to]) + 2, to + 1
            self.update(zip(rest[at:to], encode_words(rest[at:to], model), strict=True))
            at = to


def encode_raw(texts: list[str], model: Pieces, memo: Memo) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers."""
    split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
    memo.learn(set().union(*split), model)
    space = model.space.to_bytes(4, "little")
    run = lambda n: np.array(model.run(n), "<i4").tobytes() if n else b""
    out = []
    for words in split:
        if "" not in words:
            out.append(b"".join(map(memo.__getitem__, words)))
            continue
        parts: list[bytes] = []
        waiting = 0
        for w in words:
            if not w:
                waiting += 1
                continue
            own = memo[w]
            parts += [run(waiting + 1), own[4:]] if waiting and own[:4] == space else [run(waiting), own]
            waiting = 0
        out.append(b"".join([*parts, run(waiting)]))
    return out


def encode(texts: list[str], model: Pieces, memo: Memo) -> list[list[int]]:
    return [np.frombuffer(x, "<i4").tolist() for x in encode_raw(texts, model, memo)]


def decode(ids: list[int], model: Pieces) -> str:
    """The text of ids, without the space that encoding puts before all."""
    return b"".join(map(model.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def id_lists(raw: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids, ids_crc32`` of each row (the checksum of little-endian 32-bit ids).

    With ``decoded`` also ``text``, which the ids give back, in the same pass.
    """

    bound_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = pieces(model_path), Memo()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                raw = encode_raw([t or "" for t in part.column(1).to_pylist()], model, memo)
                columns = {"doc_id": part.column(0), "ids": id_lists(raw), "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64())}
                if decoded:
                    columns["text"] = pa.array([decode(np.frombuffer(x, "<i4").tolist(), model) for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encoded, "doc_id long, ids array<int>, ids_crc32 long" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns, and ``text``; a null list counts as empty."""
    bound_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*names).dtypes) + ", text string"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            texts = [decode(x or [], model) for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(decoded, schema)
