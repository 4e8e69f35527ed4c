"""Byte-level BPE encoding and decoding by monoid tree reduction.

The token lists of byte strings form a monoid: ``join(encode(a), encode(b))`` is
``encode(a + b)``. A piece (one match of the pattern) is cut in halves recursively; two
neighbouring lists are joined by merging the bytes of a window round the boundary anew and
growing it, on whichever side has not settled, until it has. A side
has settled when its outermost window token and the first token outside are *stable*, that
is, merging the bytes of just these two gives them back. A list whose neighbours are all
stable is the encoding of its bytes (a merge across a boundary would have to happen first
within the two tokens that meet there), so tokens outside the window provably stay. The
window grows by steps that double, so a boundary that settles late costs no more than a few
merges of the final window.
Decoding concatenates token bytes up the same tree.

Encodings of short byte strings, joined boundaries and words are remembered in dictionaries
of bounded size, emptied when full.

Spark runs this in Arrow batches, one pass, no shuffle: a document is encoded where it is
read. The rank table is a file parameter, read once on the driver and broadcast (its size
is that of the vocabulary, checked against ``MAX_VOCABULARY``).

Defined results: null and empty texts give no tokens; unpaired surrogates cannot occur in
Spark strings; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_VOCABULARY = 1_000_000
LEAF_BYTES = 6          # a half of at most so many bytes is merged directly
MEMO_ENTRIES = 300_000  # of each of three dictionaries: about 200 MB a worker when all are full


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError("vocabulary too large to broadcast")
    return ranks


class TreeBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_ENTRIES):
        import regex
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.pieces = regex.compile(pattern).findall
        self.odd = regex.compile(r"\s ").search       # white space before a blank
        self.memo = memo
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merge neighbours of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) > 48:
            return self.merge_long(data)
        get, none = ranks.get, 1 << 60
        cut = list(range(len(data) + 1))
        rank = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(data[cut[i]:cut[i + 2]], none)
            if i:
                rank[i - 1] = get(data[cut[i - 1]:cut[i + 1]], none)
        return tuple([ranks[data[cut[k]:cut[k + 1]]] for k in range(len(cut) - 1)])

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list of parts, for wide windows."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))   # starts of parts
        alive = [True] * n

        def pair(i: int) -> int | None:
            j = after[i]
            return ranks.get(data[i:after[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue                          # a part of this pair has changed since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, after[after[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:after[i]]])
            i = after[i]
        return tuple(out)

    def meet(self, a: int, b: int) -> tuple[int, ...]:
        """Encoding of two tokens' bytes; equal to ``(a, b)`` when they are stable."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= self.memo:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.token[a] + self.token[b])
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        window = self.meet(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1           # left[:i] and right[j:] are outside the window
        step_a = step_b = 1
        while True:
            a = i > 0 and self.meet(left[i - 1], window[0]) != (left[i - 1], window[0])
            b = j < len(right) and self.meet(window[-1], right[j]) != (window[-1], right[j])
            if not a and not b:
                return left[:i] + window + right[j:]
            if a:
                i, step_a = max(0, i - step_a), 2 * step_a
            if b:
                j, step_b = min(len(right), j + step_b), 2 * step_b
            window = self.merge(b"".join(self.token[t] for t in left[i:] + right[:j]))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Encoding of one match of the pattern."""
        r = self.ranks.get(data)
        if r is not None:
            return (r,)
        got = self.halves.get(data)
        if got is None:
            got = self.whole(data)
            if len(data) <= 64:
                if len(self.halves) >= self.memo:
                    self.halves.clear()
                self.halves[data] = got
        return got

    def whole(self, data: bytes) -> tuple[int, ...]:
        """Encoding of a piece that is no token; its halves are remembered, it is not."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.piece(data[:mid]), self.piece(data[mid:]))

    def plain(self, text: str) -> bytes:
        ids = array("I")
        for p in self.pieces(text):
            ids.extend(self.piece(p.encode()))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        No match of the pattern runs from a visible character into a blank, so a text may be
        cut before each blank that follows one; the cuts only serve to remember words."""
        if " " not in text or self.odd(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        out = [*map(self.words.get, rest)]
        if None in out:
            known, learn = self.words.get, self.learn
            out = [known(w) or learn(w) for w in rest]
        return self.plain(first) + b"".join(out)

    def learn(self, word: str) -> bytes:
        """Ids of a blank and a word, remembered unless the word is very long."""
        if not word:
            got = self.plain(" ")
        elif word.isalpha():
            data = b" " + word.encode()             # remembered as a word, so not as a piece too
            r = self.ranks.get(data)
            got = array("I", self.whole(data) if r is None else (r,)).tobytes()
        elif word[-1] in ".," and word[:-1].isalpha():      # two matches of the pattern
            got = (self.words.get(word[:-1]) or self.learn(word[:-1])) + self.plain(word[-1])
        else:
            got = self.plain(" " + word)
        if len(word) <= 64:
            if len(self.words) >= self.memo:
                self.words.clear()
            self.words[word] = got
        return got

    def decode(self, ids: bytes) -> bytes:
        """Bytes of encoded ids, concatenated up the tree."""
        token = self.token

        def up(a: np.ndarray) -> bytes:
            if len(a) <= 4096:
                return b"".join([token[i] for i in a.tolist()])
            mid = len(a) // 2
            return up(a[:mid]) + up(a[mid:])

        return up(np.frombuffer(ids, "<u4"))


assert array("I", [1]).tobytes() == b"\1\0\0\0", "a little-endian machine is needed"
_MADE: dict[str, TreeBpe] = {}


def worker_bpe(shared) -> TreeBpe:
    """One encoder per Python worker and rank table, so its memory is warm across tasks."""
    ranks, pattern, key = shared.value
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = TreeBpe(ranks, pattern)
    return _MADE[key]


def share(docs: DataFrame, vocabulary: str, pattern: str):
    """Broadcast of the rank table (bounded by ``MAX_VOCABULARY``)."""
    return docs.sparkSession.sparkContext.broadcast(
        (load_ranks(vocabulary), pattern, f"{vocabulary}|{pattern}"))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit, binary) per document."""
    shared = share(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(shared)
        for b in batches:
            ids = [bpe.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` as ``decoded``."""
    from pyspark.sql.functions import pandas_udf
    shared = share(encoded, vocabulary, pattern)

    @pandas_udf("binary")
    def run(ids):
        bpe = worker_bpe(shared)
        return ids.map(lambda x: None if x is None else bpe.decode(bytes(x)))

    return encoded.withColumn("decoded", run("ids"))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode and digest in one
    pass, so neither ids nor decoded bytes cross back to the JVM."""
    shared = share(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(shared)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t) if t else b""
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
