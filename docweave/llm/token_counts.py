"""Token counts by trie-shared dynamic programming.

A pre-token is a word with the blank mark of the vocabulary before it. Distinct pre-tokens
are inserted in a trie; a node's forward score, the best sum of piece log probabilities over
the segmentations of the prefix it stands for, and that segmentation's number of pieces are
computed once when the node is made, from the nodes above it, and so shared by all
pre-tokens with the prefix. Terminal counts are stored by word; a document's count is their
sum over its words.

Each Python worker keeps a trie of at most ``MAX_NODES`` nodes, emptied when full (it is a
memory of results, not a limit on words); very long words are scored by themselves.
Counting is one pass over whole texts, without a shuffle.

Piece log probabilities follow the order of the vocabulary file by Zipf's law,
``-log((rank + 1) * H)``: the file is a parameter and is not trained here. A character
outside the vocabulary costs one piece a UTF-8 byte, at ``OUTSIDE`` below the least score.

Defined results: null and empty texts have no words and no tokens; equal scores prefer fewer
pieces; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MAX_NODES = 1_000_000
MAX_WORDS = 500_000
LONG_WORD = 64
OUTSIDE = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> log probability of a vocabulary file, control and byte pieces left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class PieceTrie:
    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES,
                 max_words: int = MAX_WORDS):
        self.pieces, self.max_nodes, self.max_words = pieces, max_nodes, max_words
        self.outside = min(pieces.values(), default=0.0) - OUTSIDE
        self.longest: dict[str, int] = {}       # by last character
        for p in pieces:
            self.longest[p[-1]] = max(len(p), self.longest.get(p[-1], 0))
        self.empty()

    def empty(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]     # of the root
        self.words: dict[bytes, int] = {}

    def forward(self, text: str, end: int, score, count) -> tuple[float, int]:
        """Best score and number of pieces of ``text[:end]``; ``score(i)`` and ``count(i)`` of
        its shorter prefixes are known."""
        last = text[end - 1]
        if last in self.pieces:
            best = score(end - 1) + self.pieces[last], -count(end - 1) - 1
        else:
            n = len(last.encode())
            best = score(end - 1) + n * self.outside, -count(end - 1) - n
        for size in range(2, min(end, self.longest.get(last, 1)) + 1):
            p = self.pieces.get(text[end - size:end])
            if p is not None:
                best = max(best, (score(end - size) + p, -count(end - size) - 1))
        return best[0], -best[1]

    def insert(self, text: str) -> int:
        """Number of pieces of the best segmentation of a pre-token."""
        child, score, count = self.child, self.score, self.count
        path, node = [0], 0
        for i, c in enumerate(text):
            below = child.get((node, c))
            if below is None:
                s, n = self.forward(text, i + 1, lambda k: score[path[k]], lambda k: count[path[k]])
                below = child[node, c] = len(score)
                score.append(s), count.append(n)
            path.append(below)
            node = below
        return count[node]

    def alone(self, text: str) -> int:
        score, count = [0.0], [0]
        for i in range(len(text)):
            s, n = self.forward(text, i + 1, score.__getitem__, count.__getitem__)
            score.append(s), count.append(n)
        return count[-1]

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """Counts of words that are not remembered yet; those not worth it are returned."""
        rest = {}
        if len(self.score) > self.max_nodes or len(self.words) > self.max_words:
            self.empty()
        for w in sorted(words):
            text = MARK + w.decode()
            if len(text) > LONG_WORD or len(self.score) > 2 * self.max_nodes:
                rest[w] = self.alone(text)
            else:
                self.words[w] = self.insert(text)
        return rest


_MADE: dict[str, PieceTrie] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, load_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces = shared.value
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = PieceTrie(pieces)
        trie = _MADE[key]
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column(1).to_pylist():
                words = t.encode().split() if t else []
                got = [*map(trie.words.get, words)]
                if None in got:
                    rest = trie.learn({w for w, g in zip(words, got) if g is None})
                    again = trie.words.get
                    got = [g if g is not None else rest[w] if w in rest else again(w)
                           for w, g in zip(words, got)]
                n_words.append(len(words)), n_tokens.append(sum(got))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
