"""Language ID by word-first backoff.

A word the model knows scores its log frequency in each language; an unseen word falls back
to its character n-grams, the longest length of which any is known, down to single
characters. Word scores add up; the language of the largest sum is predicted and its softmax
share is the score.

The model is fitted on a bounded sample of the labelled rows (``fit_rows`` in expectation,
each row drawn by itself) and holds at most ``max_words`` words and ``max_grams`` n-grams
of each length per language, so it is broadcast at a size that does not grow with the
corpus; with many languages each has its share of ``MODEL_CELLS``. Prediction is one pass over the whole texts in Arrow batches, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text when there is nothing to learn from; ties go to the language first in the alphabet; a
null id counts as not held out; repeated rows give repeated rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import fresh, sampled

UNDETERMINED = "und"
FIT_ROWS = 20_000
MAX_WORDS = 30_000
MAX_GRAMS = 10_000
GRAM_SIZES = (4, 3, 2, 1)
MODEL_CELLS = 30_000_000     # of the matrix (entries by languages), 240 MB; 20 languages fill it
MEMO_ENTRIES = 250_000


def held_out(id_col: str) -> Column:
    """Remainder 1 of crc32(id as text) by 3: never learned from."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, id_col: str, fit_rows: int, seed: int = 17) -> DataFrame:
    """About ``fit_rows`` of the rows. ``id_col`` takes no part: ids may be null or repeat."""
    return sampled(rows, fit_rows, seed)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS) -> dict:
    """The bounded model (see :func:`pack`) of a sample of the rows that are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()
                      & F.col(text_col).isNotNull())
    rows = bounded_sample(rows, id_col, fit_rows)
    letters = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0))
    counts = (rows.select(F.col(lang_col).alias("lang"), F.explode(letters).alias("part"))
              .groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).checkpoint())
    marked = F.concat(F.lit("^"), "part", F.lit("$"))
    sizes = F.array(*[F.lit(k) for k in GRAM_SIZES])
    grams = F.flatten(F.transform(sizes, lambda k: F.when(
        F.length(marked) >= k, F.transform(F.sequence(F.lit(1), F.length(marked) - k + 1),
                                           lambda i: F.substring(marked, i, k)))
        .otherwise(F.array().cast("array<string>"))))
    grams = (counts.select("lang", "n", F.explode(grams).alias("part"))
             .groupBy("lang", "part").agg(F.sum("n").alias("n")))

    def most(df: DataFrame, limit: int, *by) -> list:
        w = Window.partitionBy("lang", *by).orderBy(F.desc("n"), "part")
        return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
                .select("lang", "part", "n").collect())

    cells = (counts.select("lang").distinct().count() ** 2) * (max_words + len(GRAM_SIZES) * max_grams)
    share = min(1.0, MODEL_CELLS / max(1, cells))
    words = most(counts, max(1, int(share * max_words)))
    grams = most(grams, max(1, int(share * max_grams)), F.length("part"))
    langs = sorted({r.lang for r in words})

    def table(found: list) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for r in found:
            out.setdefault(r.part, np.zeros(len(langs)))[langs.index(r.lang)] = r.n
        return out

    def logs(counted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total = sum(counted.values(), np.zeros(len(langs))) + 0.5 * (len(counted) + 1)
        return {k: np.log((v + 0.5) / total) for k, v in counted.items()}

    by_size: dict[int, dict] = {}
    for part, v in table(grams).items():
        by_size.setdefault(len(part), {})[part] = v
    return pack(langs, logs(table(words)), {k: logs(v) for k, v in by_size.items()})


def pack(langs: list[str], words: dict, grams: dict[int, dict]) -> dict:
    """The model as one matrix of log frequencies and tables of its rows; row 0 is zero."""
    vectors = [np.zeros(len(langs))]

    def rows(table: dict) -> dict[str, int]:
        first = len(vectors)
        vectors.extend(table.values())
        return {part: first + i for i, part in enumerate(table)}

    return {"langs": langs, "words": rows(words), "grams": {k: rows(t) for k, t in grams.items()},
            "matrix": np.array(vectors).reshape(len(vectors), len(langs)), "key": uuid.uuid4().hex}


class Scorer:
    """Scores texts by a fitted model; scores of unseen words are remembered, in bounded
    number, as further rows of the model's matrix."""

    find = staticmethod(re.compile(r"[^\W\d_]+").findall)

    def __init__(self, model: dict, memo: int = MEMO_ENTRIES):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.known = len(model["matrix"])
        self.rows = np.concatenate([model["matrix"], np.zeros((memo, len(self.langs)))])
        self.forget()

    def forget(self) -> None:
        self.at, self.used = dict(self.words), self.known

    def back_off(self, word: str) -> np.ndarray:
        """Mean log frequencies of the longest n-grams of which any is known."""
        marked = f"^{word}$"
        for k in GRAM_SIZES:
            table = self.grams.get(k, {})
            found = [table[g] for i in range(len(marked) - k + 1) if (g := marked[i:i + k]) in table]
            if found:
                return self.rows[found].mean(axis=0)
        return self.rows[0]

    def learn(self, token: str) -> int:
        """Row of an unseen word's score; -1 if it has no letter."""
        word = token if token.isalpha() else "".join(c for c in token if c.isalpha())
        row = self.words.get(word, -1)
        if word and row < 0:
            if self.used == len(self.rows):
                return -2                       # no room: scored by itself
            row, self.used = self.used, self.used + 1
            self.rows[row] = self.back_off(word)
        self.at[token] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        if self.used > self.known + (len(self.rows) - self.known) // 2:
            self.forget()
        tokens = self.find(text.lower())
        ids = [*map(self.at.get, tokens)]
        total = np.zeros(len(self.langs))
        if None in ids:
            known, learn = self.at.get, self.learn
            ids = [i if (i := known(t)) is not None else learn(t) for t in tokens]
            for i, t in zip(ids, tokens):
                if i == -2:
                    total += self.back_off("".join(c for c in t if c.isalpha()))
        if all(i == -1 for i in ids):
            return UNDETERMINED, 0.0
        total += self.rows[[i for i in ids if i >= 0]].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], 1.0 / float(np.exp(np.minimum(total - total[best], 0)).sum())


_MADE: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: dict, text_col: str = "text",
             keep: list[str] | None = None, pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) with the prediction and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m["key"] not in _MADE:
            _MADE.clear()
            _MADE[m["key"]] = Scorer(m)
        scorer = _MADE[m["key"]]
        for b in batches:
            found = [scorer.predict(t) for t in b.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:last], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [*keep, pred, score])

    rows = docs.select(*keep, F.col(text_col).alias("_llm_text"))
    schema = docs.select(*keep).schema.add(pred, "string").add(score, "double")
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", **limits) -> DataFrame:
    """Fit and predict: ``doc_id, held_out, lang_pred, score`` per document."""
    model = fit(docs, id_col, text_col, lang_col, **limits)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return identify(rows, model, keep=["doc_id", "held_out"])


def keep_identified(docs: DataFrame, min_score: float = 0.5, **limits) -> DataFrame:
    """``docs`` without those whose language cannot be told (``und``, or a score below
    ``min_score``), columns unchanged."""
    pred, score = fresh(docs, "_llm_pred"), fresh(docs, "_llm_score")
    found = identify(docs, fit(docs, **limits), pred=pred, score=score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= min_score)).select(
        *docs.columns)


