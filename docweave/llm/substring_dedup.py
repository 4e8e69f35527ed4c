"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and these into their clauses: after ``.!?,;:`` and white space,
and at line ends. A span is a run of at least ``run`` consecutive clauses, as many as reach
``min_words`` words; a run of fewer with at least ``long_words`` words is a span too, so that
a long passage of one clause is found. Clauses let a passage that begins and ends inside a
sentence be reached but for its first and last piece; the number of words keeps phrases that
unrelated texts share from being spans. Not removed are those two pieces, and a passage that
has no span between them. Every span is hashed and the hashes are
joined over the whole corpus: of the places a span occurs at, the first by (id, sentence)
stays, and the sentences covered by any other are removed.

The join moves hashes and character offsets, never text. Hashes are counted with map-side
combination and only those that repeat are joined back. The few that hold more than
``HOT_SHARE`` of all places (at most its inverse) are aggregated map-side and broadcast, so a
span that very many documents share is never gathered in one task. :func:`removed_spans` gives what each
document loses; :func:`apply_removals` cuts it out of the texts where these are wanted.

Defined results: null and empty texts have no sentences and stay as they are; rows that
repeat an id and a text count as one place and lose the same sentences; a null id comes
before every id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import fresh, staged

RUN = 2
MIN_WORDS = 12
LONG_WORDS = 50
HOT_SHARE = 0.001        # spans that hold this share of all places are joined by broadcast

_END = re.compile(r"[.!?,;:]\s+|\n\s*")


def sentences(text: str) -> list[str]:
    """The clauses of a text, white space included: joined they give the text back."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def spans(text: str, run: int = RUN, min_words: int = MIN_WORDS,
          long_words: int = LONG_WORDS) -> tuple[list[int], list[int], list[int]]:
    """``(starts, ends, hashes)`` of the spans of a text; offsets are code points."""
    keys, words, at = [], [0], [0]
    for s in sentences(text):
        parts = s.split()
        keys.append(" ".join(parts).encode())
        words.append(words[-1] + len(parts))
        at.append(at[-1] + len(s))
    start, end, hashes = [], [], []

    def add(i: int, j: int) -> None:
        h = hashlib.blake2b(b"\n".join(keys[i:j]), digest_size=8).digest()
        start.append(at[i]), end.append(at[j]), hashes.append(int.from_bytes(h, "little", signed=True))

    n, j = len(keys), 0
    for i in range(n):
        if keys[i]:
            for k in range(i + 1, min(i + run, n + 1)):
                if words[k] - words[i] >= long_words:
                    add(i, k)
                    break
            j = max(j, i + run)
            while j <= n and words[j] - words[i] < min_words:
                j += 1
            if j <= n:
                add(i, j)
    return start, end, hashes


def span_rows(docs: DataFrame, run: int, min_words: int, long_words: int) -> DataFrame:
    """``id, th, start, end, hash`` of every span of ``docs(id, th, t)``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cols = [], ([], [], [])
            for i, t in enumerate(b.column(2).to_pylist()):
                got = spans(t, run, min_words, long_words) if t else ((), (), ())
                take += [i] * len(got[0])
                for c, g in zip(cols, got):
                    c += g
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()),
                 pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())],
                ["id", "th", "start", "end", "hash"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "th", "t").mapInArrow(
        work, f"id {kind}, th long, start int, end int, hash long")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans as sorted lists of disjoint spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        out = []
        for some in b.column(2).to_pylist():
            merged: list[dict] = []
            for s in sorted(some, key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            out.append(merged)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)],
                                         ["id", "th", "removed"])


def removals(docs: DataFrame, run: int, min_words: int, long_words: int) -> DataFrame:
    """``id, th, removed`` (disjoint spans) of the documents that lose some."""
    found = staged(span_rows(docs, run, min_words, long_words), "spans").select(
        "hash", F.struct("id", "th", "start").alias("at"), "end")
    repeated = staged(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hashes")
    least = max(2, int(found.count() * HOT_SHARE))
    hot = repeated.where(F.col("n") >= least).select("hash").checkpoint()      # at most 1 / HOT_SHARE rows
    hot_rows = found.join(F.broadcast(hot), "hash", "left_semi")
    hot_keep = hot_rows.groupBy("hash").agg(F.min("at").alias("keep"))
    shared = staged(found.join(F.broadcast(hot), "hash", "left_anti")
                    .join(repeated.where(F.col("n") < least).select("hash"), "hash", "left_semi"), "shared")
    keep = shared.groupBy("hash").agg(F.min("at").alias("keep"))
    later = (hot_rows.join(F.broadcast(hot_keep), "hash").unionByName(shared.join(keep, "hash"))
             .where(~F.col("at").eqNullSafe(F.col("keep"))))
    lists = later.groupBy("at.id", "at.th").agg(
        F.collect_set(F.struct(F.col("at.start").alias("start"), "end")).alias("spans"))
    kind = lists.schema["id"].dataType.simpleString()
    return lists.mapInArrow(_merge, f"id {kind}, th long, removed array<struct<start:int,end:int>>")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                  min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_removed`` (characters) and ``removed`` (disjoint character spans
    ``start, end``) per document; none lost: an empty list."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.col(text_col).alias("t"))
    drops = removals(rows, run, min_words, long_words).select(
        F.col("id").alias("did"), F.col("th").alias("dth"), "removed")
    rows = rows.select("id", "th")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.join(drops, rows["id"].eqNullSafe(drops["did"]) & (rows["th"] == drops["dth"]), "left").select(
        F.col("id").alias("doc_id"), F.col("th").alias("text_hash"),
        F.aggregate(F.coalesce("removed", none), F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.coalesce("removed", none).alias("removed"))


def apply_removals(docs: DataFrame, found: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``found`` cut out of their texts. Texts are shuffled once;
    the spans of rows that lose nothing are left out of the join."""
    h, i, r = (fresh(docs, c) for c in ("_llm_hash", "_llm_id", "_llm_removed"))
    cuts = found.where("n_removed > 0").select(
        F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("removed").alias(r)).distinct()
    joined = docs.join(cuts, docs[id_col].eqNullSafe(cuts[i]) & (F.xxhash64(docs[text_col]) == cuts[h]), "left")
    ends = F.concat(F.transform(F.col(r), lambda s: s["start"]), F.array(F.char_length(text_col)))
    begins = F.concat(F.array(F.lit(0)), F.transform(F.col(r), lambda s: s["end"]))
    left = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col(text_col), a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col(r).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
