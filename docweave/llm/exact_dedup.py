"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

``freqItems`` (the Karp-Shenker-Papadimitriou form of Misra-Gries) finds every digest that
more than ``support`` of the rows carry, and perhaps a few others: at most ``1/support``
candidates. Their exact counts and winners are verified by one map-side aggregation and
broadcast, so the rows of hot digests are decided where they are and never shuffled. The
remaining digests, none of which can hold more than ``support`` of the rows, are grouped
with ordinary shuffles.

Defined results: a null text counts as empty; a null id sorts below every id and a group
of null ids keeps one row with a null ``keep_id``; of rows that repeat an id and text one
stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, fresh, keep_rows, row_key, text_or_empty

SUPPORT = 0.001


def text_digest(text_col: str) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lower-cased (null: empty text)."""
    return F.sha2(ascii_lower(text_or_empty(text_col)), 256)


def heavy_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``sha, win, n`` of the frequent digests: at most ``1/support`` rows, counts exact."""
    found = keyed.select("sha").freqItems(["sha"], support)
    candidates = found.select(F.explode("sha_freqItems").alias("sha"))
    return (keyed.join(F.broadcast(candidates), "sha", "left_semi")
            .groupBy("sha").agg(F.max(F.struct("id", "row")).alias("win"),
                                F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).checkpoint())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. The text is read and hashed once;
    everything after works on the checkpointed (id, digest) table."""
    keyed = docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("sha"),
                        F.monotonically_increasing_id().alias("row")).checkpoint()
    winners = heavy_winners(keyed, support)
    hot = keyed.join(F.broadcast(winners), "sha")
    rest = keyed.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    groups = rest.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("win"),
                                     F.count(F.lit(1)).alias("n"))
    return hot.unionByName(rest.join(groups, "sha")).select(
        F.col("id").alias("doc_id"), F.col("win.id").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row") == F.col("win.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, columns unchanged."""
    kept = exact_dedup(docs, id_col, text_col, support).where("kept")
    name = fresh(docs, "_llm_keep")

    kept = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(name))
    return keep_rows(docs, kept, row_key(F.col(id_col), text_digest(text_col)), name)


ORACLE_SQL = """
WITH k AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256)"""
