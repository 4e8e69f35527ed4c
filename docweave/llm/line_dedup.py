"""Line dedup: normalised lines are exploded and hashed, the distinct documents of each hash
counted, lines found in too many documents dropped, and texts reassembled by position.

A document gives each of its line hashes once, so counting rows counts documents and is
combined before the shuffle. The hashes that many documents share are met by the lines in
two ways: the few that hold a hundred-thousandth of the lines each are broadcast (at most
100,000 of them at any size), the others are joined by shuffling. What comes back to a
document is the list of its dropped positions, found by a key made of id and text; a long
run of kept lines is cut out of the line array by slices, so reassembly needs as many steps
as a text has lines.

Defined results: a null or empty text is one empty line; a line shorter than ``min_chars``
after normalising is never dropped; each row is a document, so rows that repeat an id and a
text count as often as they occur and get the same result; null ids are kept; an empty table
gives no rows; other columns are ignored. A text must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import HEAVY_KEYS, ascii_lower, join_split, let, text_or_empty, two_hashes

MIN_DOCS = 10
MIN_CHARS = 1
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line the two hashes of its key, null where the key is too short to count."""
    def one(key: Column) -> Column:
        a, b = two_hashes(key)
        return F.when(F.char_length(key) >= min_chars, F.struct(a.alias("a"), b.alias("b")))

    return F.transform(F.split(text, "\n"), lambda x: let(line_key(x), one))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    return rows.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``a, b, n``: hashes found in ``min_docs`` documents or more, with that number."""
    def distinct(s: Column) -> Column:     # of a sorted array: array_distinct compares all pairs
        return F.filter(s, lambda x, k: (k == 0) | (x != F.get(s, k - 1)))

    once = let(F.sort_array(F.filter("lines", lambda x: x.isNotNull())), distinct)
    return (lines.select(F.explode(once).alias("h")).groupBy("h.a", "h.b")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).checkpoint())


def dropped_lines(lines: DataFrame, repeated: DataFrame,
                  heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``k1, k2, dropped``: sorted positions (from 0) of the lines a document loses."""
    at = lines.select("k1", "k2", F.posexplode("lines").alias("pos", "h")).where("h is not null")
    hits = join_split(at.select("k1", "k2", "pos", "h.a", "h.b"), repeated, ["a", "b"], "n",
                      heavy_keys=heavy_keys)
    return hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the sorted positions ``dropped``: the slices between them."""
    def runs(bound: Column) -> Column:
        def run(p: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(bound["d"], k - 1))
            return F.slice(bound["l"], before + 2, p - before - 1)

        ends = F.concat(bound["d"], F.array(F.size(bound["l"])))
        return F.flatten(F.transform(ends, run))

    return let(F.struct(lines.alias("l"), dropped.alias("d")), runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, text`` (its other lines joined)."""
    keyed = _keyed(docs, id_col, text_col)
    lines = keyed.select("k1", "k2", _hashes(F.col("text"), min_chars).alias("lines")).checkpoint()
    dropped = dropped_lines(lines, repeated_lines(lines, min_docs), heavy_keys)
    none = F.array().cast("array<int>")
    found = (keyed.join(dropped, ["k1", "k2"], "left")
             .select("doc_id", F.split("text", "\n").alias("l"), "text",
                     F.coalesce("dropped", none).alias("d")))
    kept = F.when(F.size("d") == 0, F.col("text")).otherwise(
        F.array_join(_without(F.col("l"), F.col("d")), "\n"))
    return found.select("doc_id", F.size("l").cast("long").alias("n_lines"),
                        F.size("d").cast("long").alias("n_dropped"), kept.alias("text"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l
           FROM documents),
x AS (SELECT r, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key
      HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT r, pos, line, key IN (SELECT key FROM f) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r, doc_id"""
