"""Filter interaction audit by the potential of the removal game.

A document fails some of five filters. The documents that a set S of filters removes between
them, v(S), are a cooperative game, and its potential is defined by recursion over the 32
coalitions: P({}) = 0 and P(S) = (v(S) + sum of P(S - i) for i in S) / |S|. A filter's Shapley
value is P(all) - P(all - i); what step k of an order removes is v(first k) - v(first k - 1).
Potentials are held as 120 P(S), which is an integer for five filters, so nothing is rounded.

Documents are reduced to four bits and a digest where they are. The smallest id of each
repeated text is found by an aggregation that combines before its shuffle and is met by the
documents through ``join_split``, so a text that holds a third of the rows stays where it is.
Counts per part and mask combine before their shuffle too; a part then is one row of at most
32 masks, and its game is worked out in that row.

Defined results: a null text is empty; a null source is the part ``''``, together with empty
sources; a document is good (toxic) if any label row of its id says so; a null id has no
label, is no smaller id and has no smaller id, so it never fails E; rows that repeat an id and
a text are equal, not copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import HEAVY_KEYS, join_split, text_or_empty, two_hashes, words_of

LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
ALL = (1 << len(LETTERS)) - 1
SCALE = factorial(len(LETTERS))


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    w = words_of(text)
    tests = (F.size(w) < MIN_WORDS,
             100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
             100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.char_length(text),
             text.rlike(SYMBOLS))
    mask = F.lit(0)
    for bit, test in enumerate(tests):
        mask = mask + F.when(test, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def _flags(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    def any_one(name: str) -> Column:
        return F.coalesce(F.max(F.col(name) == 1), F.lit(False))

    return (labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("q"),
                          F.col(toxic_col).alias("x"))
            .where("id is not null").groupBy("id")
            .agg(any_one("q").alias("good"), any_one("x").alias("toxic")))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic",
          heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and filters they fail, with labels."""
    a, b = two_hashes(F.col("t"))
    rows = (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"),
                        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
            .select("id", "part", a.alias("a"), b.alias("b"), text_mask(F.col("t")).alias("m"))
            .checkpoint())
    copies = (rows.groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c"))
              .where("c > 1").checkpoint())
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = join_split(rows, copies, ["a", "b"], "c", "left", heavy_keys).select(
        "id", "part", (F.col("m") + F.when(later, 16).otherwise(0)).alias("mask"))
    flagged = rows.where("id is not null").join(
        _flags(labels, id_col, quality_col, toxic_col), "id", "left")
    flagged = flagged.unionByName(rows.where("id is null"), allowMissingColumns=True)
    return flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"),
        F.count_if(F.col("toxic")).alias("toxic"))


def _worth(count: str) -> Column:
    """v(S) of every coalition S, by its bits: the documents that fail any filter of S."""
    def removed(s: Column) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda v, x: v + F.when(
            x["mask"].bitwiseAND(s) != 0, x[count]).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), removed)


def potentials(v: Column) -> Column:
    """120 P(S) of every coalition by its bits, from the array ``v`` of v(S)."""
    bits = [1 << i for i in range(len(LETTERS))]

    def next_one(p: Column, s: Column) -> Column:      # S without a filter is a smaller number
        below = sum((F.when(s.bitwiseAND(bit) != 0, F.get(p, s - bit)).otherwise(0)
                     for bit in bits), SCALE * F.get(v, s))
        return F.concat(p, F.array(F.call_function("div", below, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), next_one)


def _steps() -> Column:
    """Every step of every order: its filter's bit and the coalitions before and after it."""
    found = []
    for order in ORDERS:
        bits = [1 << LETTERS.index(letter) for letter in order]
        found += [{"filter_order": order, "step": k + 1, "bit": bit, "before": sum(bits[:k]),
                   "after": sum(bits[:k + 1])} for k, bit in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order:string,step:int,"
                                                 "bit:int,before:int,after:int>>")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "source", quality_col: str = "quality",
                 toxic_col: str = "toxic", heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    counted = masks(docs, labels, id_col, text_col, part_col, quality_col, toxic_col, heavy_keys)
    games = (counted.groupBy("part").agg(
                F.sum("n").alias("n"),
                F.collect_list(F.struct("mask", F.col("n").alias("v"), F.col("good").alias("g"),
                                        F.col("toxic").alias("x"))).alias("masks"))
             .select("part", "n", *(_worth(c).alias(c) for c in "vgx")).withColumn(
                 "p", potentials(F.col("v"))))
    rows = games.select("*", F.explode(_steps()).alias("s"))

    def gain(c: str) -> Column:
        return F.get(c, F.col("s.after")) - F.get(c, F.col("s.before"))

    def marginal(c: str) -> Column:
        return F.get(c, F.lit(ALL)) - F.get(c, ALL - F.col("s.bit"))

    return rows.select(
        "part", "s.filter_order", "s.step", (F.col("n") - F.get("v", F.col("s.after"))).alias("kept"),
        gain("v").alias("removed"), (F.get("v", F.col("s.bit")) - gain("v")).alias("redundant"),
        marginal("v").alias("unique_fails"), gain("g").alias("good_lost"),
        gain("x").alias("toxic_lost"), marginal("p").alias("shapley"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT r, part, len(w) < {MIN_WORDS} AS a,
             100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_UPPER_PERCENT} * length(t) AS c,
             regexp_matches(t, '{SYMBOLS}') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [x.k, y.k, z.k, u.k, v.k] AS ks FROM i x, i y, i z, i u, i v
      WHERE len(list_distinct([x.k, y.k, z.k, u.k, v.k])) = 5),
s AS (SELECT ks, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, ks, step, ks[step] AS k, n, good, toxic, fails[ks[step]] AS own,
        list_bool_or(list_transform(ks[1:step - 1], lambda j: fails[j])) AS gone,
        len(list_filter(fails, lambda x: x)) AS n_fails FROM m, s),
q AS (SELECT part, ks, step, k,
        sum(CASE WHEN NOT own AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN own AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN own AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN own AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS toxic_lost
      FROM g GROUP BY part, ks, step, k)
SELECT part, array_to_string(list_transform(ks, lambda j: '{LETTERS}'[j]), '') AS filter_order,
       step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM q"""
