"""Quality rules: a threshold table compiled into one projection.

The rules are rows ``(measure, lowest, highest)`` over length, symbol, stop-word and line
ratios. All measures and the verdict are Spark expressions on the document's own row: no
user function, no shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``. Words in repeated 3-word windows are counted by sorting
the windows of a text and comparing neighbours, which is exact and needs O(n log n) steps
for a text of n words; it is skipped when the windows' hashes are all distinct.

Defined results: a null text has no words; a text without words has ratios of zero; repeated
rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACE_CLASS, UPPER, let, text_or_empty, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Function words of the supported languages (fixed values, natural order).
STOP_WORDS = (
    "the be to of and that have with is in it for was are by this on as at from "
    "der die das und ist mit von zu ein eine nicht auf den im "
    "le la les des et est que qui dans un une pour sur en de du "
    "el los las y es del se con por una para").split()

# measure, lowest, highest (inclusive; None: no limit)
THRESHOLDS = (
    ("mean_word_length", 2.0, 12.0),
    ("symbol_ratio", None, 0.3),
    ("upper_ratio", None, 0.4),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.6),
    ("distinct_word_ratio", 0.05, None),
)


def _stop_list() -> list[str]:
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


def n_repeat_words(w: Column) -> Column:
    """Words of the array ``w`` inside 3-word windows that occur twice or more in it."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
        i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                          F.lit(False))

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:       # windows at sorted starts p cover so many words
        gaps = F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    slow = let(let(windows, repeated), covered)
    all_distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((F.size(w) < 4) | all_distinct, F.lit(0).cast("long")).otherwise(slow)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of each text and the ratios the threshold table refers to."""
    def without(chars: str) -> Column:
        return F.translate(F.col("t"), chars, "")

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"), lines.alias("l"))
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.char_length(without(SPACES)).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(without(SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
        (F.char_length("t") - F.char_length(without(UPPER))).alias("n_upper"),
        F.size("l").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size(F.filter("w", lambda x: x.isin(_stop_list()))).alias("n_stop"))

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return rows.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_stop", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_distinct", "n_words").alias("distinct_word_ratio"))


def compile_rules(rules=THRESHOLDS) -> Column:
    """One boolean expression: every measure within its limits."""
    tests = [F.col(m) >= F.lit(lo) for m, lo, _ in rules if lo is not None]
    tests += [F.col(m) <= F.lit(hi) for m, _, hi in rules if hi is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rules=THRESHOLDS) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` (the table's verdict)."""
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return measure(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))


def _oracle() -> str:
    space = r"[^\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in _stop_list())
    tests = " AND ".join([f"{m} >= {lo}" for m, lo, _ in THRESHOLDS if lo is not None]
                         + [f"{m} <= {hi}" for m, _, hi in THRESHOLDS if hi is not None])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '{space}+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM t),
tri AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(*) AS n_repeat_words FROM (
          SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(t) - length(translate(t, '{UPPER}', '')) AS n_upper, len(l) AS n_lines,
        len(list_distinct(w)) AS n_distinct,
        len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
      FROM a LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
        coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
        coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio,
        coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
        coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
        coalesce(n_distinct / nullif(n_words, 0), 0) AS distinct_word_ratio,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {tests} AS kept
FROM r"""


ORACLE_SQL = _oracle()
