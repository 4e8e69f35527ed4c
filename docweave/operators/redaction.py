"""PII redaction operators: P8 pattern redaction, P9 span splicing, J6 gazetteer names,
A1-A3 counts and rollups, A14 residual audit.

All per-document work is row-local (no shuffle); only the corpus rollups aggregate, and
those use partial (map-side) aggregation so a hot source or language never ships its rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from docweave import constants as C
from docweave.functions import pii as P
from docweave.functions import text as T

MAX_NAMES = 2_000

SPAN_TYPE = TY.StructType([
    TY.StructField("type", TY.StringType()),
    TY.StructField("begin", TY.IntegerType()),
    TY.StructField("end", TY.IntegerType()),
])
SPANS_TYPE = TY.ArrayType(SPAN_TYPE)


def redact_documents(df: DataFrame, text_col: str = "text", out_col: str = "redacted_text",
                     keep_original: bool = False) -> DataFrame:
    """P8 + A1 + A2: pattern redaction with per-label counts.

    Adds ``n_credit_card, n_ssn, n_phone, n_email`` (BIGINT), ``pii_entity_counts``
    (MAP<STRING,INT>, labels with a non-zero count only), ``pii_masked_flag`` and
    ``out_col``. Each label is counted on the text as it is just before that label is
    replaced; the replacement is skipped when the count is 0, and a pattern is not run at
    all when its cheap necessary condition (four consecutive digits / an '@') fails on
    the original text. Each step is its own projection so every regex runs once per row.
    """
    cols = [c for c in df.columns if keep_original or c != text_col]
    cur = "_redact_0"
    out = df.select(*cols, F.col(text_col).alias(cur),
                    P.guard("CREDIT_CARD", F.col(text_col)).alias("_g_digits"),
                    P.guard("EMAIL", F.col(text_col)).alias("_g_at"))
    count_cols = []
    for i, (label, pattern) in enumerate(P.PII_PATTERNS, start=1):
        cnt = P.count_column(label)
        nxt = f"_redact_{i}"
        g = F.col("_g_digits") if label in P.DIGIT_LABELS else F.col("_g_at")
        out = out.withColumn(cnt, F.when(g, F.regexp_count(F.col(cur), F.lit(pattern)))
                             .otherwise(F.lit(0)).cast("bigint"))
        out = out.select(
            *[c for c in out.columns if c != cur],
            F.when(F.col(cnt) > 0, F.regexp_replace(F.col(cur), pattern, P.marker(label)))
             .otherwise(F.col(cur)).alias(nxt))
        cur = nxt
        count_cols.append((label, cnt))
    entries = []
    for label, cnt in count_cols:
        entries += [F.lit(label), F.col(cnt).cast("int")]
    counts_map = F.map_filter(F.create_map(*entries), lambda k, v: v > 0)
    flag = F.greatest(*[F.col(c) for _, c in count_cols]) > 0
    return out.select(*[c for c in out.columns if c not in (cur, "_g_digits", "_g_at")],
                      counts_map.alias("pii_entity_counts"),
                      flag.alias("pii_masked_flag"),
                      F.col(cur).alias(out_col))


def mask_names(df: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """NAME masking by a bounded list of names, in the row: ``text_col`` with every listed
    name that stands by itself replaced by its marker, and the number as ``n_name``.

    The list becomes one alternation, longest name first, so it must stay within
    ``MAX_NAMES``; :func:`gazetteer_spans` joins larger lists."""
    if len(names) > MAX_NAMES:
        raise ValueError(f"{len(names)} names; at most {MAX_NAMES} fit one pattern")
    if not names:
        return df.withColumn("n_name", F.lit(0).cast("bigint"))
    any_of = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{any_of})(?![\p{{L}}\p{{N}}])"
    out = df.withColumn("n_name", F.coalesce(F.regexp_count(F.col(text_col), F.lit(pattern)),
                                             F.lit(0)).cast("bigint"))
    return out.withColumn(text_col, F.when(
        F.col("n_name") > 0, F.regexp_replace(F.col(text_col), pattern, P.marker("NAME")))
        .otherwise(F.col(text_col)))


def resolve_overlaps(spans: Column) -> Column:
    """X4 fix: keep a non-overlapping subset of spans.

    Spans are ordered by begin, then longest first, then type; a span is kept when it
    starts at or after the end of the last kept span. Disjoint input is returned whole.
    """
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["begin"] < b["begin"], -1)
        .when(a["begin"] > b["begin"], 1)
        .when(a["end"] > b["end"], -1)
        .when(a["end"] < b["end"], 1)
        .when(a["type"] < b["type"], -1)
        .when(a["type"] > b["type"], 1)
        .otherwise(0))
    empty = F.array().cast(SPANS_TYPE)
    return F.aggregate(
        ordered, empty,
        lambda acc, s: F.when(
            (F.size(acc) == 0) | (s["begin"] >= F.element_at(acc, -1)["end"]),
            F.concat(acc, F.array(s))).otherwise(acc))


def splice_spans(text: Column, spans: Column, labels: dict[str, str] | None = None) -> Column:
    """Replace each span by ``[REDACTED_<LABEL>]``; the pieces are built once and joined.

    Offsets are code points, end-exclusive. Types outside ``labels`` (default: the five
    accepted detector types) are ignored; overlapping spans are resolved first.
    """
    labels = labels or C.PII_TYPE_LABELS
    label_map = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    accepted = F.filter(spans, lambda s: label_map[s["type"]].isNotNull())

    def pieces(kept: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, before + 1, s["begin"] - before),
                            F.lit(C.REDACTION_MARKER_PREFIX), label_map[s["type"]],
                            F.lit(C.REDACTION_MARKER_SUFFIX))

        rest = F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
        return F.concat(F.transform(kept, piece),
                        F.array(F.substring(text, rest + 1, F.lit(2147483647))))

    once = F.transform(F.array(resolve_overlaps(accepted)), pieces)     # spans evaluated once
    return F.array_join(F.element_at(once, 1), "")


def span_label_counts(spans: Column, labels: dict[str, str] | None = None) -> Column:
    """A1 over spans: MAP<label, INT> of accepted, overlap-resolved spans."""
    labels = labels or C.PII_TYPE_LABELS
    label_map = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    kept = resolve_overlaps(F.filter(spans, lambda s: label_map[s["type"]].isNotNull()))
    names = F.transform(kept, lambda s: label_map[s["type"]])
    return F.map_from_arrays(
        F.array_distinct(names),
        F.transform(F.array_distinct(names),
                    lambda n: F.size(F.filter(names, lambda m: m == n)).cast("int")))


def gazetteer_spans(df: DataFrame, names: DataFrame, text_col: str = "text",
                    id_col: str = "doc_id", max_broadcast_names: int = 1_000_000) -> DataFrame:
    """NAME detection by joining token uni- and bi-grams to a name list.

    ``names`` has one column ``name`` (one or two words, matched case-sensitively on
    whole tokens). Returns ``(id_col, name, token_index, ngram)`` hits. The name list is a
    small dimension: it is broadcast when its row count is within ``max_broadcast_names``
    (checked here), otherwise the planner joins it by shuffle.
    """
    toks = df.select(id_col, T.tokens(text_col).alias("_tok"))
    pairs = F.zip_with(F.col("_tok"),
                       F.slice("_tok", 2, F.greatest(F.size("_tok") - 1, F.lit(0))),
                       lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    grams = toks.select(id_col, F.posexplode(pairs).alias("token_index", "g"))
    # strip trailing punctuation from a token before lookup ("Smith," -> "Smith")
    w1 = F.regexp_replace(F.col("g.w1"), r"[^\p{L}\p{N}]+$", "")
    w2 = F.regexp_replace(F.col("g.w2"), r"[^\p{L}\p{N}]+$", "")
    uni = grams.select(id_col, "token_index", w1.alias("ngram"), F.lit(1).alias("ngram_len"))
    bi = grams.where(F.col("g.w2").isNotNull()).select(
        id_col, "token_index", F.concat_ws(" ", F.col("g.w1"), w2).alias("ngram"),
        F.lit(2).alias("ngram_len"))
    dim = names.select(F.col("name").alias("ngram")).distinct()
    if names.limit(max_broadcast_names + 1).count() <= max_broadcast_names:
        dim = F.broadcast(dim)
    hits = uni.unionByName(bi).join(dim, on="ngram", how="inner")
    return hits.select(id_col, F.col("ngram").alias("name"), "token_index", "ngram_len")


def residual_pii(df: DataFrame, text_col: str = "text_chunk") -> DataFrame:
    """Pattern matches left in (already redacted) text, one column per label."""
    return df.select("*", *[P.residual_count(F.col(text_col), label)
                            .alias(f"residual_{label.lower()}") for label in P.PII_LABELS])


def pii_rollup(redacted: DataFrame, dims: list[str]) -> DataFrame:
    """A3: PII totals by ``dims`` with subtotal and grand-total rows (``rollup``)."""
    aggs = [F.sum(P.count_column(l)).cast("bigint").alias(f"sum_{l.lower()}") for l in P.PII_LABELS]
    aggs += [F.count_if(F.col("pii_masked_flag")).cast("bigint").alias("masked_docs"),
             F.count(F.lit(1)).cast("bigint").alias("docs")]
    return redacted.rollup(*dims).agg(*aggs)
