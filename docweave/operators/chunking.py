"""Overlapping word chunker, narrow (no shuffle).

Chunk ``i`` covers tokens ``[i*step, min(i*step + size, n))`` with ``step = size -
overlap``; the last chunk is the first one that reaches ``n`` (so no chunk lies wholly
inside the previous overlap); chunk text is its tokens joined by one space; a blank text
yields no chunk.

Everything happens inside one row: tokenize once, build the chunk index array, explode.
A blank text produces an *empty* index array instead of being filtered, so the tokenizer
regex is evaluated once per document (a filter on ``size(tokens)`` would be pushed below
the projection and run the regex twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T


def validate_chunk_params(size: int, overlap: int) -> int:
    """Driver-side parameter check; returns the step."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk overlap must satisfy 0 <= overlap < size")
    return size - overlap


def chunk_starts(n_tokens: Column, size: int, step: int) -> Column:
    """ARRAY<INT> of chunk indices for a document of ``n_tokens`` tokens."""
    last = F.when(n_tokens <= size, F.lit(0)).otherwise(
        F.ceil((n_tokens - F.lit(size)) / F.lit(step)).cast("int"))
    return F.when(n_tokens == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), last))


def chunk_struct_array(tokens_col: str, size: int, step: int) -> Column:
    """ARRAY<STRUCT<chunk_id, text_chunk, token_count, start_token, end_token>> in one row.

    ``tokens_col`` must name an already projected ARRAY<STRING> column: a lambda body
    re-evaluates any expression it captures once per element, so the tokenizer must not
    be inlined here. Used where the nested per-document record is wanted (K1) without
    any grouping.
    """
    toks = F.col(tokens_col)
    n = F.size(toks)

    def one(i: Column) -> Column:
        start = i * F.lit(step)
        end = F.least(start + F.lit(size), n)
        return F.struct(
            i.alias("chunk_id"),
            F.array_join(F.slice(toks, start + 1, F.lit(size)), " ").alias("text_chunk"),
            (end - start).alias("token_count"),
            start.alias("start_token"),
            end.alias("end_token"),
        )

    return F.transform(chunk_starts(n, size, step), one)


def chunk_documents(df: DataFrame, text_col: str = "text", size: int = C.CHUNK_SIZE_TOKENS,
                    overlap: int = C.CHUNK_OVERLAP_TOKENS, keep: list[str] | None = None,
                    pre_tokenized: bool = False) -> DataFrame:
    """One row per chunk: ``keep`` columns + chunk_id, token_count, start_token, end_token,
    text_chunk. Narrow: tokenize, index, explode -- no exchange. With ``pre_tokenized``
    ``text_col`` already holds the token array."""
    step = validate_chunk_params(size, overlap)
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    toks = F.col(text_col) if pre_tokenized else T.tokens(text_col)
    tok = df.select(*keep, toks.alias("_tokens"))
    tok = tok.select(*keep, "_tokens", F.size("_tokens").alias("_n"))
    exploded = tok.select(*keep, "_tokens", "_n",
                          F.explode(chunk_starts(F.col("_n"), size, step)).alias("chunk_id"))
    start = F.col("chunk_id") * F.lit(step)
    end = F.least(start + F.lit(size), F.col("_n"))
    return exploded.select(
        *keep,
        F.col("chunk_id").cast("int").alias("chunk_id"),
        (end - start).cast("int").alias("token_count"),
        start.cast("int").alias("start_token"),
        end.cast("int").alias("end_token"),
        F.array_join(F.slice("_tokens", start + 1, F.lit(size)), " ").alias("text_chunk"),
    )
