"""T3 hashing embedder, F10 dimension guard, U2 embedder hook.

Default embedder: signed feature hashing of lower-cased whitespace tokens.
For token ``t`` with ``h = md5(t)`` (hex): ``bucket = int(h[0:8], 16) mod d`` and
``sign = +1`` when ``int(h[8], 16)`` is even, else ``-1``. The vector is the per-bucket
sum of signs divided by its L2 norm; a text without tokens (or whose signs cancel to
zero) has no vector (NULL) instead of a division by zero.

Execution: md5 and bucket codes are computed JVM-side per token; one Arrow-batched
pandas UDF turns each row's code array into a dense vector with ``numpy.bincount``. The
whole embedder is narrow (no shuffle): a chunk's tokens never leave their row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from docweave import constants as C
from docweave.functions import text as T

_SUB_BATCH = 256         # rows of counts held at once: 4 MB at 1,024 dimensions


def token_codes(text: Column, dim: int) -> Column:
    """ARRAY<INT>: ``bucket * 2 + (1 if sign is negative else 0)`` per token.

    Each token is hashed once (lambda bodies get no common-subexpression elimination, so
    the digest is its own pass); an odd 9th hex digit means a negative sign.
    """
    digests = F.transform(T.tokens(F.lower(text)), lambda t: F.md5(t))

    def code(h: Column) -> Column:
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim))
        neg = (F.instr(F.lit("13579bdf"), F.substring(h, 9, 1)) > 0).cast("int")
        return (bucket * 2 + neg).cast("int")
    return F.transform(digests, code)


def codes_matrix(codes, dim: int):
    """Dense unit vectors for a batch of code arrays: ``(valid_mask, matrix)`` where the
    matrix holds one row per valid (non-zero) input row."""
    arrs = list(codes)
    n = len(arrs)
    valid = np.zeros(n, dtype=bool)
    blocks = []
    for lo in range(0, n, _SUB_BATCH):
        part = arrs[lo:lo + _SUB_BATCH]
        lens = np.fromiter((0 if a is None else len(a) for a in part), dtype=np.int64,
                           count=len(part))
        if lens.sum() == 0:
            continue
        flat = np.concatenate([np.asarray(a, dtype=np.int64) for a in part if a is not None and len(a)])
        rows = np.repeat(np.arange(len(part), dtype=np.int64), lens)
        counts = np.bincount(rows * (2 * dim) + flat, minlength=len(part) * 2 * dim)
        counts = counts.reshape(len(part), dim, 2)
        w = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        norms = np.sqrt((w * w).sum(axis=1))
        ok = norms > 0
        valid[lo:lo + len(part)] = ok
        blocks.append(w[ok] / norms[ok][:, None])
    matrix = np.concatenate(blocks) if blocks else np.zeros((0, dim))
    return valid, matrix


def _codes_to_vectors(codes: pd.Series, dim: int) -> pd.Series:
    valid, matrix = codes_matrix(codes, dim)
    out: list = [None] * len(codes)
    for i, row in zip(np.flatnonzero(valid), matrix):
        out[i] = row
    return pd.Series(out, dtype=object)


def hash_embed_status(text: Column, dim: int = C.EMBED_DIMENSIONS) -> Column:
    """F10 for the hashing embedder without materialising vectors: ``OK`` when the text's
    vector exists (non-zero bucket sums), else ``MISSING``; one byte per row crosses
    Arrow instead of a dense vector."""
    @F.pandas_udf(TY.BooleanType())
    def nonzero(codes: pd.Series) -> pd.Series:
        valid, _ = codes_matrix(codes, dim)
        return pd.Series(valid)
    ok = nonzero.asNondeterministic()(token_codes(text, dim))
    return F.when(ok, F.lit("OK")).otherwise(F.lit("MISSING"))


def hashed_batch_embedder(dim: int):
    """Per-batch embedder for :func:`retrieval.knn_search` (``index_vec_fn``): turns a
    batch's token-code arrays into ``(kept ids, unit-vector matrix)`` inside the search
    task, so dense vectors never cross the JVM/Python boundary."""
    def fn(ids: np.ndarray, codes: pd.Series):
        valid, matrix = codes_matrix(codes, dim)
        return ids[valid], matrix
    return fn


def _codes_to_sparse(codes: pd.Series, dim: int) -> pd.DataFrame:
    """Like :func:`_codes_to_vectors` but keeps only non-zero coordinates: two aligned
    arrays per row (``buckets`` ascending, ``weights``); NULL arrays for an empty vector."""
    dense = _codes_to_vectors(codes, dim)
    buckets, weights = [], []
    for v in dense:
        if v is None:
            buckets.append(None)
            weights.append(None)
        else:
            nz = np.flatnonzero(v)
            buckets.append(nz.astype(np.int32))
            weights.append(v[nz])
    return pd.DataFrame({"buckets": buckets, "weights": weights})


SPARSE_TYPE = TY.StructType([TY.StructField("buckets", TY.ArrayType(TY.IntegerType())),
                             TY.StructField("weights", TY.ArrayType(TY.DoubleType()))])


def hash_embed_sparse(text: Column, dim: int = C.EMBED_DIMENSIONS) -> Column:
    """T3 in sparse form: STRUCT<buckets ARRAY<INT>, weights ARRAY<DOUBLE>> of the non-zero
    coordinates (about a quarter of a 1,024-d vector for a 500-word chunk), so long-form
    outputs do not ship and explode dense vectors."""
    @F.pandas_udf(SPARSE_TYPE)
    def sparse(codes: pd.Series) -> pd.DataFrame:
        return _codes_to_sparse(codes, dim)
    return sparse.asNondeterministic()(token_codes(text, dim))


def _vectors_udf(dim: int):
    @F.pandas_udf(TY.ArrayType(TY.DoubleType()))
    def vectors(codes: pd.Series) -> pd.Series:
        return _codes_to_vectors(codes, dim)
    # Marked non-deterministic only so the optimizer never copies the call into a pushed
    # filter (e.g. the `size(v) > 0` it infers for explode): the model runs once per row.
    return vectors.asNondeterministic()


def hash_embed(text: Column, dim: int = C.EMBED_DIMENSIONS) -> Column:
    """T3 as a column expression: ARRAY<DOUBLE> unit vector (NULL for empty text)."""
    return _vectors_udf(dim)(token_codes(text, dim))


def embed(df: DataFrame, text_col: str, out_col: str = "vector", dim: int = C.EMBED_DIMENSIONS,
          model_fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``out_col`` with one vector per row.

    ``model_fn`` (optional) maps a pandas Series of texts to a Series of float lists; it is
    run once per Arrow batch in a pandas UDF, so a model is loaded once per Python worker,
    not per row. Without it the hashing embedder is used.
    """
    if model_fn is None:
        return df.withColumn(out_col, hash_embed(F.col(text_col), dim))

    @F.pandas_udf(TY.ArrayType(TY.DoubleType()))
    def model_udf(texts: pd.Series) -> pd.Series:
        return model_fn(texts)

    return df.withColumn(out_col, model_udf.asNondeterministic()(F.col(text_col)))


def dimension_guard(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``embed_status`` = OK when the vector exists and has ``dim`` entries, else
    MISSING / BAD_DIM; rows are kept so the caller can route bad ones to dead letters."""
    v = F.col(vec_col)
    status = (F.when(v.isNull(), F.lit("MISSING"))
              .when(F.size(v) != dim, F.lit("BAD_DIM"))
              .otherwise(F.lit("OK")))
    return df.withColumn("embed_status", status)
