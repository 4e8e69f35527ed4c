"""J3 over compressed vectors: product quantisation with an exact re-rank.

Vectors are cut into ``m`` sub-spaces; each has a codebook of at most 256 entries learnt by
k-means on a bounded sample, and a vector is stored as ``m`` bytes, the nearest entry of each.
A search scores the codes only: a query's score with a code is the sum of its products with
the ``m`` entries named, which over a batch of codes is one matrix product with the entries
looked up. The ``candidates`` best of each query meet their full vectors through an equi-join
and are ranked by exact scores, with the rules of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import retrieval as R

CODES = 256
FIT_ROWS = 20_000
ITERATIONS = 12
FIT_BLOCK = 4_096        # rows whose distances to all entries are held at once


def _k_means(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Entries of one sub-space; empty ones take the farthest points. Rows are in a fixed order."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    own, nearest = np.empty(len(x), np.int64), np.empty(len(x))
    for _ in range(ITERATIONS):
        for lo in range(0, len(x), FIT_BLOCK):
            gap = (found ** 2).sum(1)[None, :] - 2 * x[lo:lo + FIT_BLOCK] @ found.T
            own[lo:lo + FIT_BLOCK], nearest[lo:lo + FIT_BLOCK] = gap.argmin(1), gap.min(1)
        size = np.bincount(own, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, own, x)
        far = np.argsort(-nearest, kind="stable")[:int((size == 0).sum())]
        found = total / np.maximum(size, 1)[:, None]
        found[np.flatnonzero(size == 0)[:len(far)]] = x[far]
    return found


def train_codebooks(index: DataFrame, m: int, *, index_id: str = "chunk_key", index_vec: str = "vector",
                    codes: int = CODES, fit_rows: int = FIT_ROWS, seed: int = 5) -> np.ndarray:
    """``(m, codes, width)`` entries learnt from about ``fit_rows`` rows, chosen by a hash of id
    and vector; one task per sub-space holds the sample's part of it."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte")
    rows = index.select(F.col(index_id).alias("id"), F.col(index_vec).cast("array<double>").alias("v")) \
                .where(F.col("v").isNotNull())
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or dim % m:
        raise ValueError(f"vectors of width {dim} do not divide into {m} sub-spaces")
    if n > fit_rows:
        share, scale = int((1 << 30) * fit_rows / n), 1 << 30
        rows = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(scale)) < share)
    width = dim // m
    parts = rows.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("v", i * width + 1, width))).alias("s", "x"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = R._matrix(part.sort_values("id", kind="stable")["x"].tolist())
        found = _k_means(x, codes, seed)
        return pd.DataFrame({"s": int(part["s"].iloc[0]), "code": np.arange(len(found)), "x": list(found)})

    found = parts.groupBy("s").applyInPandas(fit, "s int, code int, x array<double>").collect()  # m x codes
    books = np.zeros((m, max(r.code for r in found) + 1, width))
    for r in found:
        books[r.s, r.code] = r.x
    return books


def encode(index: DataFrame, books: np.ndarray, *, index_id: str = "chunk_key",
           index_vec: str = "vector") -> DataFrame:
    """``<index_id>, codes`` (``m`` bytes) of every row that has a vector."""
    shared = index.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for rows in batches:
            if len(rows) == 0:
                continue
            x = R._matrix(rows["_iv"].tolist()).reshape(len(rows), len(b), -1)
            out = np.empty((len(rows), len(b)), np.uint8)
            for s in range(len(b)):
                out[:, s] = ((b[s] ** 2).sum(1)[None, :] - 2 * x[:, s] @ b[s].T).argmin(1)
            yield pd.DataFrame({index_id: rows[index_id], "codes": [r.tobytes() for r in out]})

    rows = index.select(index_id, F.col(index_vec).cast("array<double>").alias("_iv")).where("_iv is not null")
    return rows.mapInPandas(run, f"`{index_id}` {rows.schema[index_id].dataType.simpleString()}, codes binary")


def write_codes(index: DataFrame, path: str, m: int, **options) -> np.ndarray:
    """Train, encode every row and store ``codes`` and ``books`` under ``path``."""
    ids = {k: v for k, v in options.items() if k in ("index_id", "index_vec")}
    books = train_codebooks(index, m, **options)
    encode(index, books, **ids).write.mode("overwrite").parquet(f"{path}/codes")
    rows = [(s, c, [float(v) for v in x]) for s, b in enumerate(books) for c, x in enumerate(b)]
    index.sparkSession.createDataFrame(rows, "s int, code int, x array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/books")
    return books


def read_books(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/books").orderBy("s", "code").collect()       # m x codes rows
    m = 1 + max(r.s for r in rows)
    return np.array([r.x for r in rows]).reshape(m, len(rows) // m, -1)


def _decoder(books: np.ndarray):
    def look_up(ids: np.ndarray, col: pd.Series):
        codes = np.frombuffer(b"".join(col), np.uint8).reshape(len(col), len(books))
        return ids, np.concatenate([books[s][codes[:, s]] for s in range(len(books))], axis=1)

    return look_up


def search(queries: DataFrame, index: DataFrame, path: str, k: int = C.TOP_K, candidates: int = 50, *,
           query_id: str = "query_id", query_vec: str = "query_vector", index_id: str = "chunk_key",
           index_vec: str = "vector", exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, <index_id>, score``: the exact top-k among each query's ``candidates``
    best by codes. A query's share of the codes is ``m`` bytes a row; of the vectors it reads
    its candidates only."""
    spark = queries.sparkSession
    codes = spark.read.parquet(f"{path}/codes")
    near = R.knn_search(queries, codes, candidates, query_id=query_id, query_vec=query_vec, index_id=index_id,
                        index_vec="codes", exclude_self=exclude_self,
                        index_vec_fn=_decoder(read_books(spark, path)))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_qv"))
    v = index.select(index_id, F.col(index_vec).cast("array<double>").alias("_iv"))
    pairs = near.select("query_id", index_id).join(q, "query_id").join(v, index_id)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.einsum("ij,ij->i", R._matrix(b["_qv"].tolist()), R._matrix(b["_iv"].tolist()))
                yield pd.DataFrame({"query_id": b["query_id"], index_id: b[index_id],
                                    "s_int": np.rint(s * R.SCORE_SCALE).astype(np.int64)})

    kinds = [pairs.schema[c].dataType.simpleString() for c in ("query_id", index_id)]
    scored = pairs.mapInPandas(exact, f"query_id {kinds[0]}, `{index_id}` {kinds[1]}, s_int bigint")
    return R._final_rank(scored, k, index_id)
