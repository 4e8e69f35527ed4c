"""J1/J3 over a stored cell index: exact pruned search, appended generations, split cells.

Layout under one folder::

    cells/generation=<g>/cell=<c>/   index id, vector (_iv)
    stats/generation=<g>/            per cell: rows, angular radius, largest norm, vector sum
    versions/version=<v>/            the cells in use: number and centroid

A write appends a generation: rows go to the nearest cell in use, and the cost is that of the
rows. Radii, norms and sums of a cell are merged over generations when read. A cell that has
grown beyond a bound is split into new cells whose rows are written as one generation; the new
version, written last, names the cells in use, so a reader sees either state whole and a job
that is lost half-way has changed nothing. A generation that is written again under its
number replaces itself.

Exact search visits cells by an upper bound: a member of a cell with angular radius rho is at
an angle of at least theta - rho from the query, theta being the centroid's, so its score is at
most ``|q| max|x| cos(max(0, theta - rho))``. Cells are visited in falling order of the bound,
1, 2, 4, ... at a time, until it is below the k-th score found. Answers equal a search of all
rows whatever the cells are; the cells only decide how much is read. Only centroids and
figures of cells, bounded by their number, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import retrieval as R

CELL_TILE_ROWS = 50_000
QUERY_TILE_ROWS = 4_096
STATS = "cell int, n long, radius double, norm double, total array<double>"
VERSION = "cell int, centroid array<double>"


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ _unit(y).T, -1, 1))


# ------------------------------------------------------------------ writing

def cells_in_use(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int], np.ndarray]:
    """The newest version's number (or the given one), its cells and their centroids."""
    rows = spark.read.schema(VERSION + ", version int").parquet(f"{path}/versions")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    found = rows.where(F.col("version") == version).orderBy("cell").collect()
    return version, [r.cell for r in found], np.array([r.centroid for r in found], dtype=np.float64)


def _write_version(spark: SparkSession, path: str, version: int, cells: list[int], cents: np.ndarray) -> None:
    rows = [(c, [float(x) for x in v]) for c, v in zip(cells, cents)]
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/versions/version={version}")


def _stats_of(assigned: DataFrame, cells: list[int], cents: np.ndarray) -> DataFrame:
    shared = assigned.sparkSession.sparkContext.broadcast((cells, cents))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {c: i for i, c in enumerate(shared.value[0])}
        found: dict[int, list] = {}
        for b in batches:
            if len(b) == 0:
                continue
            x, own = R._matrix(b["_iv"].tolist()), b["cell"].to_numpy()
            for c in np.unique(own).tolist():
                mine = x[own == c]
                angle = _angles(mine, shared.value[1][place[c]:place[c] + 1])
                f = found.setdefault(c, [0, 0.0, 0.0, 0.0])
                found[c] = [f[0] + len(mine), max(f[1], float(angle.max())),
                            max(f[2], float(np.linalg.norm(mine, axis=1).max())), f[3] + mine.sum(axis=0)]
        yield pd.DataFrame([(c, *f[:3], f[3]) for c, f in found.items()],
                           columns=["cell", "n", "radius", "norm", "total"])

    return merged_stats(assigned.select("cell", "_iv").mapInPandas(partial, STATS))


def merged_stats(stats: DataFrame) -> DataFrame:
    """One row per cell of partial figures."""
    sums = (stats.select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i")
            .agg(F.sum("x").alias("x")).groupBy("cell")
            .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("t")))      # one row per dimension
    figures = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"),
                                        F.max("norm").alias("norm"))
    return figures.join(sums, "cell").select("cell", "n", "radius", "norm", F.transform(
        "t", lambda x: x["x"]).alias("total"))


def _write_generation(rows: DataFrame, path: str, generation: int, cells: list[int], cents: np.ndarray,
                      index_id: str, cell_tile_rows: int) -> None:
    kind = rows.schema[index_id].dataType.simpleString()
    assigned = R._nearest_cells(rows, index_id, "_iv", cents, 1,
                                f"`{index_id}` {kind}, _iv array<double>, cell int")
    number = F.element_at(F.array(*[F.lit(c) for c in cells]), F.col("cell") + 1)
    assigned = assigned.withColumn("cell", number).checkpoint()
    stats = _stats_of(assigned, cells, cents).checkpoint()
    salts = stats.select("cell", F.ceil(F.col("n") / cell_tile_rows).cast("int").alias("s"))
    dealt = (assigned.join(F.broadcast(salts), "cell")          # a row per cell: bounded
             .repartition("cell", F.pmod(F.xxhash64(index_id), F.col("s"))).drop("s"))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells/generation={generation}")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/generation={generation}")


def _vectors(index: DataFrame, index_id: str, index_vec: str) -> DataFrame:
    return index.select(index_id, F.col(index_vec).cast("array<double>").alias("_iv")).where("_iv is not null")


def build(index: DataFrame, path: str, centroids: np.ndarray, *, index_id: str = "chunk_key",
          index_vec: str = "vector", cell_tile_rows: int = CELL_TILE_ROWS) -> None:
    """A new index of ``index`` over the given centroids: generation 0, version 0."""
    cells = list(range(len(centroids)))
    cell_tile_rows = R._rows_for(centroids.shape[1], cell_tile_rows)
    _write_generation(_vectors(index, index_id, index_vec), path, 0, cells, centroids, index_id, cell_tile_rows)
    _write_version(index.sparkSession, path, 0, cells, centroids)


def append(rows: DataFrame, path: str, generation: int, *, index_id: str = "chunk_key",
           index_vec: str = "vector", cell_tile_rows: int = CELL_TILE_ROWS) -> None:
    """Add rows as a generation; the same number again replaces it (a replayed micro-batch)."""
    if generation < 1:
        raise ValueError("generation 0 is the build")
    _, cells, cents = cells_in_use(rows.sparkSession, path)
    _write_generation(_vectors(rows, index_id, index_vec), path, generation, cells, cents, index_id,
                      R._rows_for(cents.shape[1], cell_tile_rows))


def cell_stats(spark: SparkSession, path: str) -> DataFrame:
    """``cell, n, radius, norm, drift``: figures of the cells in use over all generations.
    ``drift`` is the angle between a cell's centroid and the mean direction of its rows."""
    _, cells, cents = cells_in_use(spark, path)
    stats = merged_stats(spark.read.schema(STATS + ", generation int").parquet(f"{path}/stats"))
    used = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in zip(cells, cents)], VERSION)

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cos = dot("total", "centroid") / F.sqrt(dot("total", "total") * dot("centroid", "centroid"))
    drift = F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return used.join(stats, "cell", "left").select(
        "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"),
        F.coalesce("norm", F.lit(0.0)).alias("norm"), drift.alias("drift"))


def split_overfull(spark: SparkSession, path: str, max_rows: int, generation: int, *,
                   index_id: str = "chunk_key", seed: int = 7,
                   cell_tile_rows: int = CELL_TILE_ROWS) -> list[int]:
    """Split every cell of more than ``max_rows`` rows into as many as bring it near that, by
    k-means over its rows; only these cells are read and written. Returns the cells split."""
    version, cells, cents = cells_in_use(spark, path)
    full = {r.cell: r.n for r in cell_stats(spark, path).where(F.col("n") > max_rows).collect()}
    if not full:
        return []
    rows = spark.read.parquet(f"{path}/cells")
    new_cells, new_cents = [], []
    top = 1 + max(cells)
    for c, n in sorted(full.items()):
        own, _ = R.train_ivf(rows.where(F.col("cell") == c).withColumnRenamed("_iv", "vector"),
                             -(-n // max_rows), "vector", seed)
        new_cells += range(top, top + len(own))
        new_cents += list(own)
        top += len(own)
    moved = rows.where(F.col("cell").isin(list(full))).select(index_id, "_iv")
    _write_generation(moved, path, generation, new_cells, np.array(new_cents), index_id,
                      R._rows_for(cents.shape[1], cell_tile_rows))
    kept = [i for i, c in enumerate(cells) if c not in full]
    _write_version(spark, path, version + 1, [cells[i] for i in kept] + new_cells,
                   np.array([cents[i] for i in kept] + new_cents))
    return sorted(full)


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the cells in use: the index id, ``_iv`` and ``cell``."""
    _, cells, _ = cells_in_use(spark, path)
    return spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(cells)).drop("generation")


# ------------------------------------------------------------------ searching

def _visiting_order(queries: DataFrame, cells: list[int], cents: np.ndarray, radius: np.ndarray,
                    norm: np.ndarray) -> DataFrame:
    """Per query its cells by falling upper bound of the scores inside."""
    shared = queries.sparkSession.sparkContext.broadcast((np.array(cells), cents, radius, norm))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, cents, radius, norm = shared.value
        for b in batches:
            if len(b) == 0:
                continue
            q = R._matrix(b["_qv"].tolist())
            best = np.cos(np.maximum(0.0, _angles(q, cents) - radius[None, :]))
            bound = np.linalg.norm(q, axis=1)[:, None] * norm[None, :] * np.maximum(0.0, best)
            order = np.argsort(-bound, axis=1, kind="stable")
            yield pd.DataFrame({"query_id": b["query_id"], "_qv": b["_qv"],
                                "cells": list(cells[order].astype(np.int32)),
                                "bounds": list(np.take_along_axis(bound, order, axis=1))})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(run, f"query_id {kind}, _qv array<double>, cells array<int>, bounds array<double>")


def search_exact(queries: DataFrame, path: str, k: int = C.TOP_K, *, query_id: str = "query_id",
                 query_vec: str = "query_vector", index_id: str = "chunk_key",
                 exclude_self: bool = False, cell_tile_rows: int = CELL_TILE_ROWS,
                 query_tile_rows: int = QUERY_TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Exact top-k of each query over the stored index.

    Returns the hits (``query_id, rank, <index_id>, score``) and what was read for them
    (``query_id, cells_read, cells, rows_read``). A cell's rows are met in tiles of
    ``cell_tile_rows`` by its queries in blocks of ``query_tile_rows``, so a cell that all
    queries visit, or that holds most rows, is not one task."""
    spark = queries.sparkSession
    stats = cell_stats(spark, path).where("n > 0").orderBy("cell").collect()      # a row per cell
    _, cells, cents = cells_in_use(spark, path)
    place = {c: i for i, c in enumerate(cells)}
    used = [r.cell for r in stats]
    cents = cents[[place[c] for c in used]] if used else np.zeros((0, 1))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_qv")) \
               .where(F.col("_qv").isNotNull())
    state = _visiting_order(q, used, cents, np.array([r.radius for r in stats]),
                            np.array([r.norm for r in stats])).checkpoint()
    tile = R._rows_for(cents.shape[1], cell_tile_rows)
    block = R._rows_for(cents.shape[1], query_tile_rows)
    tiles = spark.createDataFrame([(r.cell, -(-r.n // tile), r.n) for r in stats],
                                  "cell int, tiles long, n long")
    index = index_rows(spark, path)
    kinds = [q.schema["query_id"].dataType.simpleString(), index.schema[index_id].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, `{index_id}` {kinds[1]}, s_int bigint"
    best = spark.createDataFrame([], schema)
    probed = spark.createDataFrame([], f"query_id {kinds[0]}, cell int")
    at, step = 0, 1
    while at < len(used):
        kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("s_int").alias("kth"))
        part = state.select("query_id", "_qv", F.explode(F.arrays_zip(
            F.slice("cells", at + 1, step).alias("cell"), F.slice("bounds", at + 1, step).alias("bound"))).alias("p"))
        wanted = F.col("kth").isNull() | (F.col("found") < k) | (
            F.col("p.bound") * R.SCORE_SCALE + 2 >= F.col("kth"))     # 2: rounding of both scores
        probes = part.join(kth, "query_id", "left").where(wanted).select("query_id", "_qv", "p.cell").checkpoint()
        per_cell = {r.cell: r.n for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not per_cell:
            break
        dealt = tiles.join(spark.createDataFrame(
            [(c, -(-n // block)) for c, n in per_cell.items()], "cell int, blocks long"), "cell")
        dealt = F.broadcast(dealt.drop("n"))                          # a row per cell
        it = (index.where(F.col("cell").isin(list(per_cell))).join(dealt, "cell")
              .withColumn("tile", F.pmod(F.xxhash64(index_id), F.col("tiles")))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        qt = (probes.join(dealt, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
              .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
        found = R._cogroup_candidates(it.drop("tiles", "blocks"), qt.drop("tiles", "blocks"),
                                      ["cell", "tile", "block"], k, index_id, exclude_self, schema)
        ranked = R._final_rank(best.unionByName(found), k, index_id)
        best = ranked.select("query_id", index_id, F.round(F.col("score") * R.SCORE_SCALE).cast("long").alias("s_int")).checkpoint()
        probed = probed.unionByName(probes.select("query_id", "cell"))
        at, step = at + step, 2 * step
    read = (probed.join(F.broadcast(tiles), "cell").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("cells_read"), F.lit(len(used)).cast("long").alias("cells"),
        F.sum("n").alias("rows_read")))
    return R._final_rank(best, k, index_id), read
