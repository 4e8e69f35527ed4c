"""Stored cell index (exact pruned search, generations, splits) and product quantisation."""

import numpy as np
import pytest
from docweave.operators import cells, quantized, retrieval

K = 3


def clustered(n=600, dim=16, centres=12, spread=0.08, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] / 4 + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "id long, vector array<double>").repartition(4)


def brute(q, x, k=K, exclude_self=True):
    s = np.rint(q @ x.T * 1e6).astype(np.int64)
    out = {}
    for i, row in enumerate(s):
        order = [j for j in np.lexsort((np.arange(len(x)), -row)) if not (exclude_self and i == j)][:k]
        out[i] = [(int(j), row[j] / 1e6) for j in order]
    return out


def hits_of(hits, id_col="id"):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r[id_col], r.score))
    return out


def as_queries(df):
    return df.selectExpr("id AS query_id", "vector AS query_vector")


def centroids(x, n, seed=3):
    return x[np.random.default_rng(seed).choice(len(x), n, replace=False)]


def test_pruned_search_is_exact_and_reads_few_cells_of_clustered_vectors(spark, tmpdir_path):
    x = clustered()
    df = frame(spark, x)
    cells.build(df, f"{tmpdir_path}/ix", centroids(x, 24), index_id="id")
    hits, read = cells.search_exact(as_queries(df), f"{tmpdir_path}/ix", K, index_id="id", exclude_self=True)
    assert hits_of(hits) == brute(x, x)
    rows = read.collect()
    assert len(rows) == len(x)
    assert sum(r.cells_read for r in rows) < 0.5 * sum(r.cells for r in rows)
    assert sum(r.rows_read for r in rows) < 0.5 * len(x) * len(x)


def test_exact_whatever_the_vectors_norms_and_tiles(spark, tmpdir_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)) * rng.uniform(0, 3, size=(200, 1))
    x[:5] = 0.0
    df = frame(spark, x)
    cells.build(df, f"{tmpdir_path}/ix", centroids(x[5:], 6), index_id="id", cell_tile_rows=20)
    hits, _ = cells.search_exact(as_queries(df), f"{tmpdir_path}/ix", K, index_id="id", exclude_self=True,
                                 cell_tile_rows=20, query_tile_rows=30)
    assert hits_of(hits) == brute(x, x)


def test_appended_and_split_index_searches_like_a_fresh_one(spark, tmpdir_path):
    x, path = clustered(seed=2), f"{tmpdir_path}/ix"
    cents = centroids(x, 8)
    cells.build(frame(spark, x[:300]), path, cents, index_id="id")
    cells.append(frame(spark, x[300:450], 300), path, 1, index_id="id")
    for _ in range(2):                                    # the second is a replay
        cells.append(frame(spark, x[450:], 450), path, 2, index_id="id")
    df = frame(spark, x)
    assert cells.index_rows(spark, path).count() == len(x)
    hits, _ = cells.search_exact(as_queries(df), path, K, index_id="id", exclude_self=True)
    assert hits_of(hits) == brute(x, x)
    before = {r.cell: r.n for r in cells.cell_stats(spark, path).collect()}
    split = cells.split_overfull(spark, path, 100, 3, index_id="id")
    assert split == sorted(c for c, n in before.items() if n > 100) and split
    after = {r.cell: r for r in cells.cell_stats(spark, path).collect()}
    assert not set(split) & set(after) and sum(r.n for r in after.values()) == len(x)
    assert all(after[c].n == n for c, n in before.items() if c not in split)
    hits, _ = cells.search_exact(as_queries(df), path, K, index_id="id", exclude_self=True)
    assert hits_of(hits) == brute(x, x)
    assert cells.split_overfull(spark, path, 10_000, 4, index_id="id") == []


def test_drift_shows_the_cell_whose_rows_moved(spark, tmpdir_path):
    x, path = clustered(seed=4), f"{tmpdir_path}/ix"
    cents = np.array([v / np.linalg.norm(v) for v in (x[:50].mean(0), -x[:50].mean(0))])
    cells.build(frame(spark, np.tile(cents[1], (20, 1))), path, cents, index_id="id")
    other = np.roll(cents[1], 1) * 0.5 + cents[1]
    cells.append(frame(spark, np.tile(other, (200, 1)), 100), path, 1, index_id="id")
    drift = {r.cell: (r.n, r.drift) for r in cells.cell_stats(spark, path).collect()}
    assert drift[0] == (0, None) and drift[1][0] == 220 and drift[1][1] > 0.1


def test_empty_query_set_and_rows_without_vectors(spark, tmpdir_path):
    x = clustered(50)
    df = frame(spark, x).unionByName(spark.createDataFrame([(999, None)], "id long, vector array<double>"))
    cells.build(df, f"{tmpdir_path}/ix", centroids(x, 4), index_id="id")
    assert cells.index_rows(spark, f"{tmpdir_path}/ix").count() == 50
    hits, read = cells.search_exact(as_queries(df).limit(0), f"{tmpdir_path}/ix", K, index_id="id")
    assert hits.count() == 0 and read.count() == 0


def test_quantised_search_recall_and_exact_scores(spark, tmpdir_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df, path = frame(spark, x), f"{tmpdir_path}/pq"
    books = quantized.write_codes(df, path, 8, index_id="id", codes=128)
    assert np.array_equal(books, quantized.read_books(spark, path)) and books.shape == (8, 128, 4)
    assert {len(r.codes) for r in spark.read.parquet(f"{path}/codes").collect()} == {8}
    got = hits_of(quantized.search(as_queries(df), df, path, K, 50, index_id="id", exclude_self=True))
    want = brute(x, x)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * K * len(x)
    assert all(abs(s - round(float(x[q] @ x[i]), 6)) < 1.5e-6 for q in got for i, s in got[q])
    every = quantized.search(as_queries(df).where("query_id < 20"), df, path, K, 800, index_id="id", exclude_self=True)
    assert hits_of(every) == {q: want[q] for q in range(20)}


def test_codebooks_do_not_depend_on_partitions(spark):
    x = clustered(300, 8)
    df = frame(spark, x)
    a = quantized.train_codebooks(df, 4, index_id="id", codes=16, fit_rows=100)
    b = quantized.train_codebooks(df.repartition(1), 4, index_id="id", codes=16, fit_rows=100)
    assert np.array_equal(a, b)
    with pytest.raises(ValueError):
        quantized.train_codebooks(df, 3, index_id="id")
