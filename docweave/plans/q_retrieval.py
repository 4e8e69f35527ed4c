"""Retrieval queries: T3 embedder, F10 guard, J1-J5, J11."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import cells, embedding, quantized, retrieval
from docweave.plans import common
from docweave.plans.catalog import query
from docweave.sources.tables import read_table, spread

EMB_K = C.TOP_K
IVF_CELLS = 8
IVF_PROBES = 8          # of the 10 label cells: recall@3 0.94; 2 give 0.42, 4 give 0.66, 6 give 0.83
PRUNED_CELLS = 32
PQ_PARTS = 16           # bytes a vector; 256 as floats
PQ_CANDIDATES = 50


def _embeddings(spark, sf_dir):
    e = spread(read_table(spark, sf_dir, "embeddings"), "vec_id")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _self_queries(e):
    return e.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))


KNN_EMB_SQL = f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS neighbor_id,
         round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank
           FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM ranked WHERE rank <= {EMB_K}"""


def _knn_emb(spark, sf_dir, method):
    e = _embeddings(spark, sf_dir)
    hits = retrieval.knn_search(_self_queries(e), e.select("vec_id", "vector"), EMB_K,
                                index_id="vec_id", exclude_self=True, method=method)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


@query("knn_exact", oracle=KNN_EMB_SQL)
def knn_exact(spark, sf_dir):
    """Every vector's 3 nearest other vectors (broadcast query block, index
    scanned in place)."""
    return _knn_emb(spark, sf_dir, "auto")


@query("knn_exact_tiled", oracle=KNN_EMB_SQL)
def knn_exact_tiled(spark, sf_dir):
    """The same search through the tiled block-matrix path (cogroup on tile ids),
    the plan used when the query set is beyond the broadcast bound."""
    e = _embeddings(spark, sf_dir)
    hits = retrieval.knn_search(_self_queries(e), e.select("vec_id", "vector"), EMB_K,
                                index_id="vec_id", exclude_self=True, method="tiled")
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


def _ivf(spark, sf_dir, nprobe):
    """Build the cell-partitioned index in the shared scratch folder, then search it."""
    import uuid

    from docweave.session import scratch_path
    e = _embeddings(spark, sf_dir)
    path = scratch_path(spark, f"ivf-{uuid.uuid4().hex}")
    retrieval.build_ivf_index(e.select("vec_id", "vector"), path, IVF_CELLS, index_id="vec_id")
    hits = retrieval.search_ivf_index(_self_queries(e), path, EMB_K, nprobe, index_id="vec_id",
                                      exclude_self=True)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


@query("knn_ivf_full_probe", oracle=KNN_EMB_SQL)
def knn_ivf_full_probe(spark, sf_dir):
    """J3 with every cell probed on the stored, cell-partitioned index: must equal the
    exact search."""
    return _ivf(spark, sf_dir, IVF_CELLS)


IVF_LABEL_SQL = f"""
mean AS (SELECT label, i, avg(x) AS a FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
  GROUP BY label, i),
cent AS (SELECT label AS cell, list(round(a / n, 6) ORDER BY i) AS c
         FROM (SELECT *, sqrt(sum(a * a) OVER (PARTITION BY label)) AS n FROM mean) GROUP BY label),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY
           round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 6) DESC, cell) AS r FROM embeddings, cent),
cand AS (SELECT q.vec_id AS query_id, i.vec_id AS neighbor_id,
           round(list_dot_product(CAST(eq.embedding AS DOUBLE[]), CAST(ei.embedding AS DOUBLE[])), 6) AS score
         FROM near q JOIN near i ON q.cell = i.cell AND q.r <= {IVF_PROBES} AND i.r = 1 AND q.vec_id <> i.vec_id
         JOIN embeddings eq ON eq.vec_id = q.vec_id JOIN embeddings ei ON ei.vec_id = i.vec_id),
ivf AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM cand)
  WHERE rank <= {EMB_K})"""


def _ivf_labels(spark, sf_dir):
    """The index cut into one cell per label (deterministic centroids), ``IVF_PROBES`` probed."""
    import uuid

    from docweave.session import scratch_path
    e = _embeddings(spark, sf_dir)
    path = scratch_path(spark, f"ivf-{uuid.uuid4().hex}")
    cents = retrieval.label_centroids(e, "label")
    retrieval.build_ivf_index(e.select("vec_id", "vector"), path, len(cents), index_id="vec_id",
                              centroids=cents)
    hits = retrieval.search_ivf_index(_self_queries(e), path, EMB_K, IVF_PROBES, index_id="vec_id", exclude_self=True)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


@query("knn_ivf", oracle=f"WITH {IVF_LABEL_SQL} SELECT * FROM ivf")
def knn_ivf(spark, sf_dir):
    """Approximate search probing 8 of the stored index's 10 cells, one per label; only the
    probed cells' files are read."""
    return _ivf_labels(spark, sf_dir)


@query("knn_recall", oracle=f"""WITH {IVF_LABEL_SQL},
e AS ({KNN_EMB_SQL})
SELECT e.query_id, count(ivf.neighbor_id) / count(*) AS recall
FROM e LEFT JOIN ivf ON ivf.query_id = e.query_id AND ivf.neighbor_id = e.neighbor_id GROUP BY e.query_id""")
def knn_recall(spark, sf_dir):
    """recall@3 of the 8-probe IVF search against the exact search, per query."""
    exact = _knn_emb(spark, sf_dir, "auto")
    return retrieval.recall_at_k(_ivf_labels(spark, sf_dir), exact, "neighbor_id")


def _cells_path(spark):
    import uuid

    from docweave.session import scratch_path
    return scratch_path(spark, f"cells-{uuid.uuid4().hex}")


def _pruned(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    path = _cells_path(spark)
    cents, _ = retrieval.train_ivf(e.select("vector"), PRUNED_CELLS)
    cells.build(e.select("vec_id", "vector"), path, cents, index_id="vec_id")
    return cells.search_exact(_self_queries(e), path, EMB_K, index_id="vec_id", exclude_self=True)


@query("knn_exact_pruned", oracle=KNN_EMB_SQL)
def knn_exact_pruned(spark, sf_dir):
    """Exact search of the stored cell index, cells visited by their angular bound until
    it is below the third score found."""
    hits, _ = _pruned(spark, sf_dir)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


@query("knn_cells_read")
def knn_cells_read(spark, sf_dir):
    """What the pruned search read per query: cells, of how many, and their rows."""
    _, read = _pruned(spark, sf_dir)
    return read.select("query_id", "cells_read", "cells", "rows_read")


@query("knn_appended", oracle=KNN_EMB_SQL)
def knn_appended(spark, sf_dir):
    """An index built from some sources' vectors, two generations appended (one of them
    written twice) and its overfull cells split: the search finds what a fresh index finds."""
    e = _embeddings(spark, sf_dir)
    rows, path = e.select("vec_id", "vector"), _cells_path(spark)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(4))
    cents, _ = retrieval.train_ivf(rows.where(part < 2).select("vector"), IVF_CELLS)
    cells.build(rows.where(part < 2), path, cents, index_id="vec_id")
    for generation in (1, 2, 2):
        cells.append(rows.where(part == 1 + generation), path, generation, index_id="vec_id")
    mean = e.count() // IVF_CELLS
    cells.split_overfull(spark, path, max(8, mean), 3, index_id="vec_id")
    hits, _ = cells.search_exact(_self_queries(e), path, EMB_K, index_id="vec_id", exclude_self=True)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


def _pq(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    path = _cells_path(spark)
    quantized.write_codes(e.select("vec_id", "vector"), path, PQ_PARTS, index_id="vec_id")
    hits = quantized.search(_self_queries(e), e, path, EMB_K, PQ_CANDIDATES, index_id="vec_id", exclude_self=True)
    return hits.select("query_id", "rank", F.col("vec_id").alias("neighbor_id"), "score")


@query("knn_pq")
def knn_pq(spark, sf_dir):
    """Search of vectors stored as 16 bytes each, the 50 best re-ranked by exact scores."""
    return _pq(spark, sf_dir)


@query("knn_pq_recall")
def knn_pq_recall(spark, sf_dir):
    """recall@3 of the compressed search against the exact search, per query."""
    return retrieval.recall_at_k(_pq(spark, sf_dir), _knn_emb(spark, sf_dir, "auto"), "neighbor_id")


@query("knn_label_agreement", oracle=f"""
WITH h AS ({KNN_EMB_SQL}),
j AS (SELECT h.query_id, ql.label AS label, CASE WHEN nl.label = ql.label THEN 1.0 ELSE 0.0 END AS agree
      FROM h JOIN embeddings ql ON ql.vec_id = h.query_id JOIN embeddings nl ON nl.vec_id = h.neighbor_id)
SELECT label, CAST(count(DISTINCT query_id) AS BIGINT) AS queries, round(avg(agree), 6) AS agreement
FROM j GROUP BY label""")
def knn_label_agreement(spark, sf_dir):
    """Share of retrieved neighbours carrying the query's label, per label."""
    e = _embeddings(spark, sf_dir)
    hits = _knn_emb(spark, sf_dir, "auto")
    lab = e.select("vec_id", "label")
    j = (hits.join(lab.withColumnRenamed("vec_id", "query_id"), "query_id")
             .join(lab.select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("nlabel")),
                   "neighbor_id"))
    return j.groupBy("label").agg(
        F.countDistinct("query_id").cast("bigint").alias("queries"),
        F.round(F.avg(F.when(F.col("nlabel") == F.col("label"), 1.0).otherwise(0.0)), 6)
         .alias("agreement"))


@query("hash_embed", oracle=f"""
WITH {common.chunk_rows_sql()},
{common.weights_sql('chunk_rows', 'chunk_key', 'text_chunk', 'cw')}
SELECT chunk_key, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM cw""")
def hash_embed(spark, sf_dir):
    """Hashing-embedder vector of every indexed chunk, in sparse long form (the UDF
    returns only non-zero coordinates)."""
    rows = common.chunk_rows(spark, sf_dir).select(
        "chunk_key", embedding.hash_embed_sparse(F.col("text_chunk"), common.TEXT_DIM).alias("sv"))
    pairs = F.arrays_zip(F.col("sv.buckets").alias("bucket"), F.col("sv.weights").alias("weight"))
    return rows.select("chunk_key", F.inline_outer(pairs)).where(F.col("weight").isNotNull()) \
               .select("chunk_key", F.col("bucket").cast("bigint").alias("bucket"),
                       F.round("weight", 6).alias("weight"))


@query("embedding_dim_guard", oracle="""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN CAST(embedding AS DOUBLE[])[:63]
                          ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
SELECT vec_id, CASE WHEN v IS NULL THEN 'MISSING' WHEN len(v) <> 64 THEN 'BAD_DIM' ELSE 'OK' END AS embed_status,
       round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm FROM e""")
def embedding_dim_guard(spark, sf_dir):
    """per-vector dimension check (64 expected) and norm, for routing bad vectors; the
    model gave nothing for every 11th row and a short vector for every 7th."""
    e = _embeddings(spark, sf_dir)
    given = (F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.slice("vector", 1, 63))
             .otherwise(F.col("vector")))
    g = embedding.dimension_guard(e.withColumn("vector", given), "vector", 64)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return g.select("vec_id", "embed_status", F.round(norm, 4).alias("norm"))


def _letter_shares(texts):
    """A model of three numbers: the shares of ``e``, of spaces and of the rest."""
    n = texts.str.len().clip(lower=1)
    e, blank = texts.str.count("e") / n, texts.str.count(" ") / n
    return (1 - e - blank).combine(e.combine(blank, lambda x, y: [x, y]), lambda r, xy: [*xy, r])


@query("embed_model_hook", oracle=f"""WITH {common.chunk_rows_sql()}
SELECT chunk_key, 'OK' AS embed_status,
       round((length(text_chunk) - length(replace(text_chunk, 'e', ''))) / length(text_chunk), 6) AS share_e,
       round((length(text_chunk) - length(replace(text_chunk, ' ', ''))) / length(text_chunk), 6) AS share_blank
FROM chunk_rows""")
def embed_model_hook(spark, sf_dir):
    """Chunks embedded by a plugged-in model, once per Arrow batch."""
    rows = common.chunk_rows(spark, sf_dir).select("chunk_key", "text_chunk")
    e = embedding.dimension_guard(embedding.embed(rows, "text_chunk", "vector", 3, _letter_shares), "vector", 3)
    return e.select("chunk_key", "embed_status", F.round(F.col("vector")[0], 6).alias("share_e"),
                    F.round(F.col("vector")[1], 6).alias("share_blank"))


@query("hash_embed_dense", oracle=f"""
WITH {common.chunk_rows_sql()},
{common.weights_sql('chunk_rows', 'chunk_key', 'text_chunk', 'cw')}
SELECT chunk_key, {common.TEXT_DIM} AS dim, CAST(count(*) AS BIGINT) AS nonzero,
       round(sqrt(sum(weight * weight)), 6) AS norm FROM cw GROUP BY chunk_key""")
def hash_embed_dense(spark, sf_dir):
    """T3 dense form: every chunk vector has the declared width and unit norm."""
    idx = common.chunk_index(spark, sf_dir).select("chunk_key", "vector").where(F.col("vector").isNotNull())
    return idx.select("chunk_key", F.size("vector").alias("dim"),
                      F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("nonzero"),
                      F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
                       .alias("norm"))
