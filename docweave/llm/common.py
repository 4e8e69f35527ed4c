"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import bound_batches, ensure_checkpoint_dir, scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# white space as the contracts define words: [^\x20\x09-\x0D]+
SPACE_CLASS = r"\x20\x09-\x0D"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package on the workers, Arrow batches bounded by bytes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_batches(spark)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(
        *(columns or DOCUMENT_COLUMNS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: lineage is cut
    and wide intermediate rows cost less than in a checkpoint. The folder is the cluster's to
    empty once the job has ended."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(c: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` words of a text as an array (empty text: empty array)."""
    return F.filter(F.split(c, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (bound to a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def sampled(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """About ``size`` of the rows (all if there are fewer), each drawn by itself by a seeded
    number, so that equal rows and rows without an id are neither all taken nor all left."""
    n = rows.count()
    return rows if n <= size else rows.where(F.rand(seed) < size / n)


def row_key(id_: Column, digest: Column) -> Column:
    """Key of a row by its text's digest and its id; a null id leaves the digest alone."""
    return F.concat_ws("|", digest, id_.cast("string"))


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column, kept_key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``kept[kept_key]``, one row per key.

    One shuffle of the rows by key; the row number needs no further exchange. Keys must be
    near-unique (a document id with a digest), so no key is hot."""
    from pyspark.sql import Window
    k, n = fresh(docs, "_llm_key"), fresh(docs, "_llm_n")
    joined = docs.withColumn(k, key).join(
        kept.select(F.col(kept_key).alias(k)).distinct(), k, "left_semi")
    w = Window.partitionBy(k).orderBy(F.lit(1))
    return joined.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).select(*docs.columns)


#: Keys that :func:`split_heavy` calls heavy number at most this many, whatever the data.
HEAVY_KEYS = 100_000


def split_heavy(table: DataFrame, weight: str, heavy_keys: int = HEAVY_KEYS) -> tuple:
    """``(heavy, rest)`` of a table of distinct keys with positive ``weight`` (the number of
    rows that have the key).

    Heavy keys hold ``1/heavy_keys`` of all weight or more, so there are at most
    ``heavy_keys`` of them: they can be broadcast at any size of the data, and no key of the
    rest is hot. The table is read twice, so it should be checkpointed or staged."""
    total = table.agg(F.sum(weight).alias("t")).first().t or 0
    is_heavy = F.col(weight) * F.lit(heavy_keys) >= F.lit(total)
    return table.where(is_heavy), table.where(~is_heavy)


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], weight: str,
               how: str = "inner", heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to their key's row in ``table``: rows of heavy
    keys stay where they are, only the rest is shuffled, and there no key is hot."""
    heavy, rest = split_heavy(table, weight, heavy_keys)
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return hot.unionByName(cold)


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    """128 hash bits of the columns as two longs: XXH64 under two seeds."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)
