"""Quantile sketches kept per time slot and merged to any window.

A slot (an hour by default) of each group is one KLL sketch of bounded size, made where the
log is read and combined before the shuffle. Sketches are stored once; a report over any
window merges the slots inside it and never reads the log again. A quantile's rank is off by
at most ``rank_error(k)`` of the values with 99 % confidence, whatever is merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.metrics import PCTS

K = 800


def rank_error(k: int = K) -> float:
    """Published normalised rank error of a KLL sketch's quantiles."""
    return 2.296 / k ** 0.9723


def sketch(log: DataFrame, group_cols: list[str], ts_col: str, value_col: str, slot: str = "1 hour",
           k: int = K) -> DataFrame:
    """``slot_start, <groups>, n, least, most, total, sketch``; null values take no part."""
    v = F.col(value_col).cast("double")
    rows = log.where(v.isNotNull() & F.col(ts_col).isNotNull())
    made = rows.groupBy(F.window(ts_col, slot).alias("w"), *group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.sum(v).alias("total"), F.kll_sketch_agg_double(v, k).alias("sketch"))
    return made.select(F.col("w.start").alias("slot_start"), *group_cols, "n", "least", "most", "total", "sketch")


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store slots by day; a day that is written again replaces its slots."""
    rows = sketches.withColumn("slot_day", F.to_date("slot_start"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("slot_day").parquet(path))


def read_sketches(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored slots that start in ``[start, end)``; only the days of that span are read."""
    rows = spark.read.parquet(path)
    for bound, day, at in ((start, F.col("slot_day") >= F.to_date(F.lit(start)), F.col("slot_start") >= F.lit(start)),
                           (end, F.col("slot_day") <= F.to_date(F.lit(end)), F.col("slot_start") < F.lit(end))):
        if bound is not None:
            rows = rows.where(day & at)
    return rows


def merged(sketches: DataFrame, group_cols: list[str | Column], pcts: dict[str, float] = PCTS,
           k: int = K) -> DataFrame:
    """``<groups>, count, mean, <percentiles>, max`` of all slots of each group."""
    groups = [F.col(c) if isinstance(c, str) else c for c in group_cols]
    found = sketches.groupBy(*groups).agg(
        F.sum("n").alias("count"), F.sum("total").alias("total"), F.max("most").alias("max"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"))
    names = [c for c in found.columns if c not in ("count", "total", "max", "sketch")]
    return found.select(*names, "count", (F.col("total") / F.col("count")).alias("mean"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for n, p in pcts.items()], "max")
