"""Connected components of a link table by alternating large and small stars.

Every round replaces links by links to smaller neighbours until each vertex is linked to
the smallest vertex of its component only. Minima are pre-aggregated before shuffling and a
vertex with many links is read through a join that adaptive execution can split, so no
task gathers the neighbours of a vertex. Rounds end in a reliable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def components(links: DataFrame) -> DataFrame:
    """Links ``a, b`` (any order, repeats allowed) -> ``vertex, root`` for every vertex that
    is not the smallest of its component."""
    links = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u != v").distinct().checkpoint())
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        links = small.distinct().checkpoint()
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
