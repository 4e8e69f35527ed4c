"""Exact distributed percentiles (A6) vs the interpolation formula, and A7 summary."""

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import metrics as M


def test_exact_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.exponential(100, 5000)]          # skewed group
    rows += [("small", float(x)) for x in rng.normal(50, 5, 7)]
    rows += [("single", 42.0)]
    rows += [("ties", 1.0)] * 10 + [("ties", 2.0)] * 10
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in M.exact_percentiles(df, ["g"], "v").collect()}
    for g in ("hot", "small", "single", "ties"):
        vals = np.array([v for gg, v in rows if gg == g])
        for name, p in M.PCTS.items():
            assert abs(getattr(got[g], name) - np.percentile(vals, p * 100)) < 1e-9


def test_reference_position_example(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "v double").withColumn("g", F.lit(1))
    assert abs(M.exact_percentiles(df, ["g"], "v").first().p99 - 48.51) < 1e-9


def test_latency_summary_keeps_empty_stage(spark):
    df = spark.createDataFrame([("total", 10.0), ("total", 20.0), ("llm", 5.0)], "stage string, ms double")
    got = {r.stage: r for r in M.latency_summary(df).collect()}
    assert got["embedding"]["count"] == 0 and got["embedding"].p50_ms is None
    assert got["total"]["count"] == 2 and got["total"].p50_ms == 15.0 and got["total"].max_ms == 20.0


def test_cost_table_prices(spark):
    totals = spark.createDataFrame([(9895, 3136)], "input_tokens long, output_tokens long")
    got = {r.model: r.total_cost_usd for r in M.cost_table(totals).collect()}
    assert abs(got["Claude Haiku 4.5 (deployed family)"] - 0.025575) < 1e-9
    assert abs(got["Claude 3 Sonnet (alternative)"] - 0.076725) < 1e-9
