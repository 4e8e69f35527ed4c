"""Request-log analytics: A6-A10, A12, A13, J8, W4, T5, R4-R6.

Exact percentiles (A6) use the interpolated definition: position ``(n-1)*p``, linear
between the two neighbouring order statistics. They are computed without gathering a
group's values anywhere: the values are range-partitioned and sorted by ``(group,
value)`` (a hot group is spread over many partitions by value), every row learns its
rank from per-partition counts, and only the <= 2 rows per (group, percentile) at the
needed ranks are picked. The sorted, ranked table is checkpointed (reliable checkpoint
in the shared checkpoint folder) so the count pass and the pick pass read the same
order even if executors are lost in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave import constants as C

PCTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}

# Request-log mapping used by the registered queries: the event type names the stage
# measured by that request; 'error' requests failed.
STAGE_OF_EVENT = {"click": "embedding", "view": "retrieval", "purchase": "llm", "signup": "total"}


def stage_of(event_type: Column) -> Column:
    m = F.create_map(*[x for k, v in STAGE_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    return m[event_type]


def exact_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                      pcts: dict[str, float] = PCTS,
                      max_broadcast_ranks: int = 200_000) -> DataFrame:
    """``group_cols`` + one column per percentile name (DOUBLE), NULL-free input.

    Equivalent to ``percentile(value, p)`` per group, but no group's values are collected
    into one task: memory per task is bounded by the sort's spill, not by group size.
    """
    g = [F.col(c) for c in group_cols]
    vals = df.select(*g, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # range partitioning + sort; the seeded tie-breaker lets the range partitioner split a
    # run of one repeated value too (order among equal values changes no order statistic)
    ordered = vals.withColumn("_tie", F.rand(17)).orderBy(*g, "_v", "_tie").drop("_tie")
    ranked = ordered.select(*g, "_v", F.spark_partition_id().alias("_pid"),
                            F.monotonically_increasing_id().alias("_mid"))
    ranked = ranked.checkpoint()        # partition ids and offsets must not be made twice
    ranked = ranked.withColumn("_off", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    # per (group, partition): row count and offset of the group's first row there
    parts = ranked.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                                    F.min("_off").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt")) \
                 .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    # targets: for each percentile the two ranks around (n-1)*p
    tgt = parts.select(*group_cols, "_n").distinct()
    tgt = tgt.select(*group_cols, "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in pcts.items()]))
        .alias("t"))
    pos = (F.col("_n") - 1) * F.col("t.p")
    tgt = tgt.select(*group_cols, F.col("t.name").alias("_name"), pos.alias("_pos"),
                     F.floor(pos).cast("long").alias("_lo"),
                     F.least(F.floor(pos).cast("long") + 1, F.col("_n") - 1).alias("_hi"))
    need = tgt.select(*group_cols, "_name", "_pos", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("_lo").alias("rank")),
        F.struct(F.lit("hi").alias("side"), F.col("_hi").alias("rank")))).alias("r"))
    # locate each needed rank: partition holding it and offset inside that partition
    loc = need.join(parts, group_cols).where(
        (F.col("r.rank") >= F.col("_before")) & (F.col("r.rank") < F.col("_before") + F.col("_cnt")))
    loc = loc.select(*group_cols, "_name", "_pos", F.col("r.side").alias("_side"),
                     F.col("r.rank").alias("_rank"), "_pid",
                     (F.col("_first") + F.col("r.rank") - F.col("_before")).alias("_off"))
    # the needed-rank list has 2 rows per (group, percentile); broadcast it only when that
    # count is checked to be small, otherwise leave the join strategy to the planner/AQE
    if tgt.count() * 2 <= max_broadcast_ranks:
        loc = F.broadcast(loc)
    picked = loc.join(ranked.select(*group_cols, "_pid", "_off", "_v"), group_cols + ["_pid", "_off"])
    per = picked.groupBy(*group_cols, "_name", "_pos").agg(
        F.max(F.when(F.col("_side") == "lo", F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_side") == "hi", F.col("_v"))).alias("_vhi"),
        F.max(F.when(F.col("_side") == "lo", F.col("_rank"))).alias("_rlo"))
    val = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.col("_rlo"))
    per = per.select(*group_cols, "_name", val.alias("_val"))
    return per.groupBy(*group_cols).pivot("_name", list(pcts)).agg(F.first("_val"))


def latency_summary(long: DataFrame, stage_col: str = "stage", ms_col: str = "ms",
                    stages: list[str] | None = C.LATENCY_STAGES, approx: bool = False,
                    accuracy: int = 10_000) -> DataFrame:
    """Count, mean, p50, p90, p99, max per stage, rounded to 2 digits.

    A stage without samples keeps a row with count 0 (left join from the stage list).
    ``approx`` uses ``percentile_approx`` (bounded memory sketch) instead.
    """
    basic = long.groupBy(stage_col).agg(
        F.count(ms_col).cast("bigint").alias("count"), F.avg(ms_col).alias("_mean"),
        F.max(ms_col).alias("_max"))
    if approx:
        pct = long.groupBy(stage_col).agg(*[
            F.percentile_approx(ms_col, p, accuracy).alias(name) for name, p in PCTS.items()])
    else:
        pct = exact_percentiles(long, [stage_col], ms_col)
    stats = basic.join(pct, stage_col, "left")
    out_cols = [F.col(stage_col), F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                F.round("_mean", 2).alias("mean_ms")] + \
               [F.round(name, 2).alias(f"{name}_ms") for name in PCTS] + [F.round("_max", 2).alias("max_ms")]
    if stages:
        # stage list (a fixed literal) left-joined to per-stage stats: both sides hold one
        # row per stage, so the planner/AQE picks the join; no hint needed
        names = long.sparkSession.createDataFrame([(s,) for s in stages], f"{stage_col} string")
        stats = names.join(stats, stage_col, "left")
    return stats.select(*out_cols)


def request_totals(samples: DataFrame) -> DataFrame:
    """Requests, successes, failures and token sums over successful requests."""
    ok = F.col("ok")
    return samples.agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.count_if(ok).cast("bigint").alias("success"),
        F.count_if(~ok).cast("bigint").alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).cast("bigint").alias("output_tokens"))


def cost_table(totals: DataFrame, prices: list[tuple[str, float, float]] = C.PRICE_TABLE) -> DataFrame:
    """J8 + A10: token totals priced per model (USD per 1K tokens), rounded to 6.

    The price list is a literal array exploded next to the one-row totals: no join."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("in_price"),
                             F.lit(o).alias("out_price")) for m, i, o in prices])
    t = totals.select("*", F.explode(arr).alias("pr"))
    in_cost = F.col("input_tokens") / 1000.0 * F.col("pr.in_price")
    out_cost = F.col("output_tokens") / 1000.0 * F.col("pr.out_price")
    return t.select(F.col("pr.model").alias("model"), "input_tokens", "output_tokens",
                    F.round(in_cost, 6).alias("input_cost_usd"), F.round(out_cost, 6).alias("output_cost_usd"),
                    F.round(in_cost + out_cost, 6).alias("total_cost_usd"),
                    *[c for c in totals.columns if c not in ("input_tokens", "output_tokens")])


def report(samples: DataFrame, prices: list[tuple[str, float, float]] = C.PRICE_TABLE,
           stages: list[str] = C.LATENCY_STAGES) -> DataFrame:
    """The whole report as one nested row: ``summary`` (totals), ``latency`` (a map from
    stage to its statistics, stages without samples included) and ``cost`` (a row per model).

    The log is read for one aggregation by (ok, stage), of which totals, counts, means and
    maxima are sums, and for the exact percentiles."""
    base = samples.groupBy("ok", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"),
        F.count("ms").alias("count"), F.sum("ms").alias("ms"), F.max("ms").alias("most"))
    pct = exact_percentiles(samples.where("ok").select("stage", "ms"), ["stage"], "ms")
    ok = F.col("ok")
    cells = base.join(pct, [base["stage"].eqNullSafe(pct["stage"])][0], "left").drop(pct["stage"])
    stats = F.struct(F.col("count"), F.round(F.col("ms") / F.col("count"), 2).alias("mean_ms"),
                     *[F.round(p, 2).alias(f"{p}_ms") for p in PCTS], F.round("most", 2).alias("max_ms"))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint")

    one = cells.agg(
        F.struct(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("requests"), total("n").alias("success"),
                 F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("bigint").alias("failed"),
                 total("i").alias("input_tokens"), total("o").alias("output_tokens")).alias("summary"),
        F.map_from_entries(F.filter(F.collect_list(F.when(ok & F.col("stage").isin(stages), F.struct(
            F.col("stage"), stats))), lambda x: x.isNotNull())).alias("found"))
    none = F.struct(F.lit(0).cast("bigint").alias("count"), *[
        F.lit(None).cast("double").alias(c) for c in ("mean_ms", *[f"{p}_ms" for p in PCTS], "max_ms")])
    latency = F.create_map(*[x for s in stages for x in (F.lit(s), F.coalesce(
        F.try_element_at("found", F.lit(s)), none))])

    def price(model: str, in_price: float, out_price: float) -> Column:
        i, o = (F.col(f"summary.{t}") / 1000.0 * F.lit(p) for t, p in (
            ("input_tokens", in_price), ("output_tokens", out_price)))
        return F.struct(F.lit(model).alias("model"), F.round(i, 6).alias("input_cost_usd"),
                        F.round(o, 6).alias("output_cost_usd"), F.round(i + o, 6).alias("total_cost_usd"))

    return one.select("summary", latency.alias("latency"), F.array(*[price(*p) for p in prices]).alias("cost"))


def slo_report(summary: DataFrame, stage: str = "total",
               targets: list[tuple[str, float]] = C.SLO_TARGETS_MS) -> DataFrame:
    """Percentile of one stage against its target: Met / Missed."""
    arr = F.array(*[F.struct(F.lit(n).alias("percentile"), F.lit(v).alias("target_ms")) for n, v in targets])
    s = summary.where(F.col("stage") == stage).select("*", F.explode(arr).alias("t"))
    value = F.when(F.col("t.percentile") == "p50", F.col("p50_ms")) \
             .when(F.col("t.percentile") == "p90", F.col("p90_ms")).otherwise(F.col("p99_ms"))
    return s.select(F.col("t.percentile").alias("percentile"), value.alias("value_ms"),
                    F.col("t.target_ms").alias("target_ms"),
                    F.when(value < F.col("t.target_ms"), F.lit("Met")).otherwise(F.lit("Missed")).alias("result"))


def failure_sample(samples: DataFrame, order_col: str = "request_id",
                   n: int = C.FAILURE_SAMPLE_ROWS) -> DataFrame:
    """First ``n`` failures (deterministic order) with the error cut to 160 chars.
    ``orderBy().limit()`` plans as a top-k (TakeOrderedAndProject), not a full sort."""
    return samples.where(~F.col("ok")).orderBy(order_col).limit(n).select(
        order_col, "status", F.substring("error", 1, C.FAILURE_SAMPLE_CHARS).alias("error"))


def round_robin(requests: DataFrame, id_col: str, questions: list[str] = C.DEFAULT_QUESTIONS) -> DataFrame:
    """T5: question ``i mod len(list)`` for request ``i``."""
    arr = F.array(*[F.lit(q) for q in questions])
    return requests.select(id_col, F.element_at(arr, (F.pmod(F.col(id_col), F.lit(len(questions))) + 1)
                                                .cast("int")).alias("question"))


def _event_time(df: DataFrame, ts_col: str):
    """The event-time column as TIMESTAMP (a cast only for TIMESTAMP_NTZ input, so a
    watermarked streaming column is used as is)."""
    if df.schema[ts_col].dataType.typeName() == "timestamp":
        return F.col(ts_col)
    return F.col(ts_col).cast("timestamp")


def quota_daily(log: DataFrame, key_col: str, ts_col: str, limit: int = C.DAILY_QUOTA) -> DataFrame:
    """Requests per key and UTC day against the daily quota (partial aggregation)."""
    w = F.window(_event_time(log, ts_col), "1 day")
    g = log.groupBy(key_col, w.alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
    return g.select(key_col, F.col("w.start").alias("day_start"), "requests",
                    (F.col("requests") > limit).alias("over_quota"))


def rate_windows(log: DataFrame, ts_col: str, length: str, slide: str | None, limit: int) -> DataFrame:
    """Request count per tumbling (or sliding) window against a limit."""
    t = _event_time(log, ts_col)
    w = F.window(t, length, slide) if slide else F.window(t, length)
    g = log.groupBy(w.alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") > limit).alias("over_limit"))


def sessions(log: DataFrame, key_col: str, ts_col: str, gap: str = "30 minutes",
             bucket_seconds: int = 86_400) -> DataFrame:
    """Sessions of activity per key (a new session after ``gap`` of silence).

    Two phases so that a hot key is not sessionized in one task: (1) sessions inside
    each (key, time bucket) group -- a hot key spreads over its buckets; (2) the
    compacted session intervals are merged across bucket borders with a dynamic-gap
    ``session_window`` (interval ``[first, last + gap]``; overlapping intervals merge,
    which is exactly Spark's event-level merge rule). Result equals a single
    ``session_window(ts, gap)`` aggregation.
    """
    t = _event_time(log, ts_col)
    ev = log.select(key_col, t.alias("_ts"))
    bucket = F.floor(F.unix_seconds("_ts") / F.lit(bucket_seconds))
    s1 = ev.groupBy(key_col, bucket.alias("_b"), F.session_window("_ts", gap).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"))
    s1 = s1.select(key_col, F.col("_s.start").alias("_start"), F.col("_s.end").alias("_end"), "_n")
    span_us = F.unix_micros("_end") - F.unix_micros("_start")
    span = F.make_interval(secs=(span_us.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    s2 = s1.groupBy(key_col, F.session_window("_start", span).alias("s")) \
           .agg(F.sum("_n").cast("bigint").alias("requests"))
    return s2.select(key_col, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                     "requests")
