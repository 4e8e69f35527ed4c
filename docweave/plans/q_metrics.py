"""Benchmark-report and request-log queries: S6, A6-A10, A12, A13, J8, W4, T5, K5, E3,
and the batch forms of R4-R6.

The ``events`` table is the request log: one request per row, ``value`` its latency in
ms, ``event_type`` the stage measured (click = embedding, view = retrieval, purchase =
llm, signup = total) or ``error`` for a failed request, ``user_id`` the API key and
``props.k`` the request's input-token count (output tokens = k / 3).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import metrics as M
from docweave.plans import sqltext as S
from docweave.plans.catalog import query
from docweave.sources import events as ev
from docweave.sources.tables import read_table

q = S.q

STAGE_SQL = ("CASE event_type WHEN 'click' THEN 'embedding' WHEN 'view' THEN 'retrieval' "
             "WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'total' END")
K_SQL = "CAST(json_extract(props, '$.k') AS INTEGER)"
SAMPLES_SQL = f"""samples AS (
  SELECT event_id AS request_id, event_type <> 'error' AS ok, {STAGE_SQL} AS stage, value AS ms,
         {K_SQL} AS input_tokens, CAST(floor({K_SQL} / 3) AS INTEGER) AS output_tokens, ts, user_id
  FROM events)"""


def samples(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("request_id"), (F.col("event_type") != "error").alias("ok"),
                    M.stage_of(F.col("event_type")).alias("stage"), F.col("value").alias("ms"),
                    k.alias("input_tokens"), F.floor(k / 3).cast("int").alias("output_tokens"),
                    "ts", "user_id")


def stage_long(spark, sf_dir):
    """Successful requests in long form (stage, ms)."""
    return samples(spark, sf_dir).where("ok").select("stage", "ms")


PCT_SQL = ", ".join(f"round(quantile_cont(ms, {p}), 6) AS {n}" for n, p in M.PCTS.items())


@query("percentiles", oracle=f"""WITH {SAMPLES_SQL}
SELECT stage, {PCT_SQL} FROM samples WHERE ok GROUP BY stage""")
def percentiles(spark, sf_dir):
    """Exact interpolated p50/p90/p99 per stage (distributed, sort based), 6 digits."""
    p = M.exact_percentiles(stage_long(spark, sf_dir), ["stage"], "ms")
    return p.select("stage", *[F.round(n, 6).alias(n) for n in M.PCTS])


SUMMARY_SQL = f"""summary AS (
  SELECT s.stage, CAST(count(x.ms) AS BIGINT) AS count, round(avg(x.ms), 2) AS mean_ms,
         round(quantile_cont(x.ms, 0.5), 2) AS p50_ms, round(quantile_cont(x.ms, 0.9), 2) AS p90_ms,
         round(quantile_cont(x.ms, 0.99), 2) AS p99_ms, round(max(x.ms), 2) AS max_ms
  FROM (VALUES ('embedding'), ('retrieval'), ('llm'), ('total')) s(stage)
  LEFT JOIN (SELECT stage, ms FROM samples WHERE ok) x ON x.stage = s.stage
  GROUP BY s.stage)"""


@query("latency_summary", oracle=f"WITH {SAMPLES_SQL}, {SUMMARY_SQL} SELECT * FROM summary")
def latency_summary(spark, sf_dir):
    """Count, mean, p50, p90, p99 and max per stage, 2 digits; empty stages kept."""
    return M.latency_summary(stage_long(spark, sf_dir))


# while a group has fewer values than the sketch's accuracy its percentiles are observed values
APPROX_SQL = SUMMARY_SQL.replace("quantile_cont", "quantile_disc")


@query("latency_summary_approx", oracle=f"WITH {SAMPLES_SQL}, {APPROX_SQL} SELECT * FROM summary")
def latency_summary_approx(spark, sf_dir):
    """The same table with percentile_approx (bounded-memory sketch) for huge logs."""
    return M.latency_summary(stage_long(spark, sf_dir), approx=True)


TOTALS_SQL = """totals AS (
  SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS success,
         CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
         CAST(COALESCE(sum(input_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS input_tokens,
         CAST(COALESCE(sum(output_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS output_tokens
  FROM samples)"""


@query("request_totals", oracle=f"WITH {SAMPLES_SQL}, {TOTALS_SQL} SELECT * FROM totals")
def request_totals(spark, sf_dir):
    """Request, success and failure counts; token sums over successes."""
    return M.request_totals(samples(spark, sf_dir))


PRICES_SQL = "prices(model, in_price, out_price) AS (VALUES " + ", ".join(
    f"({q(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in C.PRICE_TABLE) + ")"
COST_SQL = f"""{PRICES_SQL},
cost AS (SELECT model, input_tokens, output_tokens,
           round(input_tokens / 1000.0 * in_price, 6) AS input_cost_usd,
           round(output_tokens / 1000.0 * out_price, 6) AS output_cost_usd,
           round(input_tokens / 1000.0 * in_price + output_tokens / 1000.0 * out_price, 6) AS total_cost_usd,
           requests, success, failed,
           input_tokens / 1000.0 * in_price + output_tokens / 1000.0 * out_price AS _raw
         FROM totals CROSS JOIN prices)"""


@query("cost_table", oracle=f"""WITH {SAMPLES_SQL}, {TOTALS_SQL}, {COST_SQL}
SELECT model, input_tokens, output_tokens, input_cost_usd, output_cost_usd, total_cost_usd FROM cost""")
def cost_table(spark, sf_dir):
    """J8 + A10: observed token mix priced for each model tier."""
    c = M.cost_table(M.request_totals(samples(spark, sf_dir)))
    return c.select("model", "input_tokens", "output_tokens", "input_cost_usd", "output_cost_usd",
                    "total_cost_usd")


@query("cost_per_1k", oracle=f"""WITH {SAMPLES_SQL}, {TOTALS_SQL}, {COST_SQL}
SELECT model, round(_raw / success * 1000, 6) AS cost_per_1k_usd FROM cost""")
def cost_per_1k(spark, sf_dir):
    """A10: cost per 1,000 successful questions for each model tier."""
    totals = M.request_totals(samples(spark, sf_dir))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("i"), F.lit(o).alias("o"))
                    for m, i, o in C.PRICE_TABLE])
    t = totals.select("*", F.explode(arr).alias("p"))
    raw = F.col("input_tokens") / 1000.0 * F.col("p.i") + F.col("output_tokens") / 1000.0 * F.col("p.o")
    return t.select(F.col("p.model").alias("model"),
                    F.round(raw / F.col("success") * 1000, 6).alias("cost_per_1k_usd"))


@query("slo_report", oracle=f"""WITH {SAMPLES_SQL}, {SUMMARY_SQL},
t(percentile, target_ms) AS (VALUES {", ".join(f"({q(n)}, {v}::DOUBLE)" for n, v in C.SLO_TARGETS_MS)})
SELECT t.percentile, CASE t.percentile WHEN 'p50' THEN p50_ms WHEN 'p90' THEN p90_ms ELSE p99_ms END AS value_ms,
       t.target_ms,
       CASE WHEN (CASE t.percentile WHEN 'p50' THEN p50_ms WHEN 'p90' THEN p90_ms ELSE p99_ms END) < t.target_ms
            THEN 'Met' ELSE 'Missed' END AS result
FROM summary CROSS JOIN t WHERE summary.stage = 'total'""")
def slo_report(spark, sf_dir):
    """End-to-end p50/p90/p99 against the 2 s / 3 s / 4 s targets."""
    return M.slo_report(M.latency_summary(stage_long(spark, sf_dir)))


def bench_responses(spark, sf_dir):
    """HTTP responses reconstructed from the log, for the sample parser."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stage = M.stage_of(F.col("event_type"))
    ok = F.col("event_type") != "error"
    latency = F.to_json(F.create_map(stage, F.col("value")))
    body_ok = F.concat(F.lit('{"answer": "answer for request '), F.col("event_id").cast("string"),
                       F.lit(' of key '), F.col("user_id").cast("string"), F.lit('", "latency_ms": '),
                       latency, F.lit(', "usage": {"input_tokens": '), k.cast("string"),
                       F.lit(', "output_tokens": '), F.floor(k / 3).cast("string"), F.lit("}}"))
    body_err = F.concat(F.lit('{"error": "RAG query failed", "error_type": "RuntimeError", "request": '),
                        F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", F.when(ok, 200).otherwise(500).alias("http_status"),
                    F.when(ok, body_ok).otherwise(body_err).alias("body"), F.col("value").alias("wall_ms"))


SAMPLE_PARSE_SQL = f"""parsed AS (
  SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value AS total_ms,
         CASE WHEN event_type = 'click' THEN value END AS embedding_ms,
         CASE WHEN event_type = 'view' THEN value END AS retrieval_ms,
         CASE WHEN event_type = 'purchase' THEN value END AS llm_ms,
         CASE WHEN event_type = 'error' THEN 0 ELSE {K_SQL} END AS input_tokens,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor({K_SQL} / 3) AS INTEGER) END AS output_tokens,
         CASE WHEN event_type = 'error' THEN left('{{"error": "RAG query failed", "error_type": "RuntimeError", "request": '
              || CAST(event_id AS VARCHAR) || '}}', 200) ELSE '' END AS error,
         CASE WHEN event_type = 'error' THEN '' ELSE left('answer for request ' || CAST(event_id AS VARCHAR)
              || ' of key ' || CAST(user_id AS VARCHAR), 120) END AS answer_preview
  FROM events)"""


@query("bench_sample_parse", oracle=f"WITH {SAMPLE_PARSE_SQL} SELECT * FROM parsed")
def bench_sample_parse(spark, sf_dir):
    """One typed benchmark sample per HTTP response (status, body, wall time)."""
    p = ev.parse_bench_samples(bench_responses(spark, sf_dir))
    return p.select("event_id", "ok", "status", "total_ms", "embedding_ms", "retrieval_ms", "llm_ms",
                    "input_tokens", "output_tokens", "error", "answer_preview")


@query("failure_sample", oracle=f"""WITH {SAMPLE_PARSE_SQL}
SELECT event_id AS request_id, status, left(error, {C.FAILURE_SAMPLE_CHARS}) AS error
FROM parsed WHERE NOT ok ORDER BY event_id LIMIT {C.FAILURE_SAMPLE_ROWS}""")
def failure_sample(spark, sf_dir):
    """The first five failed samples (by request id), error cut to 160 characters."""
    p = ev.parse_bench_samples(bench_responses(spark, sf_dir)).withColumnRenamed("event_id", "request_id")
    return M.failure_sample(p, "request_id")


REPORT_STATS = ("count", "mean_ms", "p50_ms", "p90_ms", "p99_ms", "max_ms")
REPORT_COSTS = ("input_cost_usd", "output_cost_usd", "total_cost_usd")


@query("bench_report", oracle=f"""WITH {SAMPLES_SQL}, {TOTALS_SQL}, {SUMMARY_SQL}, {COST_SQL}
SELECT t.requests, t.success, t.failed, t.input_tokens, t.output_tokens, {", ".join(
    f"(SELECT {c} FROM summary WHERE stage = {q(s)}) AS {s}_{c}" for s in C.LATENCY_STAGES for c in REPORT_STATS)},
  {", ".join(f"(SELECT {c} FROM cost WHERE model = {q(m)}) AS m{i}_{c}"
             for i, (m, _, _) in enumerate(C.PRICE_TABLE) for c in REPORT_COSTS)}
FROM totals t""")
def bench_report(spark, sf_dir):
    """The report record (totals, four latency stages, a cost row per model) written as
    JSON by its sink, read back and laid out in columns."""
    from docweave.session import scratch_path
    from docweave.sinks import tables as sinks
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    made = M.report(samples(spark, sf_dir))
    sinks.write_report(made, path)
    r = spark.read.schema(made.schema).json(path)
    return r.select(
        "summary.*", *[F.col("latency")[s][c].alias(f"{s}_{c}") for s in C.LATENCY_STAGES for c in REPORT_STATS],
        *[F.get("cost", F.lit(i))[c].alias(f"m{i}_{c}") for i in range(len(C.PRICE_TABLE)) for c in REPORT_COSTS])


@query("stored_sketch_percentiles")
def stored_sketch_percentiles(spark, sf_dir):
    """Latency sketches kept per hour and stage, stored, and merged to days: percentiles
    with the rank that each really has in the day's log (``<p>_rank``) and the bound of the
    difference (``rank_error``)."""
    from docweave.operators import sketches
    from docweave.session import scratch_path
    log = samples(spark, sf_dir).where("ok").select("stage", F.col("ts").cast("timestamp").alias("ts"), "ms")
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    sketches.write_sketches(sketches.sketch(log, ["stage"], "ts", "ms"), path)
    day = F.date_format("slot_start", "yyyy-MM-dd").alias("day")
    days = sketches.merged(sketches.read_sketches(spark, path), [day, "stage"])
    values = log.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "stage", "ms")
    ranks = values.join(days, ["day", "stage"]).groupBy("day", "stage").agg(*[
        F.avg((F.col("ms") <= F.col(p)).cast("double")).alias(f"{p}_rank") for p in M.PCTS])
    return days.join(ranks, ["day", "stage"]).withColumn("rank_error", F.lit(sketches.rank_error()))


@query("workload_round_robin", oracle=f"""
SELECT event_id AS request_id,
       [{", ".join(q(x) for x in C.DEFAULT_QUESTIONS)}][CAST(event_id % {len(C.DEFAULT_QUESTIONS)} AS INTEGER) + 1] AS question
FROM events""")
def workload_round_robin(spark, sf_dir):
    """T5: the fixed question list assigned round-robin to every logged request."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"))
    return M.round_robin(e, "request_id")


@query("time_to_searchable", oracle="""
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         min(ts) FILTER (WHERE event_type = 'signup') AS processed_at,
         max(ts) FILTER (WHERE event_type = 'purchase') AS indexed_at
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
lat AS (SELECT epoch_us(indexed_at) / 1e6 - epoch_us(processed_at) / 1e6 AS s FROM d
        WHERE indexed_at >= processed_at)
SELECT CAST(count(*) AS BIGINT) AS documents, round(quantile_cont(s, 0.5), 2) AS p50_s,
       round(quantile_cont(s, 0.9), 2) AS p90_s, round(quantile_cont(s, 0.99), 2) AS p99_s,
       CAST(count(*) FILTER (WHERE s <= 60) AS BIGINT) AS within_target FROM lat""")
def time_to_searchable(spark, sf_dir):
    """Processed -> indexed delay per (key, day): first 'signup' is the processed time,
    last 'purchase' the indexed time; percentiles and count within the 60 s target."""
    e = read_table(spark, sf_dir, "events")
    d = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("processed_at"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("indexed_at"))
    lat = d.where(F.col("indexed_at") >= F.col("processed_at")).select(
        ((F.unix_micros(F.col("indexed_at").cast("timestamp"))
          - F.unix_micros(F.col("processed_at").cast("timestamp"))) / 1e6).alias("s"),
        F.lit("all").alias("g"))
    pct = M.exact_percentiles(lat, ["g"], "s")
    # one global row; the percentiles are scalar subqueries of the one-group result
    p = pct.select(F.struct("p50", "p90", "p99")).scalar()      # one subquery, three values
    return lat.agg(F.count(F.lit(1)).cast("bigint").alias("documents"),
                   F.count_if(F.col("s") <= C.TIME_TO_SEARCHABLE_TARGET_S).cast("bigint")
                   .alias("within_target")).select(
        "documents",
        F.round(p["p50"], 2).alias("p50_s"), F.round(p["p90"], 2).alias("p90_s"),
        F.round(p["p99"], 2).alias("p99_s"), "within_target")


#: Limits for a log of few requests a second and a day; the service's own are C.DAILY_QUOTA,
#: C.RATE_LIMIT_PER_S and C.BURST_LIMIT.
AUDIT_QUOTA, AUDIT_RATE, AUDIT_BURST = 4, 1, 1


@query("quota_daily", oracle=f"""
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start,
       CAST(count(*) AS BIGINT) AS requests, count(*) > {AUDIT_QUOTA} AS over_quota
FROM events GROUP BY user_id, date_trunc('day', ts)""")
def quota_daily(spark, sf_dir):
    """R4 (batch): requests per API key and day against a quota that the log does cross."""
    e = read_table(spark, sf_dir, "events")
    r = M.quota_daily(e, "user_id", "ts", AUDIT_QUOTA)
    return r.select("user_id", F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"),
                    "requests", "over_quota")


@query("rate_audit", oracle=f"""
SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS requests,
       count(*) > {AUDIT_RATE} AS over_limit
FROM events GROUP BY date_trunc('second', ts)""")
def rate_audit(spark, sf_dir):
    """R5 (batch): requests per second against a rate that the log does cross."""
    r = M.rate_windows(read_table(spark, sf_dir, "events"), "ts", "1 second", None, AUDIT_RATE)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "requests", "over_limit")


@query("burst_audit", oracle=f"""
WITH w AS (SELECT date_trunc('second', ts) - to_seconds(CAST(k AS BIGINT)) AS ws
           FROM events, range(0, 10) r(k))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS requests,
       count(*) > {AUDIT_BURST} AS over_limit
FROM w GROUP BY ws""")
def burst_audit(spark, sf_dir):
    """R5 (batch): sliding 10-second windows every second against a burst the log crosses."""
    r = M.rate_windows(read_table(spark, sf_dir, "events"), "ts", "10 seconds", "1 second", AUDIT_BURST)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "requests", "over_limit")


SESSIONS_SQL = """
WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                  OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
           FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       CAST(count(*) AS BIGINT) AS requests
FROM s GROUP BY user_id, sid"""


@query("abuse_sessions", oracle=SESSIONS_SQL)
def abuse_sessions(spark, sf_dir):
    """R6 (batch): per-key sessions of questioning with a 30-minute inactivity gap."""
    r = M.sessions(read_table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select("user_id", F.date_format("session_start", fmt).alias("session_start"),
                    F.date_format("session_end", fmt).alias("session_end"), "requests")


def access_log_lines(e):
    """Gateway access-log records (11 string fields) reconstructed from the request log."""
    return e.select(
        F.col("event_id").cast("string").alias("requestId"),
        F.concat(F.lit("10.0."), F.pmod("user_id", F.lit(256)).cast("string"), F.lit(".1")).alias("ip"),
        F.lit("-").alias("caller"), F.lit("-").alias("user"),
        F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss Z").alias("requestTime"),
        F.lit("POST").alias("httpMethod"), F.lit("/query").alias("resourcePath"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        F.lit("HTTP/1.1").alias("protocol"), F.col("value").cast("string").alias("responseLength"),
        F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("apiKeyId"))


@query("access_log_daily", oracle="""
SELECT strftime(CAST(date_trunc('second', ts) AS DATE), '%Y-%m-%d') AS day,
       CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
       CAST(count(*) AS BIGINT) AS requests, CAST(count(DISTINCT user_id) AS BIGINT) AS api_keys
FROM events GROUP BY ALL""")
def access_log_daily(spark, sf_dir):
    """Access log written as JSON lines, read back with the declared 11-field schema,
    request time parsed; requests and distinct API keys per day and status."""
    import uuid

    from docweave.session import scratch_path
    path = scratch_path(spark, f"access-log-{uuid.uuid4().hex}")
    access_log_lines(read_table(spark, sf_dir, "events")).write.json(path)
    log = ev.read_access_log(spark, path)
    return log.groupBy(F.date_format("request_ts", "yyyy-MM-dd").alias("day"), "status").agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.countDistinct("apiKeyId").cast("bigint").alias("api_keys"))
