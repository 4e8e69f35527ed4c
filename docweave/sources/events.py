"""S2 object-event records, S4 question requests, S5 access logs, S6 benchmark samples.

Untrusted JSON is parsed with ``try_parse_json`` / ``try_variant_get`` (VARIANT), so a
malformed record becomes a status row instead of failing the job (ANSI mode is on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave import schemas
from docweave.functions import text as T


def _vget(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def _truthy(c: Column) -> Column:
    """Python truthiness of a string value: not null and not empty."""
    return c.isNotNull() & (c != "")


def resolve_event_location(df: DataFrame, json_col: str = "event_json") -> DataFrame:
    """S2 + P3: ``bucket``, ``key`` and ``resolve_status`` from one of three event shapes.

    Priority: flat ``{bucket, key}``; then ``detail.bucket.(name|bucketName)`` with
    ``detail.object.key``; then the first element of ``Records``. Keys are URL-decoded
    (``+`` -> space, ``%XX``); a malformed escape keeps the raw key. No match, or an
    unparsable record, gives ``resolve_status = 'FAILED'`` with the reason.
    """
    v = F.try_parse_json(F.col(json_col))
    flat_b, flat_k = _vget(v, "$.bucket"), _vget(v, "$.key")
    det_b = F.coalesce(F.nullif(_vget(v, "$.detail.bucket.name"), F.lit("")),
                       _vget(v, "$.detail.bucket.bucketName"))
    det_k = _vget(v, "$.detail.object.key")
    rec_b, rec_k = _vget(v, "$.Records[0].s3.bucket.name"), _vget(v, "$.Records[0].s3.object.key")
    flat = _truthy(flat_b) & _truthy(flat_k)
    detail = _truthy(det_b) & _truthy(det_k)
    records = rec_b.isNotNull() & rec_k.isNotNull()
    bucket = F.when(flat, flat_b).when(detail, det_b).when(records, rec_b)
    raw_key = F.when(flat, flat_k).when(detail, det_k).when(records, rec_k)
    status = F.when(v.isNull(), F.lit("FAILED")).when(bucket.isNull(), F.lit("FAILED")) \
              .otherwise(F.lit("RESOLVED"))
    reason = F.when(v.isNull(), F.lit("invalid JSON")) \
              .when(bucket.isNull(), F.lit("Unable to resolve bucket/key from event"))
    shape = F.when(flat, F.lit("flat")).when(detail, F.lit("detail")).when(records, F.lit("records"))
    return df.select("*", bucket.alias("bucket"), T.url_decode_key(raw_key).alias("key"),
                     shape.alias("event_shape"), status.alias("resolve_status"),
                     reason.alias("resolve_error"))


def parse_question_requests(df: DataFrame) -> DataFrame:
    """S4 + F8 + P11: question from an HTTP-style envelope.

    ``body`` is JSON text, base64-encoded when ``is_base64``. A JSON object gives its
    ``question`` (null -> "", numbers -> their text, then stripped); an empty question is
    a 400 row; a body that is not an object, not JSON or not valid base64 is a 500 row
    (``ValueError``). Credential headers are masked in ``headers_masked``.
    """
    raw = F.col("body")
    decoded = F.when(F.coalesce(F.col("is_base64"), F.lit(False)),
                     F.try_to_binary(raw, F.lit("base64")).cast("string")).otherwise(raw)
    decoded = F.make_valid_utf8(decoded)
    # an empty body is treated as {} (no question)
    v = F.when(F.coalesce(decoded, F.lit("")) == "", F.parse_json(F.lit("{}"))) \
         .otherwise(F.try_parse_json(decoded))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    q = T.strip(F.coalesce(_vget(v, "$.question"), F.lit("")))
    status = F.when(~is_obj, F.lit(500)).when(q == "", F.lit(400)).otherwise(F.lit(200))
    err = F.when(~is_obj, F.lit("Request body must be a JSON object")) \
           .when(q == "", F.lit("Missing required field: question"))
    out = df.select("*", F.when(is_obj, q).alias("question"), status.alias("status_code"),
                    err.alias("error"))
    if "headers" in df.columns:
        out = out.withColumn("headers_masked", T.mask_headers("headers"))
    return out


def read_access_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Gateway access log (JSON lines, 11 string fields) with a typed request time."""
    reader = (spark.readStream if streaming else spark.read).schema(schemas.ACCESS_LOG)
    df = reader.json(path)
    return df.withColumn("request_ts", F.try_to_timestamp(F.col("requestTime"),
                                                          F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def parse_bench_samples(df: DataFrame, status_col: str = "http_status", body_col: str = "body",
                        wall_col: str = "wall_ms") -> DataFrame:
    """Benchmark sample from one HTTP response.

    ``ok`` = status 200 and the body has ``answer``; ``total_ms`` = ``latency_ms.total``
    when truthy else the wall time; stage latencies are NULL when absent or not numeric;
    token counts default to 0; ``answer_preview`` = first 120 characters of the answer;
    for HTTP errors ``error`` = first 200 characters of the body.
    """
    v = F.try_parse_json(F.col(body_col))
    has_answer = F.coalesce(_vget(v, "$.answer", "variant").isNotNull(), F.lit(False))
    status = F.col(status_col).cast("int")
    ok = (status == 200) & has_answer
    total = F.try_variant_get(v, "$.latency_ms.total", "double")
    total_ms = F.when(status == 200, F.coalesce(F.nullif(total, F.lit(0.0)), F.col(wall_col))) \
                .otherwise(F.col(wall_col))
    stage = {s: F.when(status == 200, F.try_variant_get(v, f"$.latency_ms.{s}", "double"))
             for s in ("embedding", "retrieval", "llm")}
    tok = {t: F.when(status == 200, F.coalesce(F.try_variant_get(v, f"$.usage.{t}", "int"), F.lit(0)))
              .otherwise(F.lit(0)) for t in ("input_tokens", "output_tokens")}
    answer = F.coalesce(_vget(v, "$.answer"), F.lit(""))
    return df.select(
        "*",
        ok.alias("ok"), status.alias("status"), total_ms.cast("double").alias("total_ms"),
        stage["embedding"].alias("embedding_ms"), stage["retrieval"].alias("retrieval_ms"),
        stage["llm"].alias("llm_ms"),
        tok["input_tokens"].cast("int").alias("input_tokens"),
        tok["output_tokens"].cast("int").alias("output_tokens"),
        F.when(status != 200, F.substring(F.coalesce(F.col(body_col), F.lit("")), 1,
                                          C.ERROR_DETAIL_CHARS)).otherwise(F.lit("")).alias("error"),
        F.when(status == 200, F.substring(answer, 1, C.ANSWER_PREVIEW_CHARS)).otherwise(F.lit(""))
         .alias("answer_preview"))
