"""Question answering assembly: J7 late materialisation, A15 context block, A16 citation
counts, P13 prompt, U3 generator hook, P14 response flattening, P15 refusal flag, E2.

Only the top-k keys travel through the ranking; chunk text and metadata are joined back
afterwards (k rows per question), and grouping per question handles at most k rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from docweave import constants as C
from docweave.functions import text as T

RESPONSE_SCHEMA = TY.StructType([
    TY.StructField("content", TY.ArrayType(TY.StructType([
        TY.StructField("type", TY.StringType()),
        TY.StructField("text", TY.StringType())]))),
    TY.StructField("usage", TY.StructType([
        TY.StructField("input_tokens", TY.LongType()),
        TY.StructField("output_tokens", TY.LongType())])),
])

HIT_META = ["source_document", "chunk_id", "pii_masked_flag", "text_chunk"]


def attach_sources(hits: DataFrame, index: DataFrame, key: str = "chunk_key",
                   broadcast_hits: bool = False) -> DataFrame:
    """Join the k hits per question back to chunk text and metadata by key.

    A hit whose key is not in the index stays, with null metadata. With ``broadcast_hits``
    (the caller has bounded the question count, so the hit list holds at most questions x k
    rows) the index is first filtered in place by the broadcast hit keys, so only the hits'
    rows meet the join; the result is the same."""
    meta = index.select(key, *HIT_META)
    if broadcast_hits:
        meta = meta.join(F.broadcast(hits.select(key).distinct()), key, "left_semi")
    return hits.join(meta, key, "left")


def format_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question ``context`` text, ``sources`` array and ``retrieved_count``.

    Passages read ``[i] (source: S)\\ntext`` and are separated by a blank line; a missing
    or empty source name reads ``unknown``; no hit gives the fixed no-context sentence.
    """
    h = hits.select(
        "query_id",
        F.struct(
            F.col("rank"), F.col("score"),
            T.first_non_empty(F.col("source_document"), F.lit(C.UNKNOWN_SOURCE)).alias("source_document"),
            F.col("chunk_id"), F.col("pii_masked_flag"),
            F.coalesce(F.col("text_chunk"), F.lit("")).alias("text_chunk")).alias("h"))
    per_q = h.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    joined = questions.join(per_q, "query_id", "left")
    hits_arr = F.coalesce(F.col("hits"), F.array().cast(per_q.schema["hits"].dataType))
    passages = F.transform(hits_arr, lambda x: F.concat(
        F.lit("["), x["rank"].cast("string"), F.lit("] (source: "), x["source_document"],
        F.lit(")\n"), x["text_chunk"]))
    context = F.when(F.size(hits_arr) == 0, F.lit(C.NO_CONTEXT_TEXT)) \
               .otherwise(F.array_join(passages, "\n\n"))
    sources = F.transform(hits_arr, lambda x: F.struct(
        x["rank"].alias("rank"), x["score"].alias("score"),
        x["source_document"].alias("source_document"), x["chunk_id"].alias("chunk_id"),
        x["pii_masked_flag"].alias("pii_masked_flag")))
    top_score = F.when(F.size(hits_arr) > 0, hits_arr[0]["score"])
    first_text = F.when(F.size(hits_arr) > 0, hits_arr[0]["text_chunk"])
    return joined.select(*[c for c in questions.columns],
                         context.alias("context"), sources.alias("sources"),
                         F.size(hits_arr).cast("int").alias("retrieved_count"),
                         top_score.alias("top_score"), first_text.alias("_first_passage"))


def build_prompt(df: DataFrame, context_col: str = "context", question_col: str = "question") -> DataFrame:
    """System prompt = fixed instructions + ``CONTEXT:`` + context; model request JSON
    with the user question, max_tokens and temperature."""
    system = F.concat(F.lit(C.SYSTEM_PROMPT_PREFIX), F.col(context_col))
    request = F.to_json(F.struct(
        F.lit(C.MAX_TOKENS).alias("max_tokens"),
        F.lit(C.TEMPERATURE).alias("temperature"),
        system.alias("system"),
        F.array(F.struct(F.lit("user").alias("role"),
                         F.array(F.struct(F.lit("text").alias("type"),
                                          F.col(question_col).alias("text"))).alias("content")))
         .alias("messages")))
    return df.withColumn("system_prompt", system).withColumn("request_json", request)


def extractive_generate(df: DataFrame, min_score: float = 0.0) -> DataFrame:
    """U3 default (offline stand-in, not a language model): the answer is the best
    passage when its score exceeds ``min_score``, otherwise the refusal sentence. Writes a
    model-style ``response_json`` (text block + usage) so P14 parses it like any model's.
    Token usage counts whitespace tokens of system prompt + question, and of the answer.
    """
    answer = F.when(F.col("top_score") > F.lit(min_score), F.col("_first_passage")) \
              .otherwise(F.lit(C.REFUSAL_SENTENCE))
    in_tok = (F.size(T.tokens(F.col("system_prompt"))) + F.size(T.tokens(F.col("question")))).cast("long")
    out_tok = F.size(T.tokens(answer)).cast("long")
    resp = F.to_json(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), answer.alias("text"))).alias("content"),
        F.struct(in_tok.alias("input_tokens"), out_tok.alias("output_tokens")).alias("usage")))
    return df.withColumn("response_json", resp)


def model_generate(df: DataFrame, model_fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """U3 hook: ``model_fn`` takes a pandas frame with ``system_prompt`` and ``question``
    and returns response JSON strings; called once per Arrow batch via ``mapInPandas``."""
    out_schema = TY.StructType(df.schema.fields + [TY.StructField("response_json", TY.StringType())])

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["response_json"] = model_fn(b[["system_prompt", "question"]])
            yield b

    return df.mapInPandas(fn, out_schema)


def parse_model_response(df: DataFrame, col: str = "response_json") -> DataFrame:
    """Keep text blocks, drop empty ones, join by newline, strip; token counts
    default to 0; an empty answer is an error (``status_code`` 500)."""
    r = F.from_json(F.col(col), RESPONSE_SCHEMA)
    blocks = F.filter(F.coalesce(r["content"], F.array().cast(RESPONSE_SCHEMA["content"].dataType)),
                      lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    answer = T.strip(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))
    return (df.withColumn("_r", r)
              .withColumn("answer", F.when(answer != "", answer))
              .withColumn("input_tokens", F.coalesce(F.col("_r.usage.input_tokens"), F.lit(0)).cast("int"))
              .withColumn("output_tokens", F.coalesce(F.col("_r.usage.output_tokens"), F.lit(0)).cast("int"))
              .withColumn("status_code", F.when(F.col("answer").isNull(), F.lit(500)).otherwise(F.lit(200)))
              .withColumn("error_type", F.when(F.col("answer").isNull(), F.lit("ValueError")))
              .drop("_r"))


def is_refusal(answer: Column) -> Column:
    """The answer is the fixed refusal sentence (after stripping whitespace)."""
    return F.coalesce(T.strip(answer) == F.lit(C.REFUSAL_SENTENCE), F.lit(False))


def answer_records(df: DataFrame, errors: bool = False) -> DataFrame:
    """K6 body: answer record per question (latency is a batch metric, left NULL); with
    ``errors`` also ``error_type`` and ``error_message`` for the bodies of failed ones."""
    lat = F.struct(*[F.lit(None).cast("double").alias(s) for s in C.LATENCY_STAGES])
    return df.select(
        "query_id", "status_code", "answer", "sources", "retrieved_count",
        F.lit(C.GEN_MODEL_ID).alias("model_id"), F.lit(C.EMBED_MODEL_ID).alias("embed_model_id"),
        F.struct("input_tokens", "output_tokens").alias("usage"), lat.alias("latency_ms"),
        *([F.col("error_type"), F.when(F.col("error_type").isNotNull(), F.lit(C.EMPTY_ANSWER))
           .alias("error_message")] if errors else []))


def citation_counts(hits: DataFrame) -> DataFrame:
    """How often each source document is cited, and by how many questions."""
    return hits.groupBy("source_document").agg(
        F.count(F.lit(1)).cast("bigint").alias("citations"),
        F.countDistinct("query_id").cast("bigint").alias("questions"))
