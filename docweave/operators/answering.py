"""Question requests to response bodies over an index that exists.

The index is searched where it is stored; only the k hits of each question meet their texts.
Requests without a question, or whose body is no object, become error records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import embedding, rag, retrieval
from docweave.sinks import tables as sinks
from docweave.sources import events as ev


def answer_requests(requests: DataFrame, index: DataFrame, dim: int = C.EMBED_DIMENSIONS, k: int = C.TOP_K,
                    min_score: float = 0.0, model_fn=None, generate=None) -> DataFrame:
    """``request_id, status_code, body`` of ``requests(request_id, is_base64, body)``.

    ``index`` holds index rows (``chunk_key``, ``vector`` and the source columns), as
    :func:`sinks.read_index` returns them. ``generate`` (default: the extractive stand-in) maps
    prompts to model responses. Hits are checkpointed: k rows a question, used twice."""
    parsed = ev.parse_question_requests(requests).checkpoint()
    asked = parsed.where("status_code = 200").select(F.col("request_id").alias("query_id"), "question")
    asked = embedding.embed(asked, "question", "query_vector", dim, model_fn).checkpoint()
    hits = retrieval.knn_search(asked.select("query_id", "query_vector"), index, k).checkpoint()
    context = rag.format_context(asked.select("query_id", "question"), rag.attach_sources(hits, index))
    prompted = rag.build_prompt(context)
    made = rag.extractive_generate(prompted, min_score) if generate is None else generate(prompted)
    failed = parsed.where("status_code <> 200").select(
        F.col("request_id").alias("query_id"), "status_code", F.col("error").alias("error_message"),
        F.when(F.col("status_code") == 500, F.lit("ValueError")).alias("error_type"))
    records = rag.answer_records(rag.parse_model_response(made), errors=True).unionByName(
        failed, allowMissingColumns=True)
    return sinks.answer_json(records).withColumnRenamed("query_id", "request_id")
