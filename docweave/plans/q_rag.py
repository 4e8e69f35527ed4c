"""Question-answering queries: J7, J11, A15, A16, P13-P15, U3, K6 and E2 (batch RAG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import constants as C
from docweave.operators import embedding, rag, retrieval
from docweave.plans import common
from docweave.plans import sqltext as S
from docweave.plans.catalog import query

q = S.q
NL = "chr(10)"
MIN_SCORE = 0.0
SURE_SCORE = 0.5          # below it the stricter refusal report gives no answer


def _retrieve(spark, sf_dir, lang: str | None = None, qs=None):
    """Questions (default: every benchmark text), top-k hits with metadata (J1 + J7),
    optionally filtered by language (J11)."""
    # a metadata filter (J11) is applied at the documents scan, before any text work
    rows = common.chunk_rows_checkpointed(spark, sf_dir,
                                          None if lang is None else F.col("lang") == lang)
    # the index side ships token codes; vectors are built inside the search task
    codes = rows.select("chunk_key", embedding.token_codes(F.col("text_chunk"), common.TEXT_DIM)
                        .alias("codes"))
    qs = common.questions(spark, sf_dir) if qs is None else qs
    hits = retrieval.knn_search(qs.select("query_id", "query_vector"), codes, C.TOP_K,
                                index_vec="codes",
                                index_vec_fn=embedding.hashed_batch_embedder(common.TEXT_DIM))
    hits = hits.checkpoint()        # k rows a question, read on both sides of a join: searched once
    # the hit list holds at most (#questions x k) rows: broadcast it only when the
    # question count is checked to be within the same bound the search uses
    bound = 20_000
    small = qs.select("query_id").limit(bound + 1).count() <= bound
    meta = rag.attach_sources(hits, rows, broadcast_hits=small)
    return qs.select("query_id", "question"), meta


def _answers(spark, sf_dir, qs=None, min_score=MIN_SCORE):
    qs, hits = _retrieve(spark, sf_dir, qs=qs)
    ctx = rag.format_context(qs, hits)
    prompted = rag.build_prompt(ctx)
    gen = rag.extractive_generate(prompted, min_score)
    return rag.parse_model_response(gen)


def _index_sql(lang: str | None = None) -> str:
    flt = f" WHERE lang = {q(lang)}" if lang else ""
    return f"""{common.chunk_rows_sql()},
search_index AS (SELECT * FROM chunk_rows{flt}),
{common.text_scores_sql(C.TOP_K, "search_index")}"""


HITS_SQL_SELECT = """
SELECT h.query_id, h.rank, h.score, h.chunk_key, c.source_document, c.chunk_id, c.pii_masked_flag
FROM hits h JOIN chunk_rows c USING (chunk_key)"""

CTX_SQL = f"""ctx AS (
  SELECT qt.query_id, qt.question,
    COALESCE(string_agg('[' || CAST(h.rank AS VARCHAR) || '] (source: ' ||
               COALESCE(NULLIF(c.source_document, ''), {q(C.UNKNOWN_SOURCE)}) || ')' || {NL} ||
               COALESCE(c.text_chunk, ''), {NL} || {NL} ORDER BY h.rank), {q(C.NO_CONTEXT_TEXT)}) AS context,
    CAST(count(h.rank) AS INTEGER) AS retrieved_count,
    max(h.score) FILTER (WHERE h.rank = 1) AS top_score,
    max(c.text_chunk) FILTER (WHERE h.rank = 1) AS first_passage
  FROM qtext qt LEFT JOIN hits h USING (query_id) LEFT JOIN chunk_rows c USING (chunk_key)
  GROUP BY qt.query_id, qt.question),
prompted AS (SELECT *, {q(C.SYSTEM_PROMPT_PREFIX)} || context AS system_prompt FROM ctx),
answered AS (SELECT *, CASE WHEN top_score > {MIN_SCORE} THEN first_passage
                          ELSE {q(C.REFUSAL_SENTENCE)} END AS answer0 FROM prompted),
final AS (SELECT *, NULLIF({S.strip_sql('answer0')}, '') AS answer,
    CAST(len({S.tokens_sql('system_prompt')}) + len({S.tokens_sql('question')}) AS INTEGER) AS input_tokens,
    CAST(len({S.tokens_sql('answer0')}) AS INTEGER) AS output_tokens FROM answered)"""


@query("retrieve_sources", oracle=f"WITH {_index_sql()} {HITS_SQL_SELECT}")
def retrieve_sources(spark, sf_dir):
    """J1 + J7: top-3 chunks per benchmark question, joined late to their metadata."""
    _, hits = _retrieve(spark, sf_dir)
    return hits.select("query_id", "rank", "score", "chunk_key", "source_document", "chunk_id",
                       "pii_masked_flag")


@query("knn_filtered", oracle=f"WITH {_index_sql('en')} {HITS_SQL_SELECT}")
def knn_filtered(spark, sf_dir):
    """The same search restricted to English chunks (filter before the search)."""
    _, hits = _retrieve(spark, sf_dir, lang="en")
    return hits.select("query_id", "rank", "score", "chunk_key", "source_document", "chunk_id",
                       "pii_masked_flag")


@query("context_format", oracle=f"""WITH {_index_sql()}, {CTX_SQL}
SELECT query_id, retrieved_count, context FROM ctx""")
def context_format(spark, sf_dir):
    """Numbered, attributed context block per question."""
    qs, hits = _retrieve(spark, sf_dir)
    return rag.format_context(qs, hits).select("query_id", "retrieved_count", "context")


@query("prompt_assembly", oracle=f"""WITH {_index_sql()}, {CTX_SQL}
SELECT query_id, system_prompt, question, {C.MAX_TOKENS} AS max_tokens,
       CAST({C.TEMPERATURE} AS DOUBLE) AS temperature FROM prompted""")
def prompt_assembly(spark, sf_dir):
    """System prompt (instructions + context) and generation parameters."""
    qs, hits = _retrieve(spark, sf_dir)
    p = rag.build_prompt(rag.format_context(qs, hits))
    r = F.from_json("request_json", "max_tokens int, temperature double")
    return p.select("query_id", "system_prompt", "question",
                    r["max_tokens"].alias("max_tokens"), r["temperature"].alias("temperature"))


@query("citation_counts", oracle=f"""WITH {_index_sql()}
SELECT c.source_document, CAST(count(*) AS BIGINT) AS citations,
       CAST(count(DISTINCT h.query_id) AS BIGINT) AS questions
FROM hits h JOIN chunk_rows c USING (chunk_key) GROUP BY c.source_document""")
def citation_counts(spark, sf_dir):
    """Citations per source document over all answered questions."""
    _, hits = _retrieve(spark, sf_dir)
    return rag.citation_counts(hits)


@query("batch_rag", oracle=f"""WITH {_index_sql()}, {CTX_SQL}
SELECT query_id, CASE WHEN answer IS NULL THEN 500 ELSE 200 END AS status_code, answer,
       retrieved_count, input_tokens, output_tokens,
       COALESCE({S.strip_sql('answer')} = {q(C.REFUSAL_SENTENCE)}, false) AS refused FROM final""")
def batch_rag(spark, sf_dir):
    """Questions -> vectors -> top-k -> context -> prompt -> generator -> parsed answer."""
    a = _answers(spark, sf_dir)
    return a.select("query_id", "status_code", "answer", "retrieved_count", "input_tokens",
                    "output_tokens", rag.is_refusal(F.col("answer")).alias("refused"))


@query("answer_records", oracle=f"""WITH {_index_sql()}, {CTX_SQL}
SELECT query_id, CASE WHEN answer IS NULL THEN 500 ELSE 200 END AS status_code, answer,
       retrieved_count, {q(C.GEN_MODEL_ID)} AS model_id, {q(C.EMBED_MODEL_ID)} AS embed_model_id,
       input_tokens, output_tokens FROM final""")
def answer_records(spark, sf_dir):
    """K6: answer record per question (flattened; ``sinks.answers`` writes it as JSON)."""
    rec = rag.answer_records(_answers(spark, sf_dir))
    return rec.select("query_id", "status_code", "answer", "retrieved_count", "model_id",
                      "embed_model_id", F.col("usage.input_tokens").alias("input_tokens"),
                      F.col("usage.output_tokens").alias("output_tokens"))


def question_requests(spark, sf_dir):
    """Every benchmark text as a request, some without a question and some whose body is no
    object, every third in base64."""
    from docweave.sources.tables import read_table
    k = F.col("item_id") % 5
    body = (F.when(k == 1, F.lit('{"question": "  "}')).when(k == 2, F.lit("[1, 2]"))
            .otherwise(F.to_json(F.struct(F.col("text").alias("question")))))
    coded = F.col("item_id") % 3 == 0
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), coded.alias("is_base64"),
        F.when(coded, F.base64(F.encode(body, "UTF-8"))).otherwise(body).alias("body"))


RESPONSES_SQL = f"""WITH {_index_sql()}, {CTX_SQL}
SELECT b.item_id AS request_id,
       CASE b.item_id % 5 WHEN 1 THEN 400 WHEN 2 THEN 500 ELSE CASE WHEN f.answer IS NULL THEN 500 ELSE 200 END END AS status_code,
       CASE WHEN b.item_id % 5 NOT IN (1, 2) THEN f.answer END AS answer,
       CASE WHEN b.item_id % 5 = 1 THEN {q(C.MISSING_QUESTION)}
            WHEN b.item_id % 5 = 2 OR f.answer IS NULL THEN {q(C.QUERY_FAILED)} END AS error,
       CASE WHEN b.item_id % 5 = 2 OR (b.item_id % 5 <> 1 AND f.answer IS NULL) THEN 'ValueError' END AS error_type
FROM benchmark b LEFT JOIN final f ON f.query_id = b.item_id"""


@query("rag_responses", oracle=RESPONSES_SQL)
def rag_responses(spark, sf_dir):
    """E2 from envelope to JSON body (S4, F8, K6): every benchmark text is a request, some
    without a question (400) and some whose body is no object (500), every third in base64."""
    from docweave.sinks import tables as sinks
    from docweave.sources import events as ev
    requests = question_requests(spark, sf_dir)
    parsed = ev.parse_question_requests(requests)
    asked = parsed.where("status_code = 200").select(F.col("request_id").alias("query_id"), "question")
    answered = _answers(spark, sf_dir, embedding.embed(asked, "question", "query_vector", common.TEXT_DIM))
    failed = parsed.where("status_code <> 200").select(
        F.col("request_id").alias("query_id"), "status_code", F.col("error").alias("error_message"),
        F.when(F.col("status_code") == 500, F.lit("ValueError")).alias("error_type"))
    records = rag.answer_records(answered, errors=True).unionByName(failed, allowMissingColumns=True)
    out = sinks.answer_json(records)

    def field(name):
        return F.get_json_object("body", f"$.{name}").alias(name)

    return out.select(F.col("query_id").alias("request_id"), "status_code", field("answer"),
                      field("error"), field("error_type"))


@query("refusal_rate", oracle=f"""WITH {_index_sql()}, {CTX_SQL.replace(f"top_score > {MIN_SCORE}", f"top_score > {SURE_SCORE}")}
SELECT CAST(count(*) AS BIGINT) AS questions,
       CAST(count(*) FILTER (WHERE {S.strip_sql('answer')} = {q(C.REFUSAL_SENTENCE)}) AS BIGINT) AS refusals,
       round(count(*) FILTER (WHERE {S.strip_sql('answer')} = {q(C.REFUSAL_SENTENCE)}) / count(*), 6) AS refusal_rate
FROM final""")
def refusal_rate(spark, sf_dir):
    """Share of answers that are the refusal sentence, where a passage must score
    ``SURE_SCORE`` to be an answer."""
    a = _answers(spark, sf_dir, min_score=SURE_SCORE).withColumn("_ref", rag.is_refusal(F.col("answer")))
    return a.agg(F.count(F.lit(1)).cast("bigint").alias("questions"),
                 F.count_if("_ref").cast("bigint").alias("refusals"),
                 F.round(F.count_if("_ref") / F.count(F.lit(1)), 6).alias("refusal_rate"))


@query("parse_model_response", oracle=f"""
WITH blocks AS (
  SELECT conv_id, turn, role, text FROM conversations),
agg AS (
  SELECT conv_id,
         string_agg(text, {NL} ORDER BY turn) FILTER (WHERE role = 'assistant' AND COALESCE(text, '') <> '') AS joined,
         CAST(sum(len({S.tokens_sql('text')})) FILTER (WHERE role <> 'assistant') AS BIGINT) AS in_tok,
         CAST(sum(len({S.tokens_sql('text')})) FILTER (WHERE role = 'assistant') AS BIGINT) AS out_tok
  FROM blocks GROUP BY conv_id)
SELECT conv_id, NULLIF({S.strip_sql('joined')}, '') AS answer,
       CAST(COALESCE(in_tok, 0) AS INTEGER) AS input_tokens,
       CAST(COALESCE(out_tok, 0) AS INTEGER) AS output_tokens,
       CASE WHEN NULLIF({S.strip_sql('joined')}, '') IS NULL THEN 500 ELSE 200 END AS status_code
FROM agg""")
def parse_model_response(spark, sf_dir):
    """Model responses built from conversations (assistant turns = text blocks, other
    turns = non-text blocks) flattened into answer + usage."""
    from docweave.functions import text as T
    from docweave.sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations")
    blocks = c.select("conv_id", "turn", F.struct(
        F.when(F.col("role") == "assistant", F.lit("text")).otherwise(F.lit("tool_result")).alias("type"),
        F.col("text").alias("text")).alias("b"),
        F.when(F.col("role") != "assistant", F.size(T.tokens("text"))).alias("in_t"),
        F.when(F.col("role") == "assistant", F.size(T.tokens("text"))).alias("out_t"))
    resp = blocks.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]).alias("content"),
        F.sum("in_t").alias("input_tokens"), F.sum("out_t").alias("output_tokens"))
    resp = resp.select("conv_id", F.to_json(F.struct(
        "content", F.struct("input_tokens", "output_tokens").alias("usage"))).alias("response_json"))
    parsed = rag.parse_model_response(resp)
    return parsed.select("conv_id", "answer", "input_tokens", "output_tokens", "status_code")
