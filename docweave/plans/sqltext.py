"""Shared SQL fragments for DuckDB oracle queries (same patterns as the Spark side)."""

from __future__ import annotations

from docweave import constants as C
from docweave.functions import pii as P
from docweave.functions import text as T
from docweave.sources.tables import SOURCE_DOCUMENTS_SQL

TOKEN_RE = T.RE2_TOKEN_PATTERN
SIZE = C.CHUNK_SIZE_TOKENS
STEP = C.CHUNK_SIZE_TOKENS - C.CHUNK_OVERLAP_TOKENS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_sql(expr: str) -> str:
    """Python ``str.strip()`` in DuckDB."""
    return f"regexp_replace({expr}, {q(T.RE2_STRIP_PATTERN)}, '', 'g')"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(TOKEN_RE)})"


def redaction_ctes(src: str = "src_docs", text_col: str = "text") -> str:
    """CTE chain r0..r4 applying the four patterns in order, counting before each step.

    Expects a relation ``src`` with ``text_col``; r4 carries all columns plus
    n_credit_card, n_ssn, n_phone, n_email and redacted_text.
    """
    parts = [f"r0 AS (SELECT *, {text_col} AS _t0 FROM {src})"]
    for i, (label, pattern) in enumerate(P.PII_PATTERNS, start=1):
        cnt = P.count_column(label)
        parts.append(
            f"r{i} AS (SELECT *, CAST(len(regexp_extract_all(_t{i-1}, {q(pattern)})) AS BIGINT) AS {cnt}, "
            f"regexp_replace(_t{i-1}, {q(pattern)}, {q(P.marker(label))}, 'g') AS _t{i} FROM r{i-1})")
    parts.append("redacted AS (SELECT * EXCLUDE (_t0, _t1, _t2, _t3), _t4 AS redacted_text, "
                 "(n_credit_card + n_ssn + n_phone + n_email) > 0 AS pii_masked_flag FROM r4)")
    return ",\n".join(parts)


def chunk_ctes(src: str, text_col: str, keep: str) -> str:
    """CTEs tok -> chunks over relation ``src``; ``keep`` is a comma list of carried columns."""
    return f"""
tok AS (SELECT {keep}, regexp_extract_all({text_col}, {q(TOKEN_RE)}) AS _tokens FROM {src}),
tokn AS (SELECT *, len(_tokens) AS _n FROM tok WHERE len(_tokens) > 0),
idx AS (SELECT *, unnest(generate_series(0, CASE WHEN _n <= {SIZE} THEN 0
          ELSE CAST(ceil((_n - {SIZE}) / {STEP}.0) AS BIGINT) END)) AS chunk_id FROM tokn),
chunks AS (SELECT {keep}, CAST(chunk_id AS INTEGER) AS chunk_id,
          CAST(least(chunk_id * {STEP} + {SIZE}, _n) - chunk_id * {STEP} AS INTEGER) AS token_count,
          CAST(chunk_id * {STEP} AS INTEGER) AS start_token,
          CAST(least(chunk_id * {STEP} + {SIZE}, _n) AS INTEGER) AS end_token,
          array_to_string(list_slice(_tokens, chunk_id * {STEP} + 1, chunk_id * {STEP} + {SIZE}), ' ') AS text_chunk
        FROM idx)"""


SRC_DOCS_CTE = f"src_docs AS ({SOURCE_DOCUMENTS_SQL})"
