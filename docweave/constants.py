"""Fixed values that results depend on.

FIXED VALUES -- these must stay exactly as written for results to match the
behaviour being reproduced (defaults, labels, prompt text, prices, limits).
"""

# --- chunking defaults (tokens = whitespace-separated words) ---
CHUNK_SIZE_TOKENS = 500
CHUNK_OVERLAP_TOKENS = 50

# --- key layout ---
PROCESSED_PREFIX = "processed/"
PROCESSED_SUFFIX = "/chunks.json"
UPLOAD_PREFIX = "uploads/"
DEFAULT_BUCKET = "corpus"

# --- PII types accepted from a detector, and the label each is written as ---
PII_TYPE_LABELS = {
    "SSN": "SSN",
    "EMAIL": "EMAIL",
    "NAME": "NAME",
    "PHONE": "PHONE",
    "CREDIT_DEBIT_NUMBER": "CREDIT_CARD",
}
REDACTION_MARKER_PREFIX = "[REDACTED_"
REDACTION_MARKER_SUFFIX = "]"

# --- byte budget per call for size-limited external detectors ---
DETECTOR_MAX_BYTES = 90_000

# --- retrieval / generation ---
TOP_K = 3
EMBED_DIMENSIONS = 1024
MAX_TOKENS = 1024
TEMPERATURE = 0.2
EMBED_MODEL_ID = "hash-embed-v1"
GEN_MODEL_ID = "extractive-v1"
SYSTEM_PROMPT_PREFIX = (
    "You are a secure corporate assistant. Answer the question ONLY based on the "
    "context provided below. If the answer cannot be found, reply "
    "'I do not have access to that information.'\n"
    "CONTEXT:\n"
)
REFUSAL_SENTENCE = "I do not have access to that information."
NO_CONTEXT_TEXT = "(no relevant context retrieved)"
UNKNOWN_SOURCE = "unknown"
MASKED_HEADERS = ("x-api-key", "authorization")
MASK_VALUE = "***"

# --- benchmark question list used round-robin by the workload generator ---
DEFAULT_QUESTIONS = [
    "Who should I contact about the Enterprise RAG policy?",
    "What email is listed for the Enterprise RAG policy?",
    "What phone number appears in the policy document?",
    "What guidance exists about storing SSN values?",
    "Summarize the Enterprise RAG policy contact details.",
    "Is there any credit card information in the documents?",
    "What PII types were redacted from the source material?",
    "What is the CEO salary for Acme Corp in 2019?",
    "List security guidelines mentioned in the uploaded policy.",
    "Where can I find the original unredacted contact details?",
]

# --- price table, USD per 1K tokens (model label, input, output) ---
PRICE_TABLE = [
    ("Claude Haiku 3 (reference)", 0.00025, 0.00125),
    ("Claude Haiku 4.5 (deployed family)", 0.001, 0.005),
    ("Claude 3 Sonnet (alternative)", 0.003, 0.015),
]

# --- latency targets in ms (percentile label, target) ---
SLO_TARGETS_MS = [("p50", 2000.0), ("p90", 3000.0), ("p99", 4000.0)]
TIME_TO_SEARCHABLE_TARGET_S = 60.0

# --- gateway limits ---
RATE_LIMIT_PER_S = 50
BURST_LIMIT = 100
DAILY_QUOTA = 5000

# --- dead letters ---
DLQ_RETENTION_DAYS = 14
MAX_ATTEMPTS = 3

# --- report shaping ---
ANSWER_PREVIEW_CHARS = 120
ERROR_DETAIL_CHARS = 200
FAILURE_SAMPLE_ROWS = 5
FAILURE_SAMPLE_CHARS = 160
FILENAME_STEM_MAX = 80
LATENCY_STAGES = ["embedding", "retrieval", "llm", "total"]

# Reasons why an index row is refused.
MISSING_VECTOR = "missing vector"
WRONG_WIDTH = "unexpected vector width "

# Error texts of the question API.
QUERY_FAILED = "RAG query failed"
MISSING_QUESTION = "Missing required field: question"
EMPTY_ANSWER = "Model returned no text"
