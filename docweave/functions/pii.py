"""Pattern-based PII detection and redaction expressions.

FIXED VALUES: the four patterns below and their application order (card, SSN, phone,
e-mail). They avoid ``\\b`` and look-around so that Java regex and RE2 agree, and their
separators include line breaks so entities wrapped across lines are still found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave import constants as C

_SP = r"([ \t\r\n]+|[.-])"      # separator: whitespace run, dot or dash
_SO = r"([ \t\r\n]+|-)?"        # optional separator inside a card number
_WS = r"([ \t\r\n]+)?"          # optional whitespace around SSN dashes

# FIXED VALUES (label, pattern) in application order.
PII_PATTERNS: list[tuple[str, str]] = [
    ("CREDIT_CARD", rf"[0-9]{{4}}{_SO}[0-9]{{4}}{_SO}[0-9]{{4}}{_SO}[0-9]{{4}}"),
    ("SSN", rf"[0-9]{{3}}{_WS}-{_WS}[0-9]{{2}}{_WS}-{_WS}[0-9]{{4}}"),
    ("PHONE", rf"(\+?1{_SP}?)?(\([0-9]{{3}}\){_WS}|[0-9]{{3}}{_SP})[0-9]{{3}}{_SP}[0-9]{{4}}"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
]
PII_LABELS = [label for label, _ in PII_PATTERNS]

# Necessary conditions checked once per text before the patterns run: every digit pattern
# ends in four consecutive digits, every e-mail contains '@'. Replacement markers contain
# neither, so the test on the original text holds for every later step.
DIGIT_LABELS = ("CREDIT_CARD", "SSN", "PHONE")
DIGIT_GUARD = r"[0-9]{4}"
# What the patterns' matches consist of: a digit pattern's of these characters alone, an e-mail's
# before its only '@' of those.
DIGIT_CHARS = "0123456789 \t\r\n.()+-"
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def guard(label: str, text: Column) -> Column:
    """Cheap test that is true whenever ``label``'s pattern can match ``text``."""
    if label in DIGIT_LABELS:
        return text.rlike(DIGIT_GUARD)
    return F.instr(text, "@") > 0


def marker(label: str) -> str:
    return f"{C.REDACTION_MARKER_PREFIX}{label}{C.REDACTION_MARKER_SUFFIX}"


def count_column(label: str) -> str:
    return f"n_{label.lower()}"


def residual_count(text: Column, label: str) -> Column:
    """Matches of one label's pattern left in already-redacted text."""
    pattern = dict(PII_PATTERNS)[label]
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")
