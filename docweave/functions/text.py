"""Scalar text functions (Column -> Column), all JVM-side built-ins.

Patterns are written so that Java regex (Spark) and RE2 (DuckDB, used as the
oracle) give the same matches: no look-around, no backreferences, explicit classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave import constants as C

# FIXED VALUES: the 29 code points Python treats as whitespace for ``\S+``:
# U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000. Java's ``\S`` is ASCII-only.
#
# Java (Spark) spelling: the Unicode White_Space property plus U+001C-U+001F -- the
# same 29 code points (checked over every code point), and about 7x faster in Java's
# regex engine than listing the code points one by one.
_JAVA_WS = r"\p{IsWhite_Space}\x1C-\x1F"
TOKEN_PATTERN = f"[^{_JAVA_WS}]+"
NON_BLANK_PATTERN = f"[^{_JAVA_WS}]"            # at least one non-whitespace character
STRIP_PATTERN = f"^[{_JAVA_WS}]+|[{_JAVA_WS}]+$"  # Python ``str.strip()``

# RE2 (DuckDB oracle) spelling of the same set, code points listed explicitly.
_RE2_WS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
RE2_TOKEN_PATTERN = f"[^{_RE2_WS}]+"
RE2_NON_BLANK_PATTERN = f"[^{_RE2_WS}]"
RE2_STRIP_PATTERN = f"^[{_RE2_WS}]+|[{_RE2_WS}]+$"


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of ``text`` as ARRAY<STRING> (empty array for blank text)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)


def strip(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of all 29 kinds."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(t, STRIP_PATTERN, "")


def is_blank(text: Column | str) -> Column:
    """true when the text has no non-whitespace character (or is null)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(~t.rlike(NON_BLANK_PATTERN), F.lit(True))


def decode_utf8(content: Column | str) -> Column:
    """Lenient UTF-8 decode of BINARY; invalid sequences become U+FFFD."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def url_decode_key(key: Column | str) -> Column:
    """``+`` -> space and ``%XX`` escapes; a malformed escape keeps the raw key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.try_url_decode(k), k)


def processed_key(source_key: Column | str) -> Column:
    """``processed/<key with / -> _, minus a final .pdf/.txt>/chunks.json``."""
    k = F.col(source_key) if isinstance(source_key, str) else source_key
    safe = F.regexp_replace(F.replace(k, F.lit("/"), F.lit("_")), r"(?i)\.(pdf|txt)$", "")
    return F.concat(F.lit(C.PROCESSED_PREFIX), safe, F.lit(C.PROCESSED_SUFFIX))


def has_allowed_extension(key: Column | str) -> Column:
    """case-insensitive ``.pdf`` / ``.txt`` suffix."""
    k = F.col(key) if isinstance(key, str) else key
    return F.lower(k).rlike(r"\.(pdf|txt)$")


def is_processed_key(key: Column | str) -> Column:
    """key lives under the processed prefix (recursion guard)."""
    k = F.col(key) if isinstance(key, str) else key
    return k.startswith(C.PROCESSED_PREFIX)


def filename_extension(name: Column | str) -> Column:
    """P5 (part): lower-cased trailing ``.ext`` of the basename, '' when absent."""
    base = _basename(name)
    return F.lower(F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1))


def _basename(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    after_slash = F.element_at(F.split(n, "/"), -1)
    return F.element_at(F.split(after_slash, r"\\"), -1)


def sanitize_filename(name: Column | str) -> Column:
    """P5: safe upload file name ``<stem><ext>``.

    Basename over ``/`` and ``\\``; extension ``(\\.[A-Za-z0-9]+)$`` lower-cased; runs of
    characters outside ``[A-Za-z0-9._-]`` in the stem become ``_``; ``.``/``_`` stripped
    from both ends; an empty stem becomes ``document``; stem cut to 80 characters.
    """
    base = _basename(name)
    ext_raw = F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext_raw))
    stem = F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_")
    stem = F.regexp_replace(stem, r"^[._]+|[._]+$", "")
    stem = F.when(stem == "", F.lit("document")).otherwise(stem)
    stem = F.substring(stem, 1, C.FILENAME_STEM_MAX)
    return F.concat(stem, F.lower(ext_raw))


def object_key(safe_name: Column | str, ts: Column | str, row_id: Column | str) -> Column:
    """``uploads/<yyyyMMddTHHmmssZ>-<8 hex>-<safe name>``.

    The 8 hex characters are derived from ``row_id`` (sha2) instead of a random uuid so
    that the key is reproducible.
    """
    s = F.col(safe_name) if isinstance(safe_name, str) else safe_name
    t = F.col(ts) if isinstance(ts, str) else ts
    r = F.col(row_id) if isinstance(row_id, str) else row_id
    stamp = F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(F.lit(C.UPLOAD_PREFIX), stamp, F.lit("-"),
                    F.substring(F.sha2(r.cast("string"), 256), 1, 8), F.lit("-"), s)


def default_content_type(content_type: Column | str, extension: Column | str) -> Column:
    """Given content type when non-blank, else by extension."""
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    ext = F.col(extension) if isinstance(extension, str) else extension
    given = F.nullif(strip(ct), F.lit(""))
    return F.coalesce(given, F.when(ext == ".pdf", F.lit("application/pdf"))
                      .otherwise(F.lit("text/plain")))


def mask_headers(headers: Column | str) -> Column:
    """Values of credential headers (any case) replaced by ``***``."""
    h = F.col(headers) if isinstance(headers, str) else headers
    masked = [F.lit(x) for x in C.MASKED_HEADERS]
    return F.transform_values(
        h, lambda k, v: F.when(F.lower(k).isin(*masked), F.lit(C.MASK_VALUE)).otherwise(v))


def first_non_empty(*cols: Column | str) -> Column:
    """Python ``a or b or c`` for strings: empty string counts as missing."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def document_key(source: Column | str, doc_id: Column | str) -> Column:
    """Object key of a supplied document row: ``uploads/<source>/<doc_id>.txt``."""
    s = F.col(source) if isinstance(source, str) else source
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.concat(F.lit(C.UPLOAD_PREFIX), s, F.lit("/"), d.cast("string"), F.lit(".txt"))
