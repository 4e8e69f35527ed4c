"""S1 object scan and P2 page assembly.

Objects are read with the ``binaryFile`` source: the glob filter is applied while
listing, so unsupported files are never opened (the suffix filter of the event rule,
pushed into the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import constants as C
from docweave.functions import text as T

# The four spellings the upload trigger accepts.
OBJECT_GLOB = "*.{pdf,txt,PDF,TXT}"


def scan_objects(spark: SparkSession, root: str, glob: str | None = OBJECT_GLOB,
                 bucket: str = C.DEFAULT_BUCKET) -> DataFrame:
    """Every matching object under ``root`` (recursively) with its key relative to root:
    ``bucket, source_key, modificationTime, length, content``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^file:", "")
    key = F.when(rel.startswith(prefix), F.substring(rel, len(prefix) + 1, 1 << 30)).otherwise(rel)
    return df.select(F.lit(bucket).alias("bucket"), key.alias("source_key"),
                     "modificationTime", "length", "content")


def decode_objects(objects: DataFrame) -> DataFrame:
    """Text of ``.txt`` objects (lenient UTF-8); other formats keep a NULL text and an
    ``extract_error`` so routing can send them to dead letters."""
    is_txt = F.lower(F.col("source_key")).endswith(".txt")
    return objects.select(
        "*",
        F.when(is_txt, T.decode_utf8("content")).alias("text"),
        F.when(~is_txt, F.lit("PDF text extraction is done upstream; supply its pages"))
         .alias("extract_error")).drop("content")


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text", failed_col: str | None = None) -> DataFrame:
    """Document text = page texts joined by newline in page order.

    A page that failed extraction (``failed_col`` true) is left out; a page without text
    contributes an empty line. The per-document group is a document's own pages.
    """
    p = pages
    if failed_col:
        p = p.where(~F.coalesce(F.col(failed_col), F.lit(False)))
    per_doc = p.groupBy(doc_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("p"),
                                             F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
         .alias("_pages"))
    return per_doc.select(doc_col, F.array_join(F.transform("_pages", lambda x: x["t"]), "\n")
                          .alias("text"), F.size("_pages").alias("page_count"))
