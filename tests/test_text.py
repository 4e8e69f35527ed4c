"""Scalar text functions: keys, file names, decoding, header masking."""

from pyspark.sql import functions as F

from docweave.functions import text as T


def one(spark, col_expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("o")).first().o


def test_processed_key_reference_case(spark):
    assert one(spark, T.processed_key("v"), "uploads/hr/policy.pdf") == "processed/uploads_hr_policy/chunks.json"
    assert one(spark, T.processed_key("v"), "a/b.TXT") == "processed/a_b/chunks.json"
    assert one(spark, T.processed_key("v"), "a/b.md") == "processed/a_b.md/chunks.json"


def test_sanitize_filename_cases(spark):
    want = {"a/b\\My Report (1).PDF": "My_Report_1.pdf", "..": "document", "noext": "noext",
            "x.tar.gz": "x.tar.gz", "_.__.txt": "document.txt", "résumé été.txt": "r_sum_t.txt",
            "y" * 100 + ".txt": "y" * 80 + ".txt", "": "document", "dir/": "document"}
    df = spark.createDataFrame([(c,) for c in want], "v string")
    got = {r.v: r.o for r in df.select("v", T.sanitize_filename("v").alias("o")).collect()}
    assert got == want


def test_url_decode_plus_and_escapes(spark):
    assert one(spark, T.url_decode_key("v"), "a+b%20c.txt") == "a b c.txt"
    assert one(spark, T.url_decode_key("v"), "bad%zzescape.txt") == "bad%zzescape.txt"


def test_lenient_utf8_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xe4\xb8"),), (bytearray(b"\xef\xbb\xbfhi"),)], "v binary")
    got = [r.o for r in df.select(T.decode_utf8("v").alias("o")).collect()]
    assert got == [b"a\xffb\xe4\xb8".decode("utf-8", errors="replace"),
                   b"\xef\xbb\xbfhi".decode("utf-8", errors="replace")]


def test_mask_headers_any_case(spark):
    df = spark.createDataFrame([({"X-Api-Key": "k", "AUTHORIZATION": "t", "Accept": "x"},)],
                               "h map<string,string>")
    got = df.select(T.mask_headers("h").alias("o")).first().o
    assert got == {"X-Api-Key": "***", "AUTHORIZATION": "***", "Accept": "x"}


def test_strip_and_blank_follow_python(spark):
    s = "　\x1c hello \x85\n"
    assert one(spark, T.strip("v"), s) == s.strip()
    assert one(spark, T.is_blank("v"), " \x1f ") is True
    assert one(spark, T.is_blank("v"), " x ") is False


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", "c")], "a string, b string, c string")
    got = [r.o for r in df.select(T.first_non_empty("a", "b", "c").alias("o")).collect()]
    assert got == ["c", "a", "c"]
