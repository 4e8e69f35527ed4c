import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents with the table's columns from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows, schema=SCHEMA):
        full = []
        for r in rows:
            r = tuple(r) + ("en", "src0")[len(r) - 2:]
            full.append(r[:4] + (None if r[1] is None else len(r[1]),))
        return spark.createDataFrame(full, schema)
    return make
