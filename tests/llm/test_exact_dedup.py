import hashlib
import random

from docweave.llm.exact_dedup import drop_duplicates, exact_dedup, heavy_winners
from pyspark.sql import functions as F


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def brute(rows):
    best, size = {}, {}
    for i, t in rows:
        k = norm(t)
        best[k], size[k] = max(best.get(k, -1), i), size.get(k, 0) + 1
    return sorted((i, best[norm(t)], size[norm(t)], i == best[norm(t)],
                   hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def got(df):
    return sorted(tuple(r) for r in df.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_against_brute_force_with_a_hot_group(make_docs):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "Aé", "aÉ", "aé", "x y", "X Y", f"only {i}"]
                           + ["Hot Text"] * 6)) for i in range(400)]
    for support in (0.001, 0.05, 0.5):
        assert got(exact_dedup(make_docs(rows), support=support)) == brute(rows)


def test_heavy_hitters_are_complete_and_bounded(spark):
    keyed = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"s{i}", i)
                                   for i in range(3000)], "id long, sha string, row long")
    rows = heavy_winners(keyed, 0.01).collect()
    assert len(rows) <= 100 and {r.sha: r.n for r in rows}["hot"] == 1000


def test_null_ids_repeated_rows_empty_table_and_clashing_columns(spark, make_docs):
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (2, "c")]
    docs = make_docs(rows).withColumn("sha", F.lit("z")).withColumn("row", F.lit(1))
    out = exact_dedup(docs).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == [("a", None), ("b", 1), ("c", 2)]
    empty = make_docs([])
    assert exact_dedup(empty).count() == 0 and drop_duplicates(empty).count() == 0
