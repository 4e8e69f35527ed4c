import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from docweave.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows, labels, kind = [], [], {}
    for i in range(n):
        k = rng.choices(mixing.DOMAINS, [0.7, 0.15, 0.15])[0]
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(60, 120))]
        if k == "toxic":
            words[5:7] = ["idiot.", "Scum"]
        if k == "low":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        kind[i] = k
        if i % 2:
            labels.append((i, 0 if k == "low" else 1, int(k == "toxic")))
    return rows, labels, kind


def brute_rates(rows, names, want, cap):
    """Plain projected descent with a tiny step on the same objective."""
    base = [sum(r["n_tokens"] * r[n] for r in rows) for n in names]
    rates = [1.0] * len(rows)
    for _ in range(3000):
        s = [sum(x * r["n_tokens"] * r[n] for x, r in zip(rates, rows)) for n in names]
        g = [(a - t) / max(b, 1.0) for a, t, b in zip(s, want, base)]
        rates = [min(cap, max(0.0, x - 0.3 * sum(r[n] * y for n, y in zip(names, g))))
                 for x, r in zip(rates, rows)]
    return [sum(x * r["n_tokens"] * r[n] for x, r in zip(rates, rows)) for n in names]


def test_posteriors_and_targets(spark, make_docs):
    rows, labels, kind = corpus()
    docs = make_docs(rows).withColumn("id", F.lit(0)).withColumn("domain", F.lit("x"))
    out = mixing.mix(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    names = [f"p_{d}" for d in mixing.DOMAINS]
    right = sum(max(names, key=lambda n: r[n]) == f"p_{kind[r.doc_id]}" for r in out if r.doc_id % 2 == 0)
    assert right >= 0.97 * len(rows) / 2
    total = sum(r.n_tokens for r in out)
    for d, w in mixing.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) == pytest.approx(w * total, abs=1e-3 * total)
    assert all(r.rate >= 0 and abs(sum(r[n] for n in names) - 1) < 1e-9 for r in out)
    drawn = sum(r.copies * r.n_tokens for r in out)
    assert drawn == pytest.approx(total, rel=0.05)


def test_rates_equal_slow_descent_when_targets_are_out_of_reach(spark):
    rng = random.Random(8)
    data = []
    for i in range(60):
        p = rng.random() * 0.5
        data.append((i, rng.randint(0, 50), 1 - p, p))
    df = spark.createDataFrame(data, "id long, n_tokens long, p_a double, p_b double")
    for targets, cap in (({"a": 0.2, "b": 0.8}, None), ({"a": 0.9, "b": 0.1}, 1.0)):
        out = mixing.fit_rates(df, targets, max_rate=cap, rounds=200, tolerance=1e-9).collect()
        total = sum(r.n_tokens for r in out)
        got = [sum(r.rate * r.n_tokens * r[n] for r in out) for n in ("p_a", "p_b")]
        want = brute_rates(out, ("p_a", "p_b"), [total * w for w in targets.values()], cap or 1e9)
        assert got == pytest.approx(want, abs=0.02 * total)
        assert all(0 <= r.rate <= (cap or 1e9) for r in out)


def test_stage_keeps_clean_documents(spark, make_docs):
    rows, labels, kind = corpus()
    docs = make_docs(rows + [(None, "abc")])
    kept = mixing.mixed(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    clean = {i for i, k in kind.items() if k == "clean"}
    assert len(clean & set(ids)) >= 0.97 * len(clean)
    low = {i for i, k in kind.items() if k == "low"}
    assert len(low & set(ids)) < 0.6 * len(low)


def test_edge_cases(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "w " * 50000)]
    out = mixing.mix(make_docs(rows), none).collect()
    assert len(out) == len(rows)
    assert all(r.p_clean == pytest.approx(1 / 3) for r in out)
    odd = spark.createDataFrame([(1, None, None), (3, None, 1), (3, None, 1), (None, 0, 0)], LABELS)
    assert mixing.mix(make_docs(rows), odd).count() == len(rows)
    assert mixing.mix(make_docs([]), none).count() == 0
    assert mixing.mixed(make_docs([]), none).count() == 0


def soft(spark, n=4000, shares=(0.76, 0.13, 0.11), seed=5):
    """Well separated but soft posteriors, no document near certain."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        k = rng.choices(range(3), shares)[0]
        e = [math.exp(rng.gauss(0, 1.5) + 4.0 * (j == k)) for j in range(3)]
        data.append((i, rng.randint(20, 400), *[x / sum(e) for x in e]))
    return spark.createDataFrame(data, "id long, n_tokens long, p_clean double, p_low double, p_toxic double")


def test_soft_posteriors_meet_the_targets_without_a_round_count(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", mixing.MissedTargets)
        out = mixing.fit_rates(soft(spark), mixing.TARGETS).collect()
    total = sum(r.n_tokens for r in out)
    for d, w in mixing.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) == pytest.approx(w * total, abs=1.1e-4 * total)
    assert all(r.rate >= 0 for r in out)


def test_rows_without_ids_draw_their_copies_one_by_one(spark, make_docs):
    rows, labels, _ = corpus(300)
    docs = make_docs([(None, t) for _, t in rows] + [(7, t) for _, t in rows])
    out = mixing.mix(docs, spark.createDataFrame(labels, LABELS))
    assert out.count() == 600 and out.where("doc_id is null").count() == 300
    rates = spark.createDataFrame([(None, f"t{i}") for i in range(400)], "doc_id long, text string").select(
        F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("id"), F.lit(0.5).alias("rate"))
    taken = rates.select(mixing.copies_of("id", "rate").alias("c")).agg(F.sum("c")).first()[0]
    assert 140 < taken < 260


def test_missed_targets_and_unfinished_fits_are_reported(spark):
    df = soft(spark, 500)
    with pytest.warns(mixing.MissedTargets, match="clean"):
        mixing.fit_rates(df, mixing.TARGETS, max_rate=1.0)
    with pytest.raises(RuntimeError, match="not fitted"):
        mixing.fit_rates(df, mixing.TARGETS, rounds=2)


@pytest.mark.parametrize("shares", [(0.99, 0.005, 0.005), (0.97, 0.0, 0.03)])
def test_stage_keeps_all_of_a_clean_input(spark, make_docs, shares):
    rng = random.Random(9)
    rows, labels, kind = corpus(6000, 9)
    few = {k: [i for i, x in kind.items() if x == k] for k in mixing.DOMAINS}
    ids = {i for k, x in zip(mixing.DOMAINS, shares) for i in rng.sample(few[k], int(4000 * x))}
    rows, labels = [r for r in rows if r[0] in ids], [r for r in labels if r[0] in ids]
    kind = {i: k for i, k in kind.items() if i in ids}
    kept = {r.doc_id for r in mixing.mixed(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    clean = {i for i, k in kind.items() if k == "clean"}
    assert len(clean) > 0.96 * len(rows) and clean <= kept
    toxic = {i for i, k in kind.items() if k == "toxic"}
    if shares[2] > 0.01:                  # the others still go
        assert 0 < len(toxic & kept) < 0.6 * len(toxic)
    else:
        assert len(kept) == len(rows)


def test_soft_clean_input_keeps_its_rates(spark):
    df = soft(spark, 4000, (1.0, 0.0, 0.0)).withColumns({
        "p_low": F.col("p_low") * 0.02, "p_toxic": F.col("p_toxic") * 0.02}).withColumn(
        "p_clean", 1 - F.col("p_low") - F.col("p_toxic"))
    thinned = mixing.fit_rates(df, mixing.TARGETS, max_rate=1.0).agg(F.avg("rate")).first()[0]
    whole = mixing.fit_rates(df, mixing.TARGETS, max_rate=1.0, whole="clean").agg(F.min("rate")).first()[0]
    assert thinned < 0.99 and whole == 1.0
