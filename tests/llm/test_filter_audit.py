import random
import re
from itertools import permutations

from docweave.llm import filter_audit as fa
from pyspark.sql import functions as F


def failures(rows):
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w),
                    100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)),
                    i is not None and any(j is not None and j < i and (u or "") == t
                                          for j, u, _ in rows)))
    return out


def brute(rows, labels):
    fails = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shap = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                shap[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[k] for _, f in mine) - len(gone),
                    sum(f[k] and sum(f) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shap[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, make_docs, rows, labels, **how):
    docs = make_docs([(i, t, "en", p) for i, t, p in rows])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = fa.filter_audit(docs, table, **how).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        t = " ".join(rng.choice(["w", "Word", f"x{rng.randint(0, 90)}", "LOUD", "a#", "é\x85z"][:rng.randint(1, 6)])
                     for _ in range(rng.randint(0, 90)))
        rows.append((rng.choice([i, i, i, None]), rng.choice([t, t, t, None, "", "copy of a text"]),
                     rng.choice(["s1", "s1", "s1", "s2", "", None])))
    rows += [rows[7], rows[7], (3, "other text of a repeated id", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)]
    return rows, labels + labels[:5] + [(2, 1, 1), (None, 1, 1)]


def test_against_brute_force(spark, make_docs):
    rows, labels = corpus()
    assert run(spark, make_docs, rows, labels) == brute(rows, labels)


def test_no_text_broadcast_and_no_labels(spark, make_docs):
    rows, _ = corpus(2)
    assert run(spark, make_docs, rows, [], heavy_keys=1) == brute(rows, [])


def test_potential_is_shared_out_whole(spark):
    v = [0] + [random.Random(k).randint(0, 10**12) for k in range(1, 32)]
    p = spark.range(1).select(fa.potentials(F.array(*map(F.lit, v))).alias("p")).first().p
    assert sum(p[31] - p[31 - (1 << i)] for i in range(5)) == 120 * v[31]


def test_very_long_text_and_thresholds(spark, make_docs):
    edge = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "lang " * 200_000, "s"), (2, edge, "s"), (3, edge[4:], "s"),
            (4, " ".join(["q"] * 18 + [f"w{i}" for i in range(33)]), "s")]
    assert run(spark, make_docs, rows, [(1, 1, 0)]) == brute(rows, [(1, 1, 0)])


def test_empty_table_and_clashing_columns(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(make_docs([]), labels).count() == 0
    docs = make_docs([(1, "a b")]).withColumn("mask", F.lit("q")).withColumn("Good", F.lit(1))
    found = fa.filter_audit(docs, labels.withColumn("source", F.lit("z")))
    assert found.count() == 600 and found.where("good_lost = 1 and part = 'src0'").count() == 120
