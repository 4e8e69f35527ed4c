import random
import re

from pyspark.sql import functions as F

from docweave.llm import license_scan as ls


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t):
    w = words(t)
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(rows, templates):
    """Best share of a template's shingles over runs of as many shingles as it has."""
    out = {}
    for i, t in rows:
        s = shingles(t)
        for name, text in templates:
            want = set(shingles(text))
            n = len(shingles(text))
            for at in range(max(1, len(s) - n + 1)):
                share = len(want & set(s[at:at + n])) / len(want)
                if share >= 0.8:
                    out[i, name] = max(share, out.get((i, name), 0))
    return out


LONG = " ".join(f"clause{i}" for i in range(60))


def corpus(templates):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["licensed", "under", "the", "license"]
    rows = [(0, None), (1, ""), (2, "mit"), (3, "Released under the MIT License"), (4, LONG)]
    for i in range(10, 160):
        t = rng.choices(vocabulary, k=rng.randint(1, 150))
        if i % 2:
            lic = rng.choice(templates)[1].split()
            if rng.random() < 0.3 and len(lic) > 20:        # one changed word
                lic[-1 if rng.random() < 0.5 else 0] = "changed"
            t[(at := rng.randint(0, len(t))):at] = lic
        rows.append((i, ("\n" if i % 3 else " ").join(t)))
    return rows


def test_matches_equal_brute_force(spark, make_docs):
    templates = [*ls.TEMPLATES, ("LONG", LONG)]
    rows = corpus(templates)
    table = spark.createDataFrame([*templates, ("none", None), ("empty", " ")], "license string, text string")
    docs = make_docs(rows).withColumn("row", F.lit(1)).withColumn("h", F.lit(2))
    out = ls.license_scan(docs, table).collect()
    got = {(r.doc_id, r.license): r.containment for r in out}
    want = brute(rows, templates)
    assert len(out) == len(got) and len(want) > 60
    assert set(got) >= set(want)                 # a wider window may hold a little more
    assert all(got[k] >= want[k] - 1e-9 for k in want)
    text = dict(rows)
    for (i, name), share in got.items():
        whole = set(shingles(dict(templates)[name]))
        assert share <= len(whole & set(shingles(text[i]))) / len(whole) + 1e-9


def test_band_settings_rarely_miss():
    """The documented bound, for one-permutation bands over the default template sizes."""
    rng = random.Random(3)
    for n, size in ((1, 1), (3, 8), (4, 8), (8, 8), (14, 64), (56, 64)):
        assert ls.size_class(n) == size
        missed = 0
        for _ in range(1500):
            want = [rng.getrandbits(64) for _ in range(n)]
            width = size + size // 2
            inside = rng.sample(want, -(-8 * n // 10)) + [rng.getrandbits(64) for _ in range(width - n)]

            def least(hashes):
                out = {}
                for h in hashes:
                    out[h >> 58] = min(h, out.get(h >> 58, h))
                return set(out.values())

            missed += not least(want) & least(inside)
        assert missed <= 1500 * (0.001 if n in (1, 8, 56) else 0.012), (n, missed)


def test_edge_cases(spark, make_docs):
    none = spark.createDataFrame([], "license string, text string")
    rows = [(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (None, None)]
    assert ls.license_scan(make_docs(rows), none).count() == 0
    out = ls.license_scan(make_docs(rows), ls.default_templates(spark)).collect()
    assert [(r.doc_id, r.license) for r in out] == [(1, "CC-BY-NC-4.0")] * 2
    big = [(5, "filler text " * 20000 + "Released under the MIT License.")]
    assert ls.license_scan(make_docs(big), ls.default_templates(spark)).first().license == "MIT"
    assert ls.license_scan(make_docs([]), ls.default_templates(spark)).count() == 0


def test_licence_texts_and_headers_are_found_whole_and_edited(spark, make_docs):
    from docweave.llm.license_texts import LICENSES
    rng = random.Random(11)
    rows, want = [], {}
    for i, (name, text) in enumerate(LICENSES):
        w = text.split()
        w[rng.randrange(len(w))] = "changed"                # five shingles of a template at the most
        around = [f"x{rng.randint(0, 999)}" for _ in range(rng.randint(0, 900))]
        at = rng.randint(0, len(around))
        rows += [(2 * i, text.lower().replace("\n", " ")), (2 * i + 1, "\n".join(around[:at] + w + around[at:]))]
        want |= {2 * i: name, 2 * i + 1: name}
    rows.append((999, " ".join(f"y{k}" for k in range(5000))))
    out = ls.license_scan(make_docs(rows), ls.default_templates(spark)).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.license)
    whole = set(brute([r for r in rows if r[0] != 999], [(n, t) for n, t in (*ls.TEMPLATES, *LICENSES)]))
    assert {(i, n) for i, n in want.items()} <= whole
    assert {(i, n) for i in got for n in got[i]} >= whole
    assert 999 not in got
