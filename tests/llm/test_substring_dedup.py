import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import substring_dedup as sd


def brute(rows):
    """Character offsets removed per (id, text), by looking at every span of the corpus."""
    places = {}
    for i, t in set(rows):
        for a, b, h in zip(*sd.spans(t)) if t else ():
            key = tuple(" ".join(x.split()) for x in sd.sentences(t[a:b]))
            places.setdefault(key, []).append(((i, t), a, b))
    out = {}
    for at in places.values():
        first = min((i, a) for (i, _), a, _ in at)
        for (i, t), a, b in at:
            if (i, a) != first:
                out.setdefault((i, t), set()).update(range(a, b))
    return out


def make(n=60, seed=4):
    rng = random.Random(seed)

    def sent():
        return " ".join("".join(rng.choices("abcdef", k=3)) for _ in range(rng.randint(2, 14))).capitalize() + "."

    passages = [" ".join(sent() for _ in range(rng.randint(5, 9))) for _ in range(4)]
    passages.append(" ".join(["word%d" % i for i in range(70)]) + ".")
    rows = []
    for i in range(n):
        lines = [" ".join(sent() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), rng.choice(passages))
        rows.append((i, "\n".join(lines)))
    return rows, passages


def test_spans_and_sentences():
    for t in ("", " ", "a", "A b. C d! E?\n\n f\n", "\n\nx.  y.", "a.b c.d"):
        assert "".join(sd.sentences(t)) == t
    start, end, _ = sd.spans("One two. Three four. Five six. Seven eight.", 3, 5, 99)
    assert list(zip(start, end)) == [(0, 31), (9, 43)]
    start, end, _ = sd.spans("A! B! C! D! E! F!", 3, 5, 99)          # short ones run on
    assert list(zip(start, end)) == [(0, 15), (3, 17)]
    start, end, _ = sd.spans("w " * 60, 3, 12, 50)
    assert list(zip(start, end)) == [(0, 120)]


@pytest.mark.parametrize("hot_share", [0.001, 0.02, 1.0])
def test_against_brute_force(make_docs, monkeypatch, hot_share):
    monkeypatch.setattr(sd, "HOT_SHARE", hot_share)
    rows, passages = make()
    want = brute(rows)
    docs = make_docs(rows).withColumn("hash", F.lit(1)).withColumn("t", F.lit("x"))
    found = sd.removed_spans(docs)
    out = {r.doc_id: r for r in found.collect()}
    left = sd.apply_removals(docs, found)
    assert left.columns == docs.columns
    left = {r.doc_id: r.text for r in left.collect()}
    assert len(out) == len(left) == len(rows) and want
    for i, t in rows:
        gone = want.get((i, t), set())
        assert out[i].n_removed == len(gone)
        assert [c for s in out[i].removed for c in range(s.start, s.end)] == sorted(gone)
        assert left[i] == "".join(c for k, c in enumerate(t) if k not in gone)
    for p in passages:                       # a passage stays where it comes first only
        assert sum(p in t for t in left.values()) == 1


def test_edge_cases(make_docs):
    same = "Aa bb cc dd ee. Ff gg hh ii jj. Kk ll mm nn oo."
    rows = [(1, None), (2, ""), (3, " \n"), (4, same), (4, same), (5, same), (None, same),
            (6, "x. " * 20000)]
    docs = make_docs(rows)
    found = sd.removed_spans(docs)
    out = found.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0 and by[4][0].n_removed == by[5][0].n_removed == len(same)
    assert by[4][0] == by[4][1] and by[1][0].removed == by[2][0].removed == []
    left = sd.apply_removals(docs, found).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left if r.doc_id != 6) == sorted(
        str(x) for x in [(1, None), (2, ""), (3, " \n"), (4, ""), (4, ""), (5, ""), (None, same)])
    assert sd.removed_spans(make_docs([])).count() == 0


def test_passages_planted_by_words_lose_their_whole_sentences(make_docs):
    rng = random.Random(11)

    def word():
        return "".join(rng.choices("abcdefghij", k=5))

    def sent(n):
        return " ".join(word() for _ in range(n)).capitalize() + "."

    rows, inner = [], []
    for k in range(12):              # cut inside sentences: only two of the four are whole
        ends = [sent(20), sent(20)]
        inner.append(" ".join(sent(rng.randint(6, 20)) for _ in range(2)))
        words = " ".join([ends[0], inner[-1], ends[1]]).split()
        passage = " ".join(words[9:len(words) - 9])
        for i in (2 * k, 2 * k + 1):
            before, after = " ".join([sent(8), word(), word()]), " ".join([word(), word(), sent(8)])
            rows.append((i, f"{before} {passage} {after}"))
    docs = make_docs(rows)
    left = {r.doc_id: r.text for r in sd.apply_removals(docs, sd.removed_spans(docs)).collect()}
    texts = dict(rows)
    for k, p in enumerate(inner):
        assert left[2 * k] == texts[2 * k] and p in left[2 * k]
        assert left[2 * k + 1] == texts[2 * k + 1].replace(p + " ", "")


def test_passages_that_begin_and_end_inside_sentences(make_docs):
    """Against passages planted word by word, not against the operator's own spans."""
    rng = random.Random(21)

    def prose(n):
        return [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" + (rng.choice([",", ".", ";"]) if rng.random() < 0.15 else "")
                for _ in range(n)]
    passages = [prose(80) for _ in range(12)]
    rows, planted = [], {}
    for i in range(120):
        w, at = prose(150), rng.randint(0, 150)
        if i % 4 == 0:
            p = rng.randrange(12)
            w[at:at] = passages[p]
            planted[i] = (p, at)
        rows.append((i, " ".join(w)))
    first, gone, total = set(), 0, 0
    found = {r.doc_id: r.removed for r in sd.removed_spans(make_docs(rows), min_words=25).collect()}
    text = dict(rows)
    for i in range(120):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[i])]
        taken = [k for k, (a, b) in enumerate(words) if any(s.start <= a and b <= s.end for s in found[i])]
        if i not in planted or planted[i][0] not in first:
            assert not taken                                   # clean documents and first copies
            first |= {planted[i][0]} if i in planted else set()
            continue
        at = planted[i][1]
        assert set(taken) <= set(range(at, at + 80))
        gone, total = gone + len(taken), total + 80
    assert total and gone / total > 0.8
