import hashlib
import heapq
import random
import re
import zlib

from docweave.llm import conversation_repair as cr
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = r"[^\x20\x09-\x0D]"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(key.encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """Least (cost, audit) over all edit sequences, inserts without limit: Dijkstra over
    (rows read, state, audit)."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.findall(SOLID, text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen
                      else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out)):
            return faults, cost, audit, out
        if (i, state, audit) in done or len(audit) > 2 * len(rows) + 3:
            continue
        done.add((i, state, audit))
        wanted = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, wanted[0], out + (wanted + ":",)))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        late = faults[i] == "truncated"
        if role[:1] == wanted[0] or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1],
                                  out + (f"{role}:{text}",)))
        heapq.heappush(heap, (cost + late + 2, audit + "R", i + 1, wanted[0],
                              out + (f"{wanted}:{text}",)))


def brute(rows):
    found = {}
    damaged = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged if r[0] == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, cost, audit, out = brute_repair([r[1:] for r in mine])
        turns = [t for t, _, _ in mine if t is not None]
        roles = [r[:1] for _, r, _ in mine]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def run(spark, rows):
    talks = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in cr.audit(cr.damage(talks), talks).collect()}


def test_against_search_over_all_edits(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for k in range(rng.randint(1, 4)):
            rows.append((conv, rng.choice([k, k, k, k + 3, None]),
                         rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice(["a.", "b", "c!  \n", " \t", "", None, "é?", "Wie geht's?"])))
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (77, None, "user", "q?")]
    rows += [(78, 0, "assistant", "z.")] * 4
    assert run(spark, rows) == brute(rows)


def test_block_paths_equal_search_for_every_role_string():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(0, 6)
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a", "b.", " "]) + str(k) * 0)
                for k in range(n)]
        faults, cost, audit, out = brute_repair(rows)
        mark = {"": "0", "blank": "1", "duplicate": "2", "truncated": "3"}
        code = "".join(r[0][0] + mark[f] for r, f in zip(rows, faults))
        cut = 2 * rng.randint(0, n)
        blocks = [(len(c) // 2, cr.block_matrix(c)) for c in (code[:cut], code[cut:])]
        got, digits = cr.join_blocks(blocks)
        assert (got, "".join(cr.LETTERS[d] for d in digits if d != "0")) == (cost, audit)


def test_long_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_BITS", 3)
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{k}" + rng.choice([".", ""]))
            for k in range(300)]
    talks = spark.createDataFrame(rows, SCHEMA)
    got = cr.audit(cr.damage(talks), talks).first()
    damaged = sorted(brute_damage(rows), key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).digest()))
    code = []
    seen = set()
    for _, _, role, text in damaged:
        fault = 1 if not text.strip() else 2 if (role, text) in seen else 3 if text[-1] != "." else 0
        seen.add((role, text))
        code.append(f"{role[0]}{fault}")
    code = "".join(code)
    cost, digits = cr.join_blocks([(len(code) // 2, cr.block_matrix(code))])
    assert (got.cost, got.audit) == (cost, "".join(cr.LETTERS[d] for d in digits if d != "0"))
    assert len(got.audit) >= 250


def test_repaired_rows_have_legal_roles(spark):
    rows = [(c, k, r, "same.") for c in range(5) for k, r in enumerate(["assistant", "user", "user"])]
    talks = spark.createDataFrame(rows, SCHEMA)
    _, _, repaired = cr.repair(talks)
    by = {}
    for r in repaired.orderBy("conv_id", "pos", "sub").collect():
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())


def test_all_rows_dropped_empty_table_and_extra_columns(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    talks = (spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
             .withColumn("pos", F.lit(3)).withColumn("Fault", F.lit("q")))
    r = cr.audit(cr.damage(talks), talks).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], SCHEMA)
    assert cr.audit(cr.damage(none), none).count() == 0


def test_very_long_text(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    text = "wort " * 200_000 + "ende.   "
    assert run(spark, [(conv, 0, "user", text)]) == brute([(conv, 0, "user", text)])
