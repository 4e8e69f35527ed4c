"""Conversation structure repair by integer shortest paths.

A conversation is repaired when its roles read ``(s?(ua)+)?`` by their initials. Every row is
kept, rerolled or deleted, and a user or assistant row may be inserted in front of it; the
cheapest edits win, ties by the ASCII-least string of their initials D, I, K, R.

One integer weighs a path: its high digits are the cost and its low digits, two octal digits
per row at a fixed place, the letters of the row's edits (D 1, I 2, K 3, R 4) with zeros at
their end. So the smallest sum of edge weights in an ordinary graph over (row, state) is the
answer, cost and ties at once. Two facts make the fixed places right: a row's letters (D, ID,
IK, IR, K, R) are prefix-free, so comparing them place by place compares the strings; and a
cheapest path never inserts twice in one gap, as two inserts lead back to the state they
started from for 4 more, and after a lone system row deleting that row costs 3 or less.

Rows are sorted by conversation and turn over range partitions (a conversation that holds a
third of the rows spans many) and written with their global position. Blocks of at most 512
neighbouring rows are each reduced to a 4 x 4 matrix of integers, the best path between any
two states; a conversation's matrices, a few bytes per row, are then added up in order, which
is the same integer minimum. The edits go back to the rows by position. Only the digest of a
repaired conversation runs through its rows in one task, in order and a row at a time,
because SHA-256 is defined that way; ``repair`` itself does not.

Defined results: a null role or text is one space (a null id or turn too, where ``damage``
draws by them); rows of a turn are ordered by role and MD5 of the text; a conversation of no rows has
zeros, an empty audit and the digest of the empty string; rows with a null conversation id are
one conversation; rows that repeat role and text are duplicates; an empty table gives no
rows; other columns are ignored. A text must fit into a row, and an audit into a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACE_CLASS, join_split, staged, two_hashes

BLOCK_BITS = 9
ROLES = {"u": "user", "a": "assistant"}
LETTERS = {"1": "D", "2": "I", "3": "K", "4": "R"}
D, I, K, R = 1, 2, 3, 4
REROLE = INSERT = 2
DELETE = 3
# states by what came last: nothing, s, u, a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEEP = {"s": {START: AFTER_S}, "a": {AFTER_U: AFTER_A},
        "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "x": {}}
WRITES = {AFTER_U: "u", AFTER_A: "a"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damage(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with a twentieth of the rows each dropped, emptied, robbed
    of ``.!?``, repeated and given the role user, by CRC-32 of ``conv_id:turn``."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    rows = talks.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        or_space(role_col).alias("r"), or_space(text_col).alias("t"),
                        draw.alias("d")).where("d != 0")
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("r")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("t", ".!?", ""))
        .otherwise(F.col("t")).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, their place in the order by conversation and turn (nulls first).
    Equal rows are told apart by a seeded number, so that they can be dealt to many tasks. Texts
    are no sort keys: range bounds are drawn from a sample of the keys on the driver."""
    keys = ["conv_id", "turn", "role", "digest", "salt"]
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                       F.md5(text.cast("binary")).alias("digest"), F.rand(12).alias("salt"))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "pos", F.monotonically_increasing_id())
    return staged(placed.drop("digest", "salt"), "conversations")


def with_faults(rows: DataFrame) -> DataFrame:
    """``pos, conv_id, turn, initial, fault`` of ordered rows: the first fault of each."""
    solid = f"[^{SPACE_CLASS}]"
    a, b = two_hashes(F.col("conv_id"), F.col("conv_id").isNull(), F.col("role"), F.col("text"))
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "pos", "conv_id", "turn",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(solid)).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE_CLASS}]*\z")).alias("truncated"),
        a.alias("a"), b.alias("b")).checkpoint()
    firsts = (rows.where("not blank").groupBy("a", "b")
              .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
              .checkpoint())
    fault = (F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE)
             .when(F.col("truncated"), TRUNCATED).otherwise(0))
    return join_split(rows, firsts, ["a", "b"], "c", "left").select(
        "pos", "conv_id", "turn", "initial", fault.alias("fault"))


def _edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, int]]:
    """``cost, field, next state`` of all edits of one row from ``state``."""
    for lead, cost, at in ((0, 0, state), (I, INSERT, NEXT[state])):
        def field(letter, lead=lead):
            return lead << 3 | letter if lead else letter << 3

        yield cost + DELETE, field(D), at
        if fault not in (BLANK, DUPLICATE):
            late = fault == TRUNCATED
            if at in KEEP[initial]:
                yield cost + late, field(K), KEEP[initial][at]
            yield cost + late + REROLE, field(R), NEXT[at]


_TABLE = {(s, r, f): list(_edits(s, r, f)) for s in range(4) for r in KEEP for f in range(4)}


def block_matrix(code: str) -> list[list[int | None]]:
    """Weights of the best paths between any two states over a block of rows, written as
    initial and fault of each row."""
    n = len(code) // 2
    found = []
    for start in range(4):
        best: list[int | None] = [None] * 4
        best[start] = 0
        for i in range(n):
            shift = 6 * (n - 1 - i)
            after: list[int | None] = [None] * 4
            for state, weight in enumerate(best):
                if weight is None:
                    continue
                for cost, field, to in _TABLE[state, code[2 * i], int(code[2 * i + 1])]:
                    path = weight + (cost << 6 * n) + (field << shift)
                    if after[to] is None or path < after[to]:
                        after[to] = path
            best = after
        found.append(best)
    return found


def join_blocks(blocks: list[tuple[int, list[list[int | None]]]]) -> tuple[int, str]:
    """Cost and octal digits of the best path through blocks ``(rows, matrix)`` in order: two
    digits per row and one for an insert at the end."""
    best: list[int | None] = [0, None, None, None]
    width = 0
    for n, matrix in blocks:
        low = (1 << 6 * n) - 1
        after: list[int | None] = [None] * 4
        for state, weight in enumerate(best):
            for to, more in enumerate(matrix[state]):
                if weight is None or more is None:
                    continue
                path = (weight << 6 * n) + (more >> 6 * n << 6 * (n + width)) + (more & low)
                if after[to] is None or path < after[to]:
                    after[to] = path
        best, width = after, width + n
    ends = [w << 3 for w in (best[START], best[AFTER_A]) if w is not None]
    if best[AFTER_U] is not None:
        ends.append((best[AFTER_U] << 3) + (INSERT << 6 * width + 3) + I)
    least = min(ends)
    digits = least & (1 << 6 * width + 3) - 1
    return least >> 6 * width + 3, format(digits, "o").zfill(2 * width + 1)


def written(code: str, digits: str) -> str:
    """Three characters per row: the role inserted before it, its own role (``k``: as it is)
    and the role inserted after it; ``-`` for none (a deleted row)."""
    state, out = START, []
    n = len(code) // 2
    for i in range(n):
        lead, own = "-", "-"
        for letter in digits[2 * i:2 * i + 2]:
            if letter == "2":
                state = NEXT[state]
                lead = WRITES[state]
            elif letter == "3":
                state, own = KEEP[code[2 * i]][state], "k"
            elif letter == "4":
                state = NEXT[state]
                own = WRITES[state]
        out += [lead, own, "a" if i == n - 1 and digits[-1] == "2" else "-"]
    return "".join(out)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[format(w, "x") if w is not None else None for m in block_matrix(c) for w in m]
                 for c in batch.column("code").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns)),
             pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "matrix"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits, edits, illegal = [], [], [], []
        for blocks in batch.column("blocks").to_pylist():
            parts = []
            for b in blocks:
                flat = [None if w is None else int(w, 16) for w in b["matrix"]]
                parts.append((len(b["code"]) // 2, [flat[k:k + 4] for k in range(0, 16, 4)]))
            cost, digits = join_blocks(parts)
            code = "".join(b["code"] for b in blocks)
            roles, marks, at = code[::2], written(code, digits), 0
            costs.append(cost)
            audits.append("".join(LETTERS[d] for d in digits if d != "0"))
            illegal.append(sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])))
            edits.append([])
            for b, (n, _) in zip(blocks, parts):
                edits[-1].append({"pos": b["pos"], "marks": marks[at:at + 3 * n]})
                at += 3 * n
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()),
             pa.array(audits, pa.string()),
             pa.array(edits, pa.list_(pa.struct([("pos", pa.int64()), ("marks", pa.string())])))],
            ["conv_id", "illegal", "cost", "audit", "edits"])


def plan(faults: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, illegal, cost, audit, edits``."""
    block = F.shiftright("pos", BLOCK_BITS)
    row = F.struct("pos", F.concat("initial", F.col("fault").cast("string")).alias("c"))
    blocks = faults.groupBy("conv_id", block.alias("block")).agg(
        F.min("pos").alias("pos"), F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = blocks.select("conv_id", "pos", F.array_join(
        F.transform("rows", lambda x: x["c"]), "").alias("code"))
    conv = faults.schema["conv_id"].dataType.simpleString()
    blocks = blocks.mapInArrow(
        _matrices, f"conv_id {conv}, pos long, code string, matrix array<string>")
    talks = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("pos", "code", "matrix"))).alias("blocks"))
    return talks.mapInArrow(
        _audits, f"conv_id {conv}, illegal long, cost long, audit string, "
                 "edits array<struct<pos:long,marks:string>>")


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, pos, sub, role, text`` of the repaired conversations, in order of (pos, sub).
    Edits find their row by its position, which no two rows share."""
    n = (F.length("b.marks") / 3).cast("int")
    edits = (plans.select(F.explode("edits").alias("b"))
             .select("b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
             .select((F.col("b.pos") + F.col("i")).alias("pos"),
                     F.substring(F.col("b.marks"), 3 * F.col("i") + 1, F.lit(3)).alias("e")))

    def part(k: int, own: Column, text: Column) -> Column:
        at = F.substring("e", k + 1, 1)
        role = F.when(at == "u", ROLES["u"]).when(at == "a", ROLES["a"]).when(at == "k", own)
        return F.struct(F.lit(k).alias("sub"), role.alias("role"), text.alias("text"))

    none, empty = F.lit(None).cast("string"), F.lit("")
    parts = F.array(part(0, none, empty), part(1, F.col("role"), F.col("text")), part(2, none, empty))
    return (rows.join(edits.where("e != '---'"), "pos")
            .select("conv_id", "pos", F.explode(parts).alias("x"))
            .where("x.role is not null").select("conv_id", "pos", "x.*"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs through sorted rows once; holds one conversation's hash and one batch."""
    last, state, names, done = None, None, None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())],
            ["conv_id", "repaired_sha256"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if state is None or conv != last:
                if state is not None:
                    done.append((last, state.hexdigest()))
                last, state = conv, hashlib.sha256(line.encode("utf-8"))
            else:
                state.update(b"\n" + line.encode("utf-8"))
        if done:
            yield flush()
            done = []
    if state is not None:
        done.append((last, state.hexdigest()))
        yield flush()


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the newline-joined ``role:text`` of each conversation."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return (lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")
            .select("conv_id", "line").mapInArrow(_digests, f"conv_id {conv}, repaired_sha256 string"))


def repair(damaged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faults by row, the plan of each conversation and the repaired rows."""
    rows = ordered(damaged)
    faults = with_faults(rows).checkpoint()
    plans = plan(faults).checkpoint()
    return faults, plans, repaired_rows(rows, plans)


def audit(damaged: DataFrame, original: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``original``: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256`` of its rows in ``damaged``."""
    faults, plans, repaired = repair(damaged)

    def number(fault: int) -> Column:
        return F.count_if(F.col("fault") == fault)

    turns = faults.groupBy("conv_id", "turn").agg(
        number(BLANK).alias("blank"), number(DUPLICATE).alias("duplicate"),
        number(TRUNCATED).alias("truncated"))
    counts = turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    out = original.select(F.col(conv_col).alias("id")).distinct()
    for more in (counts, plans.select("conv_id", "illegal", "cost", "audit"), digests(repaired)):
        out = out.join(more, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zeros = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
             for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
        lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda u, v: xor(u >> 1, (u & 1) * 3988292384)))) % 20 AS d FROM c),
w AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) FROM h WHERE d <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        regexp_matches(text, '[^\x20\x09-\x0D]') AS solid,
        regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended FROM o),
g AS (SELECT *, CASE WHEN NOT solid THEN 1 WHEN again THEN 2 WHEN NOT ended THEN 3 ELSE 0 END AS fault
      FROM f),
p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'out': []::VARCHAR[]} AS best
      FROM (SELECT DISTINCT conv_id FROM g)
      UNION ALL
      SELECT conv_id, i, q2, min(path) FROM (
        SELECT *, CASE WHEN act = 'D' THEN q1 WHEN act = 'R' THEN [2, 2, 3, 2][q1 + 1]
                       WHEN r = 's' AND q1 = 0 THEN 1 WHEN r = 'u' AND q1 <> 2 THEN 2
                       WHEN r = 'a' AND q1 = 2 THEN 3 END AS q2,
          {'cost': best.cost + CASE WHEN lead = 'I' THEN 2 ELSE 0 END
                   + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                   + CASE WHEN act <> 'D' AND fault = 3 THEN 1 ELSE 0 END,
           'audit': concat(best.audit, lead, act),
           'out': best.out || CASE WHEN lead = '' THEN []::VARCHAR[]
                                   ELSE [CASE q1 WHEN 2 THEN 'user:' ELSE 'assistant:' END] END
             || CASE act WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [concat(role, ':', text)]
                ELSE [concat(CASE q1 WHEN 2 THEN 'assistant:' ELSE 'user:' END, text)] END} AS path
        FROM (SELECT p.conv_id, g.i, g.role, g.text, g.r, g.fault, p.best, l.lead, e.act,
                     CASE WHEN l.lead = '' THEN p.q ELSE [2, 2, 3, 2][p.q + 1] END AS q1
              FROM p JOIN g ON g.i = p.i + 1 AND g.conv_id IS NOT DISTINCT FROM p.conv_id,
                   (VALUES (''), ('I')) l(lead), (VALUES ('D'), ('K'), ('R')) e(act)
              WHERE e.act = 'D' OR g.fault NOT IN (1, 2)))
      WHERE q2 IS NOT NULL GROUP BY conv_id, i, q2),
z AS (SELECT conv_id, min(CASE WHEN q <> 2 THEN best ELSE
          {'cost': best.cost + 2, 'audit': concat(best.audit, 'I'),
           'out': best.out || ['assistant:']} END) AS best
      FROM p JOIN (SELECT conv_id AS last, max(i) AS n FROM g GROUP BY conv_id)
        ON i = n AND conv_id IS NOT DISTINCT FROM last WHERE q <> 1 GROUP BY conv_id),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
        count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (i > 1 AND concat(before, r) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM g GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id"""
