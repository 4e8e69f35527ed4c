"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints of whole texts are computed where the texts are read; from there on only
distinct 64-bit fingerprints move. Two fingerprints within d bits agree on at least k of
d + k bit blocks, so each is listed under every choice of k blocks and no link can be missed.
k is the least for which a key holds some thousand fingerprints (``MEMBERS``) on average: none
(one index over all) for a few thousand, one of five blocks (5 keys of about 13 bits) up to
10^8, two of six (15 keys of 21 bits) up to 4 * 10^10. The listed rows are range-partitioned and
sorted by (key, Gray rank): a key with many fingerprints spans several tasks. Runs of at most
``LEAF`` neighbours form leaves, and short whole keys share one. In a leaf the
fingerprints, in Gray order, are factored into a hierarchy of nodes, each holding the bits
all its members share beyond those of its parent; a search accumulates differing bits on
the way down and prunes a whole group once they exceed the distance. Leaves of one key in
different tasks are paired through a join of their shared-bit patterns under the same
bound. A leaf or pair returns a spanning set of links, never all pairs, and components are
found by a distributed star contraction.

Defined results: null and empty texts have fingerprint zero, linked like any other; null
ids never name a component unless all its ids are null; repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import fresh, keep_rows, row_key
from docweave.llm.components import components
from docweave.llm.exact_dedup import text_digest

SHINGLE = 4
MAX_DISTANCE = 4
MEMBERS = 16_384      # fingerprints a key should hold at most, on average
LEAF = 2048
PACK = 64             # whole keys share a leaf until it holds so many
FAN_OUT = 16
CHUNK = 64
SPARSE = 4            # links a member above which a leaf is searched breadth first
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text (A-Z lower-cased, ASCII white space, repeats count)."""
    import xxhash
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:len(ends) - k]]).tolist()
    ends = (ends[k - 1:] - 1).tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        parts = [joined[s:e] for s, e in zip(starts[at:at + 8192], ends[at:at + 8192])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, fp`` per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray sequence, as a long that sorts like unsigned."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def gray_rank_np(fp: np.ndarray) -> np.ndarray:
    r = fp.view(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def key_masks(blocks: int, keep: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def kept_blocks(n: int, distance: int, members: int = MEMBERS) -> int:
    """The least number k of equal blocks, of ``distance + k``, by which keys of n evenly spread
    fingerprints hold at most ``members`` each."""
    k = 0
    while n / 2 ** (64 * k / (distance + k)) > members:
        k += 1
    return k


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))       # of the absolute value, if signed


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; ``search`` prunes groups by the bits
    that differ so far."""

    def __init__(self, fps: np.ndarray):
        self.pruned = self.compared = 0        # groups left out whole, members reached
        self.levels = []                       # from members up: (pattern, own bits)
        ones, zeros = fps.copy(), ~fps         # bits that are one, or zero, in all members
        shared = []
        while True:
            shared.append((ones, ones | zeros))
            if len(ones) <= FAN_OUT:
                break
            at = np.arange(0, len(ones), FAN_OUT)
            ones = np.bitwise_and.reduceat(ones, at)
            zeros = np.bitwise_and.reduceat(zeros, at)
        for i, (pattern, mask) in enumerate(shared):
            if i + 1 < len(shared):            # bits shared above are counted above
                mask = mask & ~np.repeat(shared[i + 1][1], FAN_OUT)[:len(mask)]
            self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, member) at most ``distance`` bits apart."""
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        diff = np.zeros(len(q), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[level]
            diff = diff + popcount((queries[q] ^ pattern[node]) & mask[node])
            near = diff <= distance
            if level:
                self.pruned += int(len(near) - near.sum())
            else:
                self.compared += len(near)
            q, node, diff = q[near], node[near], diff[near]
            if level and len(q):
                below = len(self.levels[level - 1][0])
                first = node * FAN_OUT
                n = np.minimum(first + FAN_OUT, below) - first
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, diff = np.repeat(q, n), np.repeat(diff, n)
                node = np.repeat(first, n) + step
        return q, node


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of near fingerprints connect. ``fps`` is in Gray order.

    A sparse group returns its links, at most ``SPARSE`` a member. A dense one is searched
    breadth first from one member at a time: what has been reached leaves the search, so a
    ball of near copies costs little more than its size and returns one link a member."""
    index, one, two, n = GrayIndex(fps), [], [], 0
    for at in range(0, len(fps), CHUNK):
        q, t = index.search(fps[at:at + CHUNK], distance)
        q, t = q[t > q + at] + at, t[t > q + at]
        one.append(fps[q]), two.append(fps[t])
        n += len(q)
        if n > SPARSE * len(fps):
            break
    else:
        return np.concatenate(one), np.concatenate(two)
    one, two, rest = [], [], fps
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            chunk = queue.pop()
            q, t = GrayIndex(rest).search(chunk, distance)
            found, first = np.unique(t, return_index=True)
            one.append(chunk[q[first]]), two.append(rest[found])
            queue += [rest[found[i:i + CHUNK]] for i in range(0, len(found), CHUNK)]
            rest = np.delete(rest, found)
    return np.concatenate(one), np.concatenate(two)


LEAF_SCHEMA = ("a long, b long, combo int, part long, leaf long, ones long, zeros long, "
               "fps binary")


def _leaf_batch(links, nodes) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.int64)
    k = len(a)
    cols = list(zip(*nodes)) if nodes else [()] * 6
    none = [None] * len(nodes)
    kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64())]
        + [pa.array([*[None] * k, *c], kind) for c, kind in zip(cols, kinds)],
        ["a", "b", "combo", "part", "leaf", "ones", "zeros", "fps"])


def _leaves(distance: int):
    """Per task of (combo, part, fp, task) rows sorted by key and Gray rank: links inside
    leaves, and the leaves of keys that do not lie wholly inside one leaf (the first and the
    last key of the task, and keys of more than one leaf)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        first = flushed = None
        task = n_leaf = 0

        def leaf(key, f, emit, links, nodes):
            nonlocal n_leaf
            if len(f) > 1:
                links.append(spanning_links(f, distance))
            if emit:
                nodes.append((*key, task << 32 | n_leaf, int(np.bitwise_and.reduce(f)),
                              int(np.bitwise_and.reduce(~f)), f.tobytes()))
                n_leaf += 1

        def cut(final):
            nonlocal held, first, flushed
            combo, part, fp = held
            links, nodes = [], []
            if not len(fp):
                return links, nodes
            starts = np.concatenate([[0], np.flatnonzero(
                (np.diff(combo) != 0) | (np.diff(part) != 0)) + 1])
            size = np.diff(np.append(starts, len(fp)))
            last = len(starts) - 1
            packed = 0                                     # rows from here on are not yet in a leaf

            def pack(end):
                nonlocal packed
                if end > packed:
                    f = np.unique(fp[packed:end])
                    leaf(None, f[np.argsort(gray_rank_np(f))], False, links, nodes)
                packed = end

            for g in range(len(starts)):
                at, end = int(starts[g]), int(starts[g] + size[g])
                key = int(combo[at]), int(part[at])
                first = first or key
                if g == last and not final:                # more rows of this key may follow
                    pack(at)
                    while end - at >= LEAF:
                        leaf(key, fp[at:at + LEAF], True, links, nodes)
                        at, flushed = at + LEAF, key
                    held = [c[at:] for c in held]
                elif key in (first, flushed) or g == last or end - at > LEAF:
                    pack(at)
                    for i in range(at, end, LEAF):
                        leaf(key, fp[i:min(i + LEAF, end)], True, links, nodes)
                    packed = end
                elif end - packed >= PACK:
                    pack(end)
            return links, nodes

        for b in batches:
            if b.num_rows:
                task = b.column(3)[0].as_py()
                new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = [np.concatenate([h, c]) for h, c in zip(held, new)]
                yield _leaf_batch(*cut(False))
        yield _leaf_batch(*cut(True))

    return run


def _pairs(distance: int):
    """Links between the members of two leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = np.unique(np.concatenate([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)]))
                f = f[np.argsort(gray_rank_np(f))]
                one, two = spanning_links(f, distance)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints ``fp`` (a table or checkpoint) -> links ``a, b`` that span their
    components."""
    keep = kept_blocks(fps.count(), distance)
    masks = key_masks(distance + keep, keep)
    listed = fps.select("fp", gray_rank(F.col("fp")).alias("gray"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
        for i, m in enumerate(masks)])).alias("k"))
    listed = (listed.select("k.combo", "k.part", "fp", "gray")
              .repartitionByRange("combo", "part", "gray")
              .sortWithinPartitions("combo", "part", "gray")
              .select("combo", "part", "fp", F.spark_partition_id().alias("task")))
    found = listed.mapInArrow(_leaves(distance), LEAF_SCHEMA).checkpoint()
    leaves = found.where("fps IS NOT NULL").select("combo", "part", "leaf", "ones", "zeros", "fps")
    a, b = leaves.alias("x"), leaves.alias("y")

    def differ() -> Column:
        shared = (F.col("x.ones").bitwiseOR(F.col("x.zeros"))).bitwiseAND(
            F.col("y.ones").bitwiseOR(F.col("y.zeros")))
        return F.bit_count(F.col("x.ones").bitwiseXOR(F.col("y.ones")).bitwiseAND(shared))

    pairs = (a.join(b, (F.col("x.combo") == F.col("y.combo")) & (F.col("x.part") == F.col("y.part"))
                    & (F.col("x.leaf") < F.col("y.leaf")) & (differ() <= distance))
             .select(F.col("x.fps").alias("f"), F.col("y.fps").alias("g")))
    across = pairs.mapInArrow(_pairs(distance), "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(across)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id that
    chains of links reach."""
    if not 0 < distance < 64:
        raise ValueError("distance must be from 1 to 63")
    rows = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low")).checkpoint()
    roots = components(fingerprint_links(nodes.select("fp"), distance))
    nodes = (nodes.join(roots, nodes["fp"] == roots["vertex"], "left")
             .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lows, "root").select("fp", "component_id")
    return rows.join(nodes, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (its smallest id, then its smallest text
    digest; null ids last), columns unchanged. Ids may be null or repeat: a row is told by its
    id and text, so only members of one component are dropped for each other."""
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                text_digest(text_col).alias("sha")).alias("key"), text_col)
    found = near_dedup(rows, "key", text_col).where(F.col("doc_id") == F.col("component_id"))
    name = fresh(docs, "_llm_keep")
    return keep_rows(docs, found.select(row_key(F.col("doc_id.id"), F.col("doc_id.sha")).alias(name)),
                     row_key(F.col(id_col), text_digest(text_col)), name)
