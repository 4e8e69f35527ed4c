"""Training-order materialisation.

Documents are encoded and cut into sequences of ``seq_len`` tokens (a document's last one is
padded; sequences never mix documents). The n sequences of the table are numbered 0 to n - 1
in scan order and a keyed Feistel permutation with cycle-walking sends each number to its
global slot: a seed gives one training order and needs no sort of the corpus. Slots are cut
into shards of ``rows_per_shard``; range partitions of whole shards are written in slot
order as files of fixed-stride records, so slot s is at byte ``(s % rows_per_shard) *
stride`` of shard ``s // rows_per_shard`` and reading can start or resume at any slot.

Numbers need the count of sequences of every scan partition. A first pass over the table
counts them (one number a partition reaches the driver); a second encodes again, numbers,
permutes and shuffles each sequence once. A task checks that it makes as many sequences as
were counted, so a scan that is not repeatable is an error and a lost task gives the same
slots again. The text writer commits the files: a record ends with a line feed, and a
record's bytes pass through it unchanged.

Record: document id (8 bytes, big-endian, least value for null), number of the sequence in its
document (4 bytes), number of tokens (2 bytes), ``seq_len`` token ids (2 bytes each,
little-endian, 65535 beyond the last), line feed.

Defined results: null and empty texts have no sequence; repeated rows have their own slots;
an empty table has no shards; other columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.byte_bpe import load_ranks
from docweave.llm.common import let
from docweave.session import scratch_path

SEQ_LEN = 256
ROWS_PER_SHARD = 8192
SHARDS_PER_TASK = 4     # at least; more beyond WAVES range partitions per core of the cluster
WAVES = 16
FEISTEL_ROUNDS = 6
HEAD = 14
PAD = 0xFFFF


class Feistel:
    """Keyed permutation of 0..n-1: a balanced Feistel network on the next even number of
    bits; a value outside is sent through again until it falls inside."""

    def __init__(self, n: int, key: int, rounds: int = FEISTEL_ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.Generator(np.random.Philox(key)).integers(
            0, 1 << 63, rounds, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (self._mix(right ^ k) & self.mask)
        return left << self.half | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(index.astype(np.uint64))
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._once(out[outside])
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)


class Shards(NamedTuple):
    path: str
    n_sequences: int
    seq_len: int
    rows_per_shard: int

    @property
    def stride(self) -> int:
        return HEAD + 2 * self.seq_len + 1


_MADE: dict[str, object] = {}


def _encoder(shared):
    import tiktoken
    ranks, pattern, key = shared.value
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key].encode_ordinary


def _records(doc_ids: list[int | None], ids: list[list[int]], seq_len: int) -> np.ndarray:
    """Records of documents (without the line feed), one after the other, as rows of bytes."""
    lengths = np.array([len(i) for i in ids], np.int64)
    n = -(-lengths // seq_len)
    total, last = int(n.sum()), np.cumsum(n) - 1
    short = n * seq_len - lengths
    tokens = array("H")
    for i, gap in zip(ids, short.tolist()):
        tokens.extend(array("H", i))
        tokens.extend(array("H", [PAD]) * gap)
    sizes = np.full(total, seq_len, ">u2")
    sizes[last] = seq_len - short
    out = np.empty((total, HEAD + 2 * seq_len), np.uint8)
    docs = np.array([-(1 << 63) if i is None else i for i in doc_ids], ">i8")
    out[:, :8] = np.repeat(docs, n).view(np.uint8).reshape(total, 8)
    number = np.arange(total) - np.repeat(last + 1 - n, n)
    out[:, 8:12] = number.astype(">u4").view(np.uint8).reshape(total, 4)
    out[:, 12:14] = sizes.view(np.uint8).reshape(total, 2)
    out[:, 14:] = np.asarray(tokens).astype("<u2", copy=False).view(np.uint8).reshape(total, -1)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array, without a copy of each."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def write_shards(docs: DataFrame, path: str, vocabulary: str, pattern: str, seed: int = 1,
                 seq_len: int = SEQ_LEN, rows_per_shard: int = ROWS_PER_SHARD,
                 id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Write the sequences of ``docs`` (a table scan or checkpoint) in training order."""
    ranks = load_ranks(vocabulary)
    if max(ranks.values(), default=0) >= PAD or not 0 < seq_len < 1 << 16:
        raise ValueError("token ids and sequence length must fit 16 bits")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((ranks, pattern, f"{vocabulary}|{pattern}"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = _encoder(shared), 0
        for b in batches:
            n += sum(-(-len(encode(t)) // seq_len) for t in b.column(1).to_pylist() if t)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([n], pa.int64())], ["part", "n"])

    counted = rows.mapInArrow(sizes, "part int, n long").toPandas()
    starts = np.zeros(int(counted["part"].max()) + 2 if len(counted) else 1, np.int64)
    starts[counted["part"].to_numpy() + 1] = counted["n"]
    starts = np.cumsum(starts)
    total = int(starts[-1])
    out = Shards(path, total, seq_len, rows_per_shard)
    if not total:
        return out
    order = Feistel(total, seed)
    shared_starts = context.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, starts = _encoder(shared), TaskContext.get().partitionId(), shared_starts.value
        at, end = starts[part:part + 2] if part + 1 < len(starts) else (total, total)
        for b in batches:
            made = [(i, ids) for i, t in zip(*map(lambda c: c.to_pylist(), b.columns))
                    if t and (ids := encode(t))]
            if made:
                made = _records(*zip(*made), seq_len)
                slots = order(np.arange(at, at + len(made)))
                at += len(made)
                yield pa.RecordBatch.from_arrays([pa.array(slots), _binary(made)], ["slot", "record"])
        if at != end:
            raise RuntimeError("the scan does not repeat: write the documents to a table first")

    shards = -(-total // rows_per_shard)
    per_task = max(SHARDS_PER_TASK, -(-shards // (WAVES * context.defaultParallelism)))
    tasks = -(-shards // per_task)
    shard = F.floor(F.col("slot") / rows_per_shard).cast("int")
    (rows.mapInArrow(place, "slot long, record binary").withColumn("shard", shard)
     .repartitionById(tasks, F.floor(F.col("shard") / per_task).cast("int"))
     .sortWithinPartitions("shard", "slot")
     .select("shard", F.col("record").cast("string").alias("value"))
     .write.partitionBy("shard").text(path))
    return out


def read_slots(spark: SparkSession, shards: Shards, start: int = 0, stop: int | None = None) -> DataFrame:
    """``slot, shard, doc_id, seq_no, n_tokens, ids`` (binary) of a range of slots; only the
    shards of the range are read."""
    schema = "slot long, shard int, doc_id long, seq_no int, n_tokens int, ids binary"
    stop = shards.n_sequences if stop is None else min(stop, shards.n_sequences)
    if stop <= start:
        return spark.createDataFrame([], schema)
    per, stride = shards.rows_per_shard, shards.stride
    files = (spark.read.format("binaryFile").load(shards.path)
             .where(F.col("shard").between(start // per, (stop - 1) // per)))

    def cut(content):
        last = F.floor(F.length(content) / stride).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last),
                           lambda i: F.substring(content, i * stride + 1, F.lit(stride)))

    # bound once: a column reference would copy the whole file for every record
    rows = files.select("shard", F.posexplode(let(F.col("content"), cut)).alias("row", "record"))

    def number(first: int, size: int, base: int = 10):
        return F.conv(F.hex(F.substring("record", first, size)), 16, base).cast("long")

    rows = rows.select((F.col("shard").cast("long") * per + F.col("row")).alias("slot"), "shard",
                       F.nullif(number(1, 8, -10), F.lit(-(1 << 63))).alias("doc_id"),
                       number(9, 4).cast("int").alias("seq_no"), number(13, 2).cast("int").alias("n_tokens"),
                       "record")
    return rows.where(F.col("slot").between(start, stop - 1)).select(
        "slot", F.col("shard").cast("int").alias("shard"), "doc_id", "seq_no", "n_tokens",
        F.substring(F.col("record"), F.lit(HEAD + 1), 2 * F.col("n_tokens")).alias("ids"))


def training_order(docs: DataFrame, vocabulary: str, pattern: str, **options) -> DataFrame:
    """Write the shards in the shared folder and return what they hold, slot by slot."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    return read_slots(spark, write_shards(docs, path, vocabulary, pattern, **options))
