"""Token ids as canonical, length-limited Huffman files.

Documents are range-sorted by doc_id, encoded by a tokenizer, and cut into blocks of
whole documents. Global counts of the ids give code lengths of at most `MAX_BITS`
(package-merge); canonical codes follow from the lengths alone. A file is a Parquet table
of blocks (shard, block, place of its first id in the shard, doc_ids, their lengths, code
bits, bits of every run of `RUN` ids), in one folder per shard, beside a table (id,
n_bits). A block is decoded on its own: the runs are its checkpoints, and all its runs
are decoded side by side through one table indexed by the next `MAX_BITS` bits.

Ascending order is by (doc_id, text): null first; repeated ids are documents of their
own. Null text is empty and has the end id only. An empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, slices, table, written
from scorewatch.llm.encoders import encode_word_bpe, ragged

END = 2
MAX_BITS = 16
RUN = 128
BLOCK_IDS = 1 << 17
BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
BLOCKS_DDL = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, ids binary"


def with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append `end` to each text's ids."""
    out = np.full(len(ids) + len(counts), end, np.int32)
    out[ragged(np.cumsum(counts + 1) - (counts + 1), counts)] = ids
    return counts + 1, out


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            nonlocal block, start
            n = np.concatenate(lengths)
            row = as_batch(BLOCKS, [[shard], [block], [start], [list(doc_ids)], [n.tolist()], [np.concatenate(ids).astype("<u4").tobytes()]])
            block, start = block + 1, start + int(n.sum())
            doc_ids.clear(), lengths.clear(), ids.clear()
            return row

        for b in slices(batches, "text"):
            counts, flat = with_end(*encode_word_bpe(path, b.column("text")), end)
            ends, at, lo = np.cumsum(counts), b.column("doc_id").to_pylist(), 0
            while lo < len(at):
                room = BLOCK_IDS - sum(int(x.sum()) for x in lengths)
                base = int(ends[lo - 1]) if lo else 0
                hi = int(np.searchsorted(ends, base + room, side="right"))
                if hi == lo and not lengths:  # a document longer than a block
                    hi = lo + 1
                if hi > lo:
                    doc_ids += at[lo:hi]
                    lengths.append(counts[lo:hi])
                    ids.append(flat[base:int(ends[hi - 1])])
                    lo = hi
                if lo < len(at):
                    yield full()
        if lengths:
            yield full()

    return run


def id_blocks(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Blocks of ids of (doc_id, text), written; shards are ranges of doc_id in order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    return written(docs.select("doc_id", "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).mapInArrow(_tokenise(path, end), BLOCKS_DDL), "id-blocks")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column("ids"):
            c = np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=len(total))
            c[:len(total)] += total
            total = c
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids.astype(np.int32)), "n": pa.array(total[ids])})


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most `limit` bits for symbols counted `counts` (all positive)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    made, row = [], leaves  # per round: which of the merged list are leaves
    made.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        made.append(at < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(made):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of `ids` (ascending) with `lengths`."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.bits = int(lengths.max(initial=1))
        size = int(ids.max(initial=0)) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint32)
        # Codes of one length follow each other; the first of the next length is shifted.
        span = np.int64(1) << (self.bits - lengths[order])
        first = np.cumsum(span) - span
        self.code[ids[order]] = first >> (self.bits - lengths[order])
        self.length[ids[order]] = lengths[order]
        self.symbol = np.zeros(1 << self.bits, np.int32)
        self.step = np.ones(1 << self.bits, np.int64)
        used = int(span.sum())
        self.symbol[:used] = np.repeat(ids[order], span)
        self.step[:used] = np.repeat(lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the number of bits of every run of RUN ids."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = ends - n
        word = self.code[ids] << (32 - (at & 7) - n).astype(np.uint32)  # up to 7 + MAX_BITS bits from a byte's start
        byte, size = at >> 3, (int(ends[-1]) + 7 >> 3) + 3 if len(ids) else 3
        out = np.zeros(size)
        for k in range(3):
            out[:size] += np.bincount(byte + k, weights=(word >> np.uint32(24 - 8 * k)) & np.uint32(255), minlength=size)[:size]
        return out.astype(np.uint8).tobytes(), np.add.reduceat(n, np.arange(0, len(n), RUN)).astype("<u2") if len(n) else np.zeros(0, "<u2")

    def decode(self, bits: bytes, runs: np.ndarray, total: int) -> np.ndarray:
        raw = np.frombuffer(bits, np.uint8).astype(np.uint32)
        three = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        runs = runs.astype(np.int64)
        at = np.cumsum(runs) - runs
        out = np.empty((RUN, len(runs)), np.int32)
        last, mask = total - RUN * (len(runs) - 1), np.uint32((1 << self.bits) - 1)
        for k in range(RUN):
            if k == last:  # the last run is shorter
                at = at[:-1]
            next_bits = (three[at >> 3] >> (24 - self.bits - (at & 7)).astype(np.uint32)) & mask
            out[k, :len(at)] = self.symbol[next_bits]
            at = at + self.step[next_bits]
        return out.T.reshape(-1)[:total]


FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                  ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("runs", pa.binary())])


def _encode(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                bits, runs = code.encode(np.frombuffer(row.column("ids")[0].as_buffer(), "<u4").astype(np.int64))
                yield as_batch(FILE, [*row.columns[:5], [bits], [runs.tobytes()]])

    return run


def write_files(blocks: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(block files, code table), written, from blocks of ids. At most one count per id of the
    vocabulary reaches the driver."""
    rows = blocks.select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in rows], np.int64), max_bits)
    spark = blocks.sparkSession
    code = spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths, strict=True)], "id int, n_bits int")
    ddl = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, bits binary, runs binary"
    files = blocks.mapInArrow(_encode(Code(ids, lengths)), ddl)
    return written(files, "huffman", partition_by="shard"), written(code, "huffman-code")


def _decode(code: Code, shard_start: dict[int, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, doc_ids, lengths, bits, runs in zip(*(b.column(c) for c in ("shard", "start", "doc_ids", "lengths", "bits", "runs")), strict=True):
                n = np.array(lengths.as_py(), np.int64)
                ids = code.decode(bits.as_py(), np.frombuffer(runs.as_py(), "<u2"), int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids.tobytes())])
                yield as_batch(schema, [doc_ids.values, shard_start[shard.as_py()] + start.as_py() + ends - n, n, column])

    return run


def read_files(files: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian 32-bit) of every document. One total per
    shard (their number is the setting spark.sql.shuffle.partitions) reaches the driver."""
    rows = code.orderBy("id").collect()
    table = Code(np.array([r["id"] for r in rows], np.int64), np.array([r["n_bits"] for r in rows], np.int64))
    per = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    starts, total = {}, 0
    for r in per:
        starts[r["shard"]], total = total, total + r["n"]
    cols = ["shard", "start", "doc_ids", "lengths", "bits", "runs"]
    return files.select(*cols).mapInArrow(_decode(table, starts), "doc_id long, start long, n_tokens long, ids binary")


def q_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = id_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    back = read_files(*write_files(blocks))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_huffman_ids": q_huffman}
ORACLE: dict[str, str] = {}
