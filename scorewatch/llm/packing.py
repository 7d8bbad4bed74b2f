"""Best-fit packing in bulk-synchronous rounds.

Documents are tokenised and cut: only a document longer than `capacity` is cut, into full
pieces behind a first one that holds the rest. Full pieces are sequences of their own;
every other piece is a document to place.

A round range-sorts unplaced documents and the gaps of open sequences together, largest
first. Each range is swept once by best fit: gaps that fit the document at hand lie on a
stack with the smallest on top; the document takes that one, and what is left of the gap
waits until documents are small enough for it. What a range could not settle is counted;
ranks in these counts say which left-over gap of an earlier range each left-over document
takes, last in first out, so no gap is given twice. Gaps shrink, full ones and those below
the smallest document are closed, and the round repeats. If the unplaced documents need
more room than all gaps have, or nothing was matched, the largest of them open new
sequences: as many as their sum needs. The number of ranges follows the rows that are left.

Defined cases: null text is empty and gives a piece of the end id alone; null and repeated
doc_ids are documents of their own; equal lengths are placed by row id; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, slices, table, written
from scorewatch.llm.encoders import encode_byte_bpe
from scorewatch.llm.huffman import with_end

CAPACITY, END = 2048, 0
#: Documents and gaps that one range of a round holds.
RANGE_ROWS = 200_000


def _cut(path: str, capacity: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, ids = with_end(*encode_byte_bpe(path, b.column("text")), end)
            raw = memoryview(ids.astype("<u4").tobytes())
            n_pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = counts - (n_pieces - 1) * capacity
            start = np.where(piece > 0, first[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[owner])
            at = (np.cumsum(counts) - counts)[owner] + start
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield as_batch(schema, [b.column("doc_id").take(pa.array(owner)), piece.astype(np.int32), start, length, crc])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Written rows (pid, doc_id, piece, start, length, ids_crc32) of all pieces of (doc_id, text)."""
    cut = docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return written(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")


SWEPT = pa.schema([("part", pa.int32()), ("what", pa.string()), ("rank", pa.int64()), ("pid", pa.int64()), ("length", pa.int64()), ("sid", pa.int64()), ("gap", pa.int64())])
SWEPT_DDL = "part int, what string, rank long, pid long, length long, sid long, gap long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, doc, id), largest first and gaps before documents of their size. A row `gap`
    fits all documents of later ranges, a row `low` may not; ranks go from the stack's top."""
    part, size = TaskContext.get().partitionId(), 0
    stack: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []  # heap of (-gap, sid)
    met, alone = [], []

    def ready(size: int) -> None:
        while waiting and -waiting[0][0] >= size:
            gap, sid = heapq.heappop(waiting)
            stack.append((sid, -gap))

    for b in batches:
        for size, doc, i in zip(*(b.column(c).to_pylist() for c in ("size", "doc", "id")), strict=True):
            if not doc:
                heapq.heappush(waiting, (-size, i))
                continue
            ready(size)
            if stack:
                sid, gap = stack.pop()
                met.append((i, size, sid, gap))
                if gap > size:
                    heapq.heappush(waiting, (size - gap, sid))
            else:
                alone.append((i, size))
    ready(size)
    rows = [(part, "met", k, *m) for k, m in enumerate(met)]
    rows += [(part, "doc", k, i, size, None, None) for k, (i, size) in enumerate(alone)]
    rows += [(part, "gap", k, None, None, sid, gap) for k, (sid, gap) in enumerate(reversed(stack))]
    rows += [(part, "low", k, None, None, sid, -gap) for k, (gap, sid) in enumerate(waiting)]
    if rows:
        yield as_batch(SWEPT, [list(c) for c in zip(*rows, strict=True)])


def _settle(counts: dict[tuple[int, str], int]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Spans (document part, first rank, gap part, first rank, n) across ranges, and how many
    left-over documents each part has beyond them. Parts are in order, largest sizes first."""
    stack: list[list[int]] = []
    spans, rest = [], {}
    for part in sorted({p for p, _ in counts}):
        docs, at = counts.get((part, "doc"), 0), 0
        while at < docs and stack:
            gap_part, first, left = stack[-1]
            n = min(left, docs - at)
            spans.append((part, at, gap_part, first, n))
            at += n
            stack[-1] = [gap_part, first + n, left - n]
            if not stack[-1][2]:
                stack.pop()
        if at < docs:
            rest[part] = docs - at
        if counts.get((part, "gap")):
            stack.append([part, 0, counts[part, "gap"]])
    return spans, rest


def _matched(spans: list, rest: dict[int, int], open_new: int):
    """Give rows their match number (of spans across ranges), or mark them as opening a sequence.
    The largest documents left over open: they come first in order of part and rank."""
    by_doc, by_gap, base = {}, {}, 0
    for doc_part, d, gap_part, g, n in spans:
        by_doc.setdefault(doc_part, []).append((d, n, base))
        by_gap.setdefault(gap_part, []).append((g, n, base))
        base += n
    opens, left = {}, open_new
    for part in sorted(rest):
        opens[part] = min(rest[part], left)
        left -= opens[part]
    ends = {p: max(d + n for d, n, _ in v) for p, v in by_doc.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, rank = b.column("part").to_numpy(), b.column("rank").to_numpy()
            what = np.array(b.column("what").to_pylist(), dtype=object)
            match, opening = np.full(len(part), -1, np.int64), np.zeros(len(part), bool)
            for kind, table in (("doc", by_doc), ("gap", by_gap)):
                for p in np.unique(part[what == kind]).tolist():
                    rows = (what == kind) & (part == p)
                    for first, n, base in table.get(p, ()):
                        sel = rows & (rank >= first) & (rank < first + n)
                        match[sel] = base + rank[sel] - first
                    if kind == "doc":
                        begin = ends.get(p, 0)
                        opening |= rows & (rank >= begin) & (rank < begin + opens.get(p, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(match), pa.array(opening)], names=[*b.schema.names, "match", "opens"])

    return run


def place(docs: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(pid, sid, place) for rows (pid, length) with lengths in 1..capacity - 1."""
    # A document above half of the capacity shares its sequence with no other of them.
    docs = docs.select("pid", "length")
    big = F.col("length") * 2 > capacity
    placed = [docs.where(big).select("pid", F.col("pid").alias("sid"), F.lit(0).cast("long").alias("place"))]
    gaps = docs.where(big).select(F.col("pid").alias("sid"), (capacity - F.col("length")).alias("gap"))
    docs = docs.where(~big)
    while True:
        left = docs.agg(F.count("*").alias("n"), F.min("length").alias("least")).first()
        if not left["n"]:
            break
        parts = 1 + (left["n"] + gaps.count()) // range_rows
        both = (docs.select(F.col("length").alias("size"), F.lit(True).alias("doc"), F.col("pid").alias("id"))
                .unionByName(gaps.where(F.col("gap") >= left["least"]).select(F.col("gap").alias("size"), F.lit(False).alias("doc"), F.col("sid").alias("id"))))
        order = [F.col("size").desc(), F.col("doc"), F.col("id")]
        both = both.repartitionByRange(parts, *order) if parts > 1 else both.coalesce(1)
        swept = written(both.sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT_DDL), "sweep")
        seen = swept.groupBy("part", "what").agg(F.count("*").alias("n"), F.sum("gap").alias("room"), F.sum("length").alias("tokens")).collect()
        counts = {(r["part"], r["what"]): r["n"] for r in seen}
        spans, rest = _settle(counts)
        unplaced = sum(r["tokens"] for r in seen if r["what"] == "doc")
        room = sum(r["room"] for r in seen if r["what"] in ("gap", "low"))
        need = -(-(unplaced - room) // capacity) if unplaced > room else 0
        if not need and not spans and not any(w == "met" for _, w in counts):
            need = max(1, -(-unplaced // capacity))
        out = written(swept.mapInArrow(_matched(spans, rest, need), SWEPT_DDL + ", match long, opens boolean"), "round")
        alone = out.where("match < 0")
        across = (out.where("what = 'doc' AND match >= 0").select("match", "pid", "length")
                  .join(out.where("what = 'gap' AND match >= 0").select("match", "sid", "gap"), "match").drop("match"))
        met = alone.where("what = 'met'").select("pid", "sid", "gap")
        left_gaps = alone.where("what IN ('gap', 'low')").select("sid", "gap")
        if spans:
            met = met.unionByName(across.select("pid", "sid", "gap"))
            left_gaps = left_gaps.unionByName(across.select("sid", (F.col("gap") - F.col("length")).alias("gap")).where("gap > 0"))
        new = alone.where("what = 'doc' AND opens")
        placed += [met.select("pid", "sid", (capacity - F.col("gap")).alias("place")), new.select("pid", F.col("pid").alias("sid"), F.lit(0).cast("long").alias("place"))]
        gaps = left_gaps.unionByName(new.select(F.col("pid").alias("sid"), (capacity - F.col("length")).alias("gap")))
        docs = alone.where("what = 'doc' AND NOT opens").select("pid", "length")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """All pieces with their sequence and their place in it."""
    cut = pieces(docs, path, capacity, end)
    full = F.col("length") == capacity
    places = place(cut.where(~full), capacity).unionByName(cut.where(full).select("pid", F.col("pid").alias("sid"), F.lit(0).cast("long").alias("place")))
    return (cut.join(places, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sid").alias("sequence_id"), F.col("place").alias("offset")))


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_best_fit": q_packing}
ORACLE: dict[str, str] = {}
