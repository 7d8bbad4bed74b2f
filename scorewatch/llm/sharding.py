"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly over buckets of at most about `BUCKET_BYTES` by a seeded hash of
the row (its id, text checksum, content and copy number among equal rows, so that equal rows
scatter too and the order does not depend on how the input is split) and writes them with
their bucket. Pass 2 gathers each bucket, sorts it by that hash, shuffles it with a seeded
Fisher-Yates permutation, and writes it. Buckets follow each other in one random order of all
rows; that order is cut into `n_shards` runs whose row counts differ by at most one (law
`rows`). A bucket thus writes into one shard, or a few where the cuts fall.

Copy numbers: hashes of the rows' contents are counted; where a content occurs more than once, its
rows are added up to one row and a count before they move, and dealt out again with their numbers.

Defined cases: null text has size 8 and the checksum of the empty text; null and
repeated ids and repeated rows are rows like others; with fewer rows than shards each
row has a shard of its own; an empty table gives no rows. The columns of the input but the
text come back in `row`, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import bundled, extended, table, written
from scorewatch.llm.filters import filter_of, passed

BUCKET_BYTES = 16 << 20
SEED = 20_011


#: Bits of the filter of contents that occur more than once, and copies that are dealt out at a time.
COPY_BITS, COPY_BLOCK = 1 << 24, 4_096


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` (row, text) with `copy`, numbering equal rows from 0."""
    content = [F.xxhash64(F.lit(i), "row", "text") for i in (1, 2)]
    twice = rows.select(content[0].alias("h1"), content[1].alias("h2")).groupBy("h1", "h2").count().where("count > 1")
    bits = filter_of(twice.select("h1"), COPY_BITS)
    if not bits.any():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    hashed = rows.select("row", "text", content[0].alias("h"))
    marked = hashed.mapInArrow(_marked(bits), extended(hashed.schema, "some boolean"))
    one = marked.where("some").groupBy("row", "text").agg(F.count(F.lit(1)).alias("n"))
    one = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPY_BLOCK)))).repartition("row", "block")
    first = F.col("block") * COPY_BLOCK
    again = one.select("row", "text", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, "n") - 1)).alias("copy"))
    return marked.where("NOT some").select("row", "text", F.lit(0).cast("long").alias("copy")).unionByName(again)


def _marked(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = passed(b.column("h").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(some)], names=[*b.schema.names, "some"])

    return run


def scatter(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass 1's keys: `key` (seeded row hash) and `bucket`."""
    key = F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.crc32(F.coalesce("text", F.lit(""))), "row", "copy")
    return numbered(rows).withColumn("key", key).withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)).cast("int")).drop("copy")


def _fisher_yates(seed: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t
        t = t.take(np.argsort(t["key"].to_numpy(), kind="stable"))
        order = np.random.Generator(np.random.PCG64([seed, key[0].as_py()])).permutation(t.num_rows)
        t = t.take(order)
        return t.set_column(t.schema.get_field_index("index"), "index",
                            pa.array(t["first"].to_numpy() + np.arange(t.num_rows)))

    return run


#: Buckets whose beginnings are added up together.
GROUP = 1_024


def beginnings(keyed: DataFrame) -> DataFrame:
    """(bucket, first, total): where each bucket begins in the order of all rows, over groups of buckets."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("bucket") / GROUP))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("part_n"))
    every = Window.partitionBy(F.lit(0))
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("part_n").over(every).alias("total"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("bucket", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("long").alias("first"), "total")


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, text, index, total): the row's place in a random order of all rows, and their number."""
    rows = bundled(docs)
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64).alias("b")).first()["b"] or 1
    # Buckets fit in memory, and there are enough of them for every task of a shuffle.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    keyed = written(scatter(rows, buckets, seed), "scattered")
    placed = keyed.join(beginnings(keyed), "bucket").withColumn("index", F.lit(0).cast("long"))
    return placed.groupBy("bucket").applyInArrow(_fisher_yates(seed), placed.schema).drop("bucket", "key", "first")


def sharded(docs: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Written shards, read back: (row, text, shard, slot), slots from 0; `row` holds the columns of `docs`
    (doc_id among them) but the text."""
    rows = shuffled(docs, seed, bucket_bytes)
    # Shard s holds the places from floor(s * total / n) on.
    shard = F.expr(f"CAST((index * {n_shards} + {n_shards - 1}) div total AS INT)")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.expr(f"index - (shard * total) div {n_shards}")).drop("index", "total")
    return written(rows, "shards", codec="zstd", partition_by="shard")


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    text = F.coalesce("text", F.lit(""))
    return rows.select("row.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_external_shuffle": q_sharding}
ORACLE: dict[str, str] = {}
