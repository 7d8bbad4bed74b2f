"""Helpers shared by the operators of this subpackage: table reading, written
intermediate tables, and Arrow batch plumbing for `mapInArrow` functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewatch.session import scratch_path

#: Text bytes an Arrow function works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder, read back with its own
    schema. Later steps scan the files, so a lost executor costs one task and not the
    steps before it."""
    return written_at(df, name, codec, partition_by)[0]


def written_at(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> tuple[DataFrame, str]:
    """As `written`, with the folder, for `dropped`."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.option("compression", codec)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that `written_at` made and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `limit` bytes of `text_col` (or one row)."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(text_col)).cast(pa.int64()), 0)).to_numpy()
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop
    given_back()


def given_back() -> None:
    """Freed memory back to the system: workers live on after a task, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def bundled(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but `text` in one struct, so that no name of theirs can clash
    with one that an operator adds."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("_")]).alias("row"), "text")


def unbundled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `bundled` had, in their order."""
    return df.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def extended(schema: StructType, ddl: str) -> StructType:
    """`schema` with the fields of `ddl` behind."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema, strict=True)],
        schema=schema)
