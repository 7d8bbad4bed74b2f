"""Rolling sums over the last n rows of a key by halo exchange (#82, #116, #133).

One row-level shuffle: rows are range-partitioned and sorted by (key, order), and every task
streams its range once, holding the last n - 1 rows of the open key. Only rows near a range's
beginning may reach back into earlier ranges, and only in the range's first key; they leave with
what the range itself gives, and the last n - 1 rows of each range's last key leave as its tail.
Tails and unfinished rows, about n a range, are then matched by themselves.

A window's sum is that of the end of one block of n rows and the beginning of the next, so nothing is
subtracted and small values keep their digits next to large ones. Several windows come from one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scorewatch.session import cut_lineage

FINAL, OPEN, TAIL = 0, 1, 2


def window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n values (or all there are) at every place."""
    blocks = np.concatenate([x, np.zeros(-len(x) % n)]).reshape(-1, n)
    begin = np.cumsum(blocks, axis=1).ravel()[:len(x)]
    end = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out, at = begin.copy(), np.arange(len(x))
    across = (at >= n) & (at % n != n - 1)
    out[across] += end[at[across] - n + 1]
    return out


def _stream(names: list[str], windows: list[int]):
    """Rows (names..., _key, part, pos, kind, len, value, s<n>...) of one sorted range."""
    most = max(windows) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first, held, pos, schema = TaskContext.get().partitionId(), None, True, np.zeros(0), 0, None
        for b in batches:
            schema = b.schema
            keys = b.column("_key").dictionary_encode()
            codes, values = keys.indices.to_numpy(), b.column("value").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
            place, kind = np.empty(len(codes), np.int64), np.full(len(codes), FINAL, np.int32)
            sums = {n: np.empty(len(codes)) for n in windows}
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if a == z:
                    continue
                name = keys.dictionary[int(codes[a])].as_py()
                if name != key:
                    key, first, held, pos = name, key is None, np.zeros(0), 0
                all_ = np.concatenate([held, values[a:z]])
                for n in windows:
                    sums[n][a:z] = window_sums(all_[-(z - a + n - 1):], n)[-(z - a):]
                place[a:z] = pos + np.arange(z - a)
                if first and part:
                    kind[a:z][place[a:z] < most] = OPEN
                held, pos = all_[max(0, len(all_) - most):], pos + z - a
            cols = {c: b.column(c) for c in names} | {"_key": b.column("_key"), "part": pa.array(np.full(len(codes), part, np.int32)), "pos": pa.array(place),
                                                      "kind": pa.array(kind), "len": pa.nulls(len(codes), pa.int64()), "value": b.column("value")}
            yield pa.RecordBatch.from_pydict(cols | {f"s{n}": pa.array(s) for n, s in sums.items()})
        if key is not None and len(held):
            k = len(held)
            cols = {c: pa.nulls(k, schema.field(c).type) for c in names} | {"_key": pa.array([key] * k, schema.field("_key").type), "part": pa.array(np.full(k, part, np.int32)),
                    "pos": pa.array(np.arange(pos - k, pos)), "kind": pa.array(np.full(k, TAIL, np.int32)), "len": pa.array(np.full(k, pos)), "value": pa.array(held)}
            yield pa.RecordBatch.from_pydict(cols | {f"s{n}": pa.nulls(k, pa.float64()) for n in windows})

    return run


def _before(rows: DataFrame, most: int) -> DataFrame:
    """(_key, part, before): for ranges that begin inside a key, the sums of the 1, 2, ... rows before
    the range, up to `most`, from the tails of the ranges before it."""
    tails, begun = rows.where(F.col("kind") == TAIL), rows.where(F.col("kind") == OPEN).select("_key", "part").distinct()
    ends = tails.select("_key", F.col("part").alias("source"), "len").distinct()
    w = Window.partitionBy("_key", "part").orderBy(F.desc("source")).rowsBetween(Window.unboundedPreceding, -1)
    pairs = begun.join(ends, "_key").where(F.col("source") < F.col("part"))
    pairs = pairs.withColumn("between", F.coalesce(F.sum("len").over(w), F.lit(0))).where(F.col("between") < most).drop("len")
    near = tails.select("_key", F.col("part").alias("source"), "value", (F.col("len") - F.col("pos")).alias("back")).join(pairs, ["_key", "source"])
    near = near.withColumn("m", F.col("between") + F.col("back")).where(F.col("m") <= most)
    up_to = Window.partitionBy("_key", "part").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    sums = near.select("_key", "part", "m", F.sum("value").over(up_to).alias("s"))
    return sums.groupBy("_key", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "s"))), lambda x: x["s"]).alias("before"))


def rolling_means(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, windows: Sequence[int],
                  ranges: int | None = None) -> DataFrame:
    """(by..., order..., n_<w>, mean_<w> for each window w): at every row the number of rows in the
    window (itself and those before it in its key, at most w) and their mean. `order` is unique within a
    key; rows with a NULL value do not count."""
    by, order, windows = list(by), list(order), sorted(set(windows))
    if not windows or windows[0] <= 0:
        raise ValueError("window must be positive")
    names = list(dict.fromkeys([*by, *order]))
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    base = df.select(*names, key.alias("_key"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = base.repartitionByRange(ranges, "_key", *order).sortWithinPartitions("_key", *order)
    kinds = StructType([*(StructField(f.name, f.dataType) for f in base.select(*names, "_key").schema.fields),
                        *StructType.fromDDL("part int, pos long, kind int, len long, value double, " + ", ".join(f"s{n} double" for n in windows)).fields])
    rows = cut_lineage(sorted_.mapInArrow(_stream(names, windows), kinds), "rolling")
    done = rows.where(F.col("kind") == FINAL).select(
        *names, *[x for n in windows for x in (F.least(F.col("pos") + 1, F.lit(n)).alias(f"n_{n}"), F.col(f"s{n}").alias(f"s{n}"))])
    open_ = rows.where(F.col("kind") == OPEN).join(_before(rows, windows[-1] - 1), ["_key", "part"], "left")
    have = F.coalesce(F.size("before"), F.lit(0))
    have = F.when(have < 0, 0).otherwise(have)
    reach = {n: F.greatest(F.least(F.lit(n) - F.col("pos") - 1, have), F.lit(0)).cast("int") for n in windows}
    fixed = open_.select(*names, *[x for n in windows for x in (
        F.least(F.col("pos") + 1 + have, F.lit(n)).alias(f"n_{n}"),
        (F.col(f"s{n}") + F.when(reach[n] > 0, F.get("before", reach[n] - 1)).otherwise(F.lit(0.0))).alias(f"s{n}"))])
    both = done.unionByName(fixed)
    return both.select(*names, *[x for n in windows for x in (F.col(f"n_{n}"), (F.col(f"s{n}") / F.col(f"n_{n}")).alias(f"mean_{n}"))])
