"""Temporal splits, period bands and folds (#11-14, #17, #85, #130)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_null_period(df: DataFrame, period: str) -> DataFrame:
    """#14: rows with a non-NULL period (count of dropped rows via `null_period_count`)."""
    if period not in df.columns:
        raise KeyError(f"Time column '{period}' not found in data")
    return df.where(F.col(period).isNotNull())


def null_period_count(df: DataFrame, period: str) -> DataFrame:
    """#14: one row (rows, dropped, kept)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(period).isNull()).alias("dropped"),
        F.count(F.col(period)).alias("kept"),
    )


def split_bounds(df: DataFrame, period: str, train: int, val: int, test: int,
                 origin: str = "zero") -> tuple[int, int, int]:
    """#11/#13: validate and return (base, train_end, val_end).

    One small aggregate decides the plan: number of distinct periods and the
    minimum. Bounds compare the *value* (minus `base`) with month counts, so
    with origin='zero' periods must start at 0 like the original.
    """
    if period not in df.columns:
        raise KeyError(f"Time column '{period}' not found in data")
    for name, v in (("train_months", train), ("val_months", val), ("test_months", test)):
        if v is None or v < 1:
            raise ValueError(f"{name} must be at least 1")
    if origin not in ("zero", "min"):
        raise ValueError("origin must be 'zero' or 'min'")
    row = df.where(F.col(period).isNotNull()).agg(
        F.count_distinct(period).alias("u"), F.min(period).alias("lo")).first()
    u = int(row["u"] or 0)
    if u == 0:
        raise ValueError("Input data is empty")
    if u < train + val + 1:
        raise ValueError(
            f"Insufficient time periods: {u} unique periods, need at least {train + val + 1}")
    train_end = min(train, u)
    val_end = min(train_end + val, u)
    base = 0 if origin == "zero" else int(row["lo"])
    return base, train_end, val_end


def split_expr(period: str, base: int, train_end: int, val_end: int):
    t = F.col(period) - F.lit(base)
    return F.when(t < train_end, F.lit("train")).when(t < val_end, F.lit("val")).otherwise(F.lit("test"))


def temporal_split(df: DataFrame, period: str, train: int = 12, val: int = 4, test: int = 8,
                   origin: str = "zero", keep_period: bool = False,
                   check_nonempty: bool = False) -> DataFrame:
    """#11: add `split` in {train, val, test}; NULL periods dropped; period column removed
    unless keep_period. `test` is validated (>=1) but, as in the original, not used as a bound.
    """
    base, train_end, val_end = split_bounds(df, period, train, val, test, origin)
    out = drop_null_period(df, period).withColumn("split", split_expr(period, base, train_end, val_end))
    if check_nonempty:
        cnt = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        for s in ("train", "val", "test"):
            if not cnt.get(s):
                raise ValueError(f"Empty {s} split")
    return out if keep_period else out.drop(period)


def split_summary(df: DataFrame, label: str = "TARGET", split: str = "split") -> DataFrame:
    """#12: rows and default rate per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("default_rate"))


def regime(period, cycle: int | None = 24):
    """#17: stable (<8) / recession (8-15) / recovery (>=16); optionally of period % cycle."""
    t = F.col(period) if isinstance(period, str) else period
    if cycle:
        t = t % F.lit(cycle)
    return F.when(t < 8, F.lit("stable")).when(t < 16, F.lit("recession")).otherwise(F.lit("recovery"))


def regime_rates(df: DataFrame, period: str, label: str, cycle: int | None = 24) -> DataFrame:
    """#17: default rate and rows per regime band."""
    return (df.withColumn("regime", regime(period, cycle)).groupBy("regime")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("default_rate")))


MIX_MODULUS = 2147483647


def mix_key(key, seed: int = 42):
    """Seeded integer mix in [0, 2^31 - 1): (key * 48271 + seed) mod (2^31 - 1).

    Used as a repeatable pseudo-random order. The key is reduced first, so any 64-bit key
    works; a key that is no integer goes through a 64-bit hash. Plain integer arithmetic, so
    any SQL engine computes the same value for integers.
    """
    k = F.coalesce(F.col(key).try_cast("bigint"), F.xxhash64(key))
    return F.pmod(F.pmod(k, F.lit(MIX_MODULUS)) * F.lit(48271) + F.lit(seed), F.lit(MIX_MODULUS))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, bucket_bits: int = 8) -> DataFrame:
    """#130: seeded stratified k-fold assignment as a `fold` column.

    Within each class rows are numbered in the seeded `mix_key` order and
    fold = (row_number - 1) % k, so per-class fold sizes differ by at most one.
    The numbering is distributed: rows are cut into 2^bucket_bits ordered buckets by the
    high bits of the mix, bucket counts (that many rows per class) give offsets, and
    the row_number window is partitioned by (class, bucket), so a class
    holding a third of the table is still spread over all buckets.
    """
    if k < 2:
        raise ValueError("cv_folds must be at least 2")
    d = df.withColumn("_mix", mix_key(key, seed)).withColumn("_b", F.shiftright(F.col("_mix"), 31 - bucket_bits))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    w = Window.partitionBy(label, "_b").orderBy("_mix", key)
    return (
        d.join(offsets, [label, "_b"])
        .withColumn("fold", ((F.row_number().over(w) + F.col("_off") - 1) % k).cast("int"))
        .drop("_mix", "_b", "_off")
    )
