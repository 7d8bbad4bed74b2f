"""Distributed synthetic loan generators (#5, #6), seeded and repeatable.

Rows come from `spark.range(n)`; every column is a seeded function of the row
id (`rand`/`randn` with a seed are deterministic per partition layout, so the
layout is fixed by `num_partitions`). Used by the loader's opt-in fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values (must equal the original's)
HOME_MONTHS = 24
RECESSION = (8, 15)
RECESSION_RATE = 0.35
LENDING_MONTHS = 18
STRESS_AFTER = 12
STRESS = 1.5


def gen_loans(spark: SparkSession, n: int, seed: int = 42, kind: str = "regime",
              n_features: int | None = None, num_partitions: int = 8) -> DataFrame:
    """kind='regime' (#5): 24 months, label redrawn as Bernoulli(0.35) in months 8-15.
    kind='stress' (#6): 18 months, label = U < y * 0.3 * stress, stress 1.5 after month 12."""
    if n <= 0:
        raise ValueError("n must be positive")
    base = spark.range(0, n, numPartitions=num_partitions)
    if kind == "regime":
        k = n_features or 50
        feats = [F.randn(seed + i).alias(f"feature_{i}") for i in range(k)]
        df = base.select("id", *feats, F.floor(F.rand(seed + 1000) * HOME_MONTHS).cast("int").alias("APPLICATION_MONTH"))
        score = sum((F.col(f"feature_{i}") * F.lit(1.0 / (i + 1)) for i in range(min(k, 5))), F.lit(0.0))
        y0 = (F.rand(seed + 1001) < F.lit(1.0) / (F.lit(1.0) + F.exp(-score))).cast("int")
        rec = F.col("APPLICATION_MONTH").between(*RECESSION)
        y = F.when(rec, (F.rand(seed + 1002) < F.lit(RECESSION_RATE)).cast("int")).otherwise(y0)
        return df.withColumn("TARGET", y)
    if kind == "stress":
        k = n_features or 40
        feats = [F.randn(seed + i).alias(f"feature_{i}") for i in range(k)]
        df = base.select("id", *feats, F.floor(F.rand(seed + 2000) * LENDING_MONTHS).cast("int").alias("ISSUE_MONTH"))
        score = sum((F.col(f"feature_{i}") * F.lit(1.0 / (i + 1)) for i in range(min(k, 5))), F.lit(0.0))
        y = (F.rand(seed + 2001) < F.lit(1.0) / (F.lit(1.0) + F.exp(-score))).cast("double")
        stress = F.when(F.col("ISSUE_MONTH") > STRESS_AFTER, F.lit(STRESS)).otherwise(F.lit(1.0))
        lab = (F.rand(seed + 2002) < y * F.lit(0.3) * stress).cast("int")
        return df.withColumn("loan_status", lab)
    raise ValueError("kind must be 'regime' or 'stress'")
