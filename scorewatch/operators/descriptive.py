"""Descriptive aggregates and row-level scoring outputs (#4, #15, #16, #39, #58-65)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorewatch.functions.columns import classify, recommendation, risk_band
from scorewatch.operators.splits import mix_key

# fixed values (must equal the original's): role rules and name keywords
LABEL_NAME_PARTS = ("target", "loan_status", "default")
TEMPORAL_NAME_PARTS = ("month", "date", "time", "day")
NUMERIC_DISTINCT_SHARE = 0.05
NUMERIC_DISTINCT_MIN = 50
NAME_WEIGHTS = ((1.5, ("time", "month", "trend", "quarter")), (1.3, ("risk", "ratio", "utilization")))


def monthly_rates(df: DataFrame, period: str, label: str, amount: str | None = None) -> DataFrame:
    """#58/#59/#60: per period default rate, volume and mean amount."""
    aggs = [F.count(F.lit(1)).alias("volume"), F.avg(F.col(label).cast("double")).alias("default_rate")]
    if amount:
        aggs.append(F.avg(amount).alias("mean_amount"))
    return df.groupBy(period).agg(*aggs)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """#62: rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.1) -> DataFrame:
    """#63: per column NULL count and share (one aggregate pass), flag share > threshold."""
    cols = list(columns or df.columns)
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = a.selectExpr("_n", f"stack({len(cols)}, {parts}) AS (column, missing)")
    share = F.try_divide(F.col("missing").cast("double"), F.col("_n").cast("double"))
    return long.select("column", "missing", share.alias("missing_share"), (share > F.lit(threshold)).alias("high_missing"))


def density_histogram(df: DataFrame, value: str, band: str, bins: int = 30) -> DataFrame:
    """#61: density histogram per band on `bins` equal bins over the global range:
    density = count / (n_band * width)."""
    from scorewatch.functions.columns import edge_bin

    rng = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = float(rng["lo"]), float(rng["hi"])
    step = (hi - lo) / bins
    b = df.select(band, edge_bin(value, lo, step, bins, hi).alias("bin"))
    c = b.where(F.col("bin").isNotNull()).groupBy(band, "bin").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(band)  # <= bins rows per band
    return c.select(band, "bin", "count",
                    (F.col("count") / (F.sum("count").over(w) * F.lit(step))).alias("density"))


def band_counts(scored: DataFrame, prob: str) -> DataFrame:
    """#65: counts per risk band and per recommendation in one pass (grouping sets)."""
    s = scored.select(risk_band(prob).alias("risk_band"), recommendation(prob).alias("recommendation"))
    return s.groupingSets([["risk_band"], ["recommendation"]], "risk_band", "recommendation").agg(
        F.count(F.lit(1)).alias("count"))


def score_output(df: DataFrame, prob: str, keep: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """#7/#8/#18-20: predicted class, risk band and recommendation next to the probability."""
    return df.select(*keep, F.col(prob).alias("predicted_proba"),
                     classify(prob, threshold).alias("predicted_class"),
                     risk_band(prob).alias("risk_band"),
                     recommendation(prob).alias("recommendation"))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42, bucket_bits: int = 16) -> DataFrame:
    """#4: exactly min(n, rows) rows, repeatable, without replacement.

    Rows are ranked by a seeded integer mix of the key. Instead of one global
    top-n (which would pull n rows into a single task), bucket counts of the
    mix's high bits (at most 2^bucket_bits small rows) locate the cut bucket;
    rows in lower buckets are kept outright and only the cut bucket is ranked,
    by a window partitioned by that bucket.
    """
    if n is None or n <= 0:
        raise ValueError("sample_size must be positive")
    shift = 31 - bucket_bits
    d = df.withColumn("_mix", mix_key(key, seed)).withColumn("_b", F.shiftright("_mix", shift))
    counts = sorted((r["_b"], r["c"]) for r in d.groupBy("_b").agg(F.count(F.lit(1)).alias("c")).collect())
    acc, cut, need = 0, None, 0
    for b, c in counts:
        if acc + c >= n:
            cut, need = b, n - acc
            break
        acc += c
    if cut is None:
        return df
    w = Window.partitionBy("_b").orderBy("_mix", key)
    inside = d.where(F.col("_b") == cut).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need)
    below = d.where(F.col("_b") < cut)
    return below.drop("_mix", "_b").unionByName(inside.drop("_mix", "_b", "_rn"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, dv, sv, n): rows per distinct value of every column, in one job.

    Numeric columns are unpivoted as doubles (dv), the others as strings (sv),
    so no value is formatted to text; the unpivot feeds a grouped count
    directly (partial aggregation map-side). NULL is one value (dv and sv NULL).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in columns if isinstance(types[c], NumericType)]
    oth = [c for c in columns if c not in set(num)]
    parts = []
    if num:
        e = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in num)
        parts.append(df.selectExpr(f"stack({len(num)}, {e}) AS (column, dv)")
                     .withColumn("dv", F.nanvl(F.col("dv"), F.lit(None).cast("double")))  # NaN is missing
                     .withColumn("sv", F.lit(None).cast("string")))
    if oth:
        e = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in oth)
        parts.append(df.selectExpr(f"stack({len(oth)}, {e}) AS (column, sv)").withColumn("dv", F.lit(None).cast("double")))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return long.groupBy("column", "dv", "sv").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, rows, top_share): exact distinct non-NULL values, rows, and
    the share of the most frequent value (NULL counted as a value) - one shuffle job."""
    vc = value_counts(df, columns)
    return vc.groupBy("column").agg(
        F.count_if(F.col("dv").isNotNull() | F.col("sv").isNotNull()).alias("distinct"),
        F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("top_share"))


def role_of(name: str, numeric_type: bool, distinct: int, rows: int) -> str:
    """#15 rule for one column (driver-side twin of the `column_roles` expression)."""
    ln = name.lower()
    if any(p in ln for p in LABEL_NAME_PARTS):
        return "label"
    if any(p in ln for p in TEMPORAL_NAME_PARTS):
        return "temporal"
    many = (rows and distinct / rows > NUMERIC_DISTINCT_SHARE) or distinct > NUMERIC_DISTINCT_MIN
    return "numeric" if numeric_type and many else "categorical"


def column_roles(df: DataFrame, exclude: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """#15: (column, distinct, rows, role) for every column in one aggregate.

    Rules: names containing a label word are skipped; temporal if the name
    has month/date/time/day; numeric if a numeric type and (distinct/rows >
    0.05 or distinct > 50); else categorical.
    """
    cols = [c for c in df.columns if c not in set(exclude)]
    if approx:
        a = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(F.col(c)).alias(c) for c in cols])
        parts = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
        long = a.selectExpr("_rows AS rows", f"stack({len(cols)}, {parts}) AS (column, distinct)")
    else:
        long = column_profile(df, cols).select("column", F.col("distinct").cast("bigint").alias("distinct"),
                                              F.col("rows").cast("bigint").alias("rows"))
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    lname = F.lower(F.col("column"))
    is_label = F.lit(False)
    for part in LABEL_NAME_PARTS:
        is_label = is_label | lname.contains(part)
    is_temporal = F.lit(False)
    for part in TEMPORAL_NAME_PARTS:
        is_temporal = is_temporal | lname.contains(part)
    is_num_type = F.col("column").isin(*numeric) if numeric else F.lit(False)
    many = (F.try_divide(F.col("distinct").cast("double"), F.col("rows").cast("double")) > F.lit(NUMERIC_DISTINCT_SHARE)) \
        | (F.col("distinct") > F.lit(NUMERIC_DISTINCT_MIN))
    role = (F.when(is_label, F.lit("label")).when(is_temporal, F.lit("temporal"))
            .when(is_num_type & many, F.lit("numeric")).otherwise(F.lit("categorical")))
    return long.select("column", "distinct", "rows", role.alias("role"))


def align_columns(df: DataFrame, fitted: Sequence[str], strict: bool = False) -> DataFrame:
    """#16: select the fitted column list in order; missing -> 0, extra dropped."""
    have = set(df.columns)
    missing = [c for c in fitted if c not in have]
    if strict and missing:
        raise KeyError(f"Missing columns: {missing}")
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in fitted])


def name_weights(columns: Sequence[str]):
    """#39: weight per column name: 1.5 time words, 1.3 risk words, else 1.0 (first match)."""
    out = []
    for c in columns:
        lc = c.lower()
        w = 1.0
        for weight, words in NAME_WEIGHTS:
            if any(x in lc for x in words):
                w = weight
                break
        out.append((c, w))
    return out


def name_weight_expr(name_col):
    lname = F.lower(name_col)
    out = F.lit(1.0)
    for weight, words in reversed(NAME_WEIGHTS):
        cond = F.lit(False)
        for x in words:
            cond = cond | lname.contains(x)
        out = F.when(cond, F.lit(weight)).otherwise(out)
    return out
