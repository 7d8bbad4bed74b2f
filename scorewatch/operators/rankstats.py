"""Score-count tables and distributed prefix sums (#66, #67, #81, #88).

Rank statistics (ROC AUC, average precision, ROC/PR points, KS) need running
sums over values in sorted order. A window `partitionBy(group).orderBy(x)` on
raw rows sends a whole group to one task, and with no group it is a single
task for the whole table. Instead:

1. pre-aggregate to one row per (group, distinct value) (map-side partial
   aggregation does most of the work);
2. cut each group's value range into `buckets` ordered buckets, by default at the
   quantiles of a mergeable sketch (any cut is correct; quantiles only balance it);
3. bucket totals (groups x buckets rows) give per-bucket offsets through a
   window over that small table;
4. the running sum is a window partitioned by (group, bucket) plus the offset.

A group that holds a third of all rows is spread over `buckets` tasks and a
single hot value is one row after step 1. Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Cut count for the ordered buckets: a parameter; None takes the session's number of
# shuffle partitions, so each (group, bucket) window is about one task's share.
DEFAULT_BUCKETS = None


def checked_label(label: str):
    """The label; any value but 0 and 1 (NULL too) is an error when the rows are read."""
    y = F.col(label)
    return F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit(f"{label} must be 0 or 1, not "), F.coalesce(y.cast("string"), F.lit("NULL")))))


def checked_score(score: str):
    """The score as double; NaN, infinite and out-of-range values are an error. NULL: not scored."""
    p = F.col(score).cast("double")
    return F.when(p.isNull() | ((p >= 0) & (p <= 1)), p).otherwise(F.raise_error(F.concat(F.lit(f"{score} must lie in [0, 1], not "), p.cast("string"))))


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str,
                 weight: str | None = None) -> DataFrame:
    """(by..., score, pos, neg[, pos_n, neg_n]): label-1 and label-0 totals per distinct score.

    Unweighted counts are exact longs; weighted ones are double sums, and then
    the unweighted counts come along as pos_n / neg_n.
    """
    df = df.select(*by, checked_score(score).alias(score), checked_label(label).cast("int").alias(label), *([weight] if weight else []))
    y = F.col(label)
    one, zero = F.when(y == 1, F.lit(1)).otherwise(F.lit(0)), F.when(y == 0, F.lit(1)).otherwise(F.lit(0))
    if weight is None:
        aggs = [F.sum(one).cast("bigint").alias("pos"), F.sum(zero).cast("bigint").alias("neg")]
    else:
        w = F.col(weight).cast("double")
        aggs = [F.sum(F.when(y == 1, w).otherwise(F.lit(0.0))).alias("pos"),
                F.sum(F.when(y == 0, w).otherwise(F.lit(0.0))).alias("neg"),
                F.sum(one).cast("bigint").alias("pos_n"), F.sum(zero).cast("bigint").alias("neg_n")]
    return df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(*aggs)


def bounds_below(bounds, x, most: int):
    """How many of the rising `bounds` (at most `most`) lie below x: first in steps of about the root of
    `most`, then inside one step."""
    step = max(1, math.isqrt(most))
    every = F.transform(F.sequence(F.lit(step), F.lit(max(step, most)), F.lit(step)), lambda i: F.get(bounds, i - 1))
    whole = F.size(F.filter(every, lambda v: v < x))
    return (whole * step + F.size(F.filter(F.slice(bounds, whole * step + 1, step), lambda v: v < x))).cast("int")


def bucketed(counts: DataFrame, by: Sequence[str], order: str, buckets: int, bucketing: str) -> DataFrame:
    """`counts` with `_bucket`, ordered like `order` within a group (see `prefix_sums`)."""
    by = list(by)
    x = F.col(order).cast("double")
    if bucketing == "given":
        return counts
    if bucketing == "unit":
        # values in [0, 1] (probabilities): fixed cut points, no pre-pass
        c2 = counts.withColumn("_bucket", F.least(F.greatest(F.floor(x * F.lit(buckets)), F.lit(0)),
                                                  F.lit(buckets - 1)).cast("int"))
    elif bucketing == "range":
        # equal-width cut of each group's [min, max]: one cheap aggregate (groups rows)
        if by:
            rng = counts.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
            c2 = counts.join(rng, by)
            lo, hi = F.col("_lo"), F.col("_hi")
        else:
            r = counts.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
            c2 = counts
            lo, hi = F.lit(r["lo"]).cast("double"), F.lit(r["hi"]).cast("double")
        width = F.when(hi > lo, (hi - lo) / F.lit(buckets))
        b = F.coalesce(F.floor((x - lo) / width), F.lit(0))
        c2 = c2.withColumn("_bucket", F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int"))
        if by:
            c2 = c2.drop("_lo", "_hi")
    elif bucketing == "quantile":
        # A mergeable quantile sketch per group: whatever the values, buckets hold about as many rows each.
        fracs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        sketch = F.kll_sketch_agg_double(x, F.lit(min(4096, max(200, 4 * buckets))))
        bounds = counts.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(sketch.alias("_sketch")).select(
            *by, F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("_sketch", fracs))).alias("_bounds"))
        if by:
            c2 = counts.join(bounds, by, "left")
            at = F.coalesce(F.col("_bounds"), F.array().cast("array<double>"))
        else:
            r = bounds.first()
            at = F.array(*[F.lit(float(v)) for v in (r["_bounds"] if r else None) or []]).cast("array<double>")
            c2 = counts
        c2 = c2.withColumn("_bucket", bounds_below(at, x, buckets)).drop("_bounds")
    else:
        raise ValueError("bucketing must be 'unit', 'range', 'quantile' or 'given'")
    return c2


def prefix_sums(counts: DataFrame, by: Sequence[str], order: str, cols: Sequence[str],
                buckets: int | None = DEFAULT_BUCKETS, bucketing: str = "range", checkpoint: bool = False) -> DataFrame:
    """Add `<c>_below` (sum over strictly smaller `order` in the same group) and
    `<c>_total` for each c in cols. `order` must be distinct within a group.

    buckets <= 1 falls back to a plain window partitioned by `by` (fine when
    there are many small groups). Any monotone bucket function is exact; the
    choice only affects balance:
      unit      floor(x * buckets) clipped; for probabilities, no pre-pass
      range     equal-width over each group's [min, max]; one cheap aggregate
      quantile  quantiles of a sketch per group; balanced for any distribution, one aggregate
      given     the column `_bucket` of `counts`
    """
    by = list(by)
    if buckets is None:
        buckets = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets <= 1:
        wb = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        wt = Window.partitionBy(*by)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(c).over(wb), F.lit(0)).alias(f"{c}_below") for c in cols],
            *[F.sum(c).over(wt).alias(f"{c}_total") for c in cols],
        )

    # The pre-aggregated table is read three or four times below (cut points,
    # bucket totals, the running window). With checkpoint=True it is written
    # once as a table in the shared checkpoint folder, so an expensive upstream
    # (joins, wide unpivots) runs once instead of once per branch; off by
    # default because for cheap upstreams the extra write costs more (measured).
    if checkpoint:
        from scorewatch.session import cut_lineage

        counts = cut_lineage(counts, "prefix-counts")
    c2 = bucketed(counts, by, order, buckets, bucketing)
    if bucketing == "quantile":  # sketches are random: every branch below must see the same cut
        from scorewatch.session import cut_lineage

        c2 = cut_lineage(c2, "prefix-ranges")
    bt = c2.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_{c}_bt") for c in cols])
    wo = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    offsets = bt.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_{c}_bt").over(wo), F.lit(0)).alias(f"_{c}_off") for c in cols],
        *[F.sum(f"_{c}_bt").over(wall).alias(f"{c}_total") for c in cols],
    )
    wb = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = c2.join(offsets, [*by, "_bucket"]).select(
        *[F.col(c) for c in counts.columns],
        *[(F.coalesce(F.sum(c).over(wb), F.lit(0)) + F.col(f"_{c}_off")).alias(f"{c}_below") for c in cols],
        *[F.col(f"{c}_total") for c in cols],
    )
    return out


def ranked_scores(df: DataFrame, by: Sequence[str], score: str, label: str,
                  weight: str | None = None, buckets: int | None = DEFAULT_BUCKETS,
                  bucketing: str = "unit") -> DataFrame:
    """Score-count table with pos/neg prefix sums and totals (scores are probabilities)."""
    return prefix_sums(score_counts(df, by, score, label, weight), by, score, ["pos", "neg"],
                       buckets, bucketing)


def _exact(c):
    return F.col(c).cast("decimal(38,0)")


def auc_terms(ranked: DataFrame, by: Sequence[str], weighted: bool = False) -> DataFrame:
    """(by..., auc_roc, auc_pr, n_pos, n_neg) from a ranked score table.

    AUC = sum pos*(neg_below + neg/2) / (P*N), ties count one half.
    AP  = sum over distinct scores of (pos/P) * precision at that score, where
          precision = pos_at_or_above / all_at_or_above (step sum, not trapezoid).
    Unweighted AUC uses exact decimal integers.
    """
    if weighted:
        num = F.sum(F.col("pos") * (F.lit(2.0) * F.col("neg_below") + F.col("neg")))
        den = F.lit(2.0) * F.max("pos_total") * F.max("neg_total")
        auc = F.try_divide(num, den)
    else:
        num = F.sum(_exact("pos") * (_exact("neg_below") * F.lit(2) + _exact("neg")))
        den = F.lit(2.0) * F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
        auc = F.try_divide(num.cast("double"), den)
    pos_ge = F.col("pos_total") - F.col("pos_below")
    all_ge = pos_ge + F.col("neg_total") - F.col("neg_below")
    ap = F.try_divide(
        F.sum(F.col("pos").cast("double") * F.try_divide(pos_ge.cast("double"), all_ge.cast("double"))),
        F.max("pos_total").cast("double"))
    return ranked.groupBy(*by).agg(
        auc.alias("auc_roc"), ap.alias("auc_pr"),
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))


def auc_roc(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
            weight: str | None = None, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#66/#67: exact ROC AUC and average precision per group. Single-class group -> NULL."""
    r = ranked_scores(df, by, prob, label, weight, buckets)
    return auc_terms(r, by, weighted=weight is not None)


def curve_points(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                 buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#81: ROC and PR points, one per distinct score used as threshold (score >= t).

    Columns: by..., threshold, tp, fp, tpr, fpr, precision, recall.
    """
    r = ranked_scores(df, by, prob, label, None, buckets)
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    return r.select(
        *by, F.col(prob).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        F.try_divide(tp.cast("double"), F.col("pos_total").cast("double")).alias("recall"),
    )


def two_sample_cdf(long_df: DataFrame, by: Sequence[str], value: str, is_b: str,
                   buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#88: empirical CDFs of two samples at every distinct value.

    Input is long: (by..., value, is_b) with is_b true for sample B. Output:
    by..., value, cdf_a, cdf_b, n_a, n_b (cdf = share of the sample <= value).
    """
    counts = (long_df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(~F.col(is_b)).alias("ca"), F.count_if(F.col(is_b)).alias("cb")))
    r = prefix_sums(counts, by, value, ["ca", "cb"], buckets, "quantile")
    return r.select(
        *by, value,
        F.try_divide((F.col("ca_below") + F.col("ca")).cast("double"), F.col("ca_total").cast("double")).alias("cdf_a"),
        F.try_divide((F.col("cb_below") + F.col("cb")).cast("double"), F.col("cb_total").cast("double")).alias("cdf_b"),
        F.col("ca_total").alias("n_a"), F.col("cb_total").alias("n_b"),
    )
