"""Drift statistics (#53, #54, #88, #90-106), all features in one job.

Samples are compared in long form: every feature column is unpivoted to
(feature, value) and tagged with the sample it came from. The unpivot is
followed directly by a grouped count (map-side partial aggregation), so
what is shuffled is one row per (feature, distinct value / bin), not the
wide table times the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorewatch.functions.columns import (
    chi2_sf, drift_level, edge_bin, ks_pvalue, lin_edges, with_edge_bin,
)
from scorewatch.operators.rankstats import DEFAULT_BUCKETS, checked_label, checked_score, prefix_sums
from scorewatch.session import cut_lineage

SIGNIFICANCE = 0.05
JS_THRESHOLD = 0.1
PSI_THRESHOLD = 0.25
JS_EDGES = 50
PRED_JS_EDGES = 21
CHI2_BINS = 10
CHI2_MAX_BINS = 1000  # the p-value's series has converged up to here
PSI_FLOOR = 1e-4


def common_features(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """#53: features present in both frames (plan-time), in reference order."""
    cols = [c for c in ref.columns if c in set(cur.columns)]
    if features is not None:
        cols = [c for c in features if c in set(cols)]
    return cols


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with every feature cast to double; NaN becomes NULL."""
    if not features:
        raise ValueError("no features to compare")
    parts = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    out = df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(features)}, {parts}) AS (feature, value)")
    return out.withColumn("value", F.nanvl(F.col("value"), F.lit(None).cast("double")))


def tagged_long(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, is_cur) over both samples."""
    return (unpivot(ref, features).withColumn("is_cur", F.lit(False))
            .unionByName(unpivot(cur, features).withColumn("is_cur", F.lit(True))))


def value_ranges(long: DataFrame) -> dict[str, tuple[float, float]]:
    """{feature: (min, max)} of a long frame: one row per feature, bounded by the schema."""
    rows = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    return {r["feature"]: (r["lo"], r["hi"]) for r in rows}


def with_ranges(long: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Add `lo` and `hi` as literals of each row's feature: no join on a handful of hot keys.
    Rows of features without a spread are left out."""
    wide = {f: r for f, r in ranges.items() if r[0] is not None and r[1] > r[0]}
    lo = hi = F.lit(None).cast("double")
    for f, (a, b) in wide.items():
        lo = F.when(F.col("feature") == f, F.lit(float(a))).otherwise(lo)
        hi = F.when(F.col("feature") == f, F.lit(float(b))).otherwise(hi)
    return long.withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi").isNotNull())


def split_frame(df: DataFrame, is_cur: str | Column) -> tuple[DataFrame, DataFrame]:
    c = F.col(is_cur) if isinstance(is_cur, str) else is_cur
    return df.where(~c), df.where(c)


# ---------------------------------------------------------------- KS ----------

def ecdf(ref: DataFrame, cur: DataFrame, features: Sequence[str],
         buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#88: both empirical CDFs at every distinct value of the union, per feature."""
    long = tagged_long(ref, cur, features)
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(~F.col("is_cur")).alias("c_ref"), F.count_if(F.col("is_cur")).alias("c_cur"))
    return _ecdf_of_counts(counts, buckets)


def _ecdf_of_counts(counts: DataFrame, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    r = prefix_sums(counts, ["feature"], "value", ["c_ref", "c_cur"], buckets, "quantile")
    return r.select(
        "feature", "value",
        F.try_divide((F.col("c_ref_below") + F.col("c_ref")).cast("double"), F.col("c_ref_total").cast("double")).alias("cdf_ref"),
        F.try_divide((F.col("c_cur_below") + F.col("c_cur")).cast("double"), F.col("c_cur_total").cast("double")).alias("cdf_cur"),
        F.col("c_ref_total").alias("n_ref"), F.col("c_cur_total").alias("n_cur"),
    )


def ks_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
             alpha: float = SIGNIFICANCE, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#90/#91: two-sample KS per feature: statistic D, p_value, is_drift = p < alpha.

    NULL values are skipped (n_ref / n_cur count the non-NULL ones).
    """
    feats = common_features(ref, cur, features)
    return _ks_of_ecdf(ecdf(ref, cur, feats, buckets), alpha)


def _ks_of_ecdf(e: DataFrame, alpha: float) -> DataFrame:
    d = e.groupBy("feature").agg(
        F.max(F.abs(F.col("cdf_ref") - F.col("cdf_cur"))).alias("statistic"),
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
    p = ks_pvalue("statistic", "n_ref", "n_cur")
    return d.select("feature", "statistic", p.alias("p_value"), (p < F.lit(alpha)).alias("is_drift"),
                    "n_ref", "n_cur")


def ks_by_group(ref: DataFrame, cur: DataFrame, features: Sequence[str], group: Sequence[str],
                alpha: float = SIGNIFICANCE, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """KS of every group of `cur` (e.g. each period) against one reference, in one job.

    The reference CDF is computed once at every distinct value of the union;
    each group's rows look up F_ref(v) and F_ref(v-) at their own values by an
    equi-join on (feature, value). D_g = max over the group's values of
    max(|F_ref(v) - F_g(v)|, |F_ref(v-) - F_g(v-)|), which equals the supremum
    because both CDFs are step functions. The reference is never copied per group.
    """
    group = list(group)
    rl = unpivot(ref, features).where(F.col("value").isNotNull())
    cl = unpivot(cur, features, keep=group).where(F.col("value").isNotNull())
    ref_c = rl.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c_ref"))
    cur_c = cl.groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("c_g"))
    vals = (ref_c.unionByName(cur_c.select("feature", "value", F.lit(0).cast("bigint").alias("c_ref")))
            .groupBy("feature", "value").agg(F.sum("c_ref").alias("c_ref")))
    rv = prefix_sums(vals, ["feature"], "value", ["c_ref"], buckets, "quantile").select(
        "feature", "value",
        (F.col("c_ref_below") + F.col("c_ref")).alias("r_le"), F.col("c_ref_below").alias("r_lt"),
        F.col("c_ref_total").alias("n_ref"))
    g = prefix_sums(cur_c, [*group, "feature"], "value", ["c_g"], buckets, "quantile")
    j = g.join(rv, ["feature", "value"])
    nr, ng = F.col("n_ref").cast("double"), F.col("c_g_total").cast("double")
    fr_le, fr_lt = F.col("r_le") / nr, F.col("r_lt") / nr
    fg_le, fg_lt = (F.col("c_g_below") + F.col("c_g")) / ng, F.col("c_g_below") / ng
    gap = F.greatest(F.abs(fr_le - fg_le), F.abs(fr_lt - fg_lt))
    d = j.groupBy(*group, "feature").agg(F.max(gap).alias("statistic"), F.max("n_ref").alias("n_ref"),
                                         F.max("c_g_total").alias("n_cur"))
    p = ks_pvalue("statistic", "n_ref", "n_cur")
    return d.select(*group, "feature", "statistic", p.alias("p_value"), (p < F.lit(alpha)).alias("is_drift"),
                    "n_ref", "n_cur")


# ---------------------------------------------------------------- JS ----------

def _js_from_probs(pcol: str, qcol: str, by: Sequence[str]) -> tuple[Column, ...]:
    """(distance, divergence) aggregates from per-bin probabilities p, q (natural log)."""
    p, q = F.col(pcol), F.col(qcol)
    m = (p + q) / F.lit(2.0)
    rel = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    div = (F.sum(rel(p)) + F.sum(rel(q))) / F.lit(2.0)
    return F.sqrt(div), div


def js_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
             edges: int = JS_EDGES, threshold: float = JS_THRESHOLD) -> DataFrame:
    """#92: Jensen-Shannon distance per feature on `edges-1` equal bins over the
    joint [min, max] (bins [e_i, e_{i+1}), last closed), natural log, square root.

    is_drift = distance > threshold. A constant feature (min = max) gets NULL.
    """
    feats = common_features(ref, cur, features)
    counts = tagged_long(ref, cur, feats).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(~F.col("is_cur")).alias("c_ref"), F.count_if(F.col("is_cur")).alias("c_cur"))
    return js_of_counts(cut_lineage(counts, "value-counts"), ["feature"], edges, threshold)


def prediction_js(ref: DataFrame, cur: DataFrame, prob: str = "prob", edges: int = PRED_JS_EDGES,
                  threshold: float = JS_THRESHOLD, smoothing: float = 1e-10) -> DataFrame:
    """#97: JS distance of prediction histograms on fixed bins over [0, 1]
    (densities + smoothing, then normalised), plus the mean shift."""
    e = lin_edges(0.0, 1.0, edges)
    nb = edges - 1
    widths = [e[i + 1] - e[i] for i in range(nb)]
    both = (ref.select(F.col(prob).alias("v"), F.lit(False).alias("is_cur"))
            .unionByName(cur.select(F.col(prob).alias("v"), F.lit(True).alias("is_cur"))))
    binned = both.withColumn("bin", edge_bin("v", 0.0, e[1] - e[0], nb, 1.0))
    tot = binned.agg(
        *[F.count_if(~F.col("is_cur") & (F.col("bin") == i)).alias(f"r{i}") for i in range(nb)],
        *[F.count_if(F.col("is_cur") & (F.col("bin") == i)).alias(f"c{i}") for i in range(nb)],
        F.count_if(~F.col("is_cur") & F.col("v").isNotNull()).alias("nr"),
        F.count_if(F.col("is_cur") & F.col("v").isNotNull()).alias("nc"),
        F.avg(F.when(~F.col("is_cur"), F.col("v"))).alias("mr"),
        F.avg(F.when(F.col("is_cur"), F.col("v"))).alias("mc"),
    )
    # densities count/(n_in * width) + smoothing, normalised, then JS; array
    # expressions keep the plan linear in the number of bins
    wid = F.array(*[F.lit(float(w)) for w in widths])
    r = F.array(*[F.col(f"r{i}").cast("double") for i in range(nb)])
    c = F.array(*[F.col(f"c{i}").cast("double") for i in range(nb)])
    add = lambda acc, x: acc + x
    st = (tot.select(r.alias("r"), c.alias("c"), "mr", "mc")
          .withColumn("inr", F.aggregate("r", F.lit(0.0), add))
          .withColumn("inc", F.aggregate("c", F.lit(0.0), add))
          .withColumn("dr", F.zip_with("r", wid, lambda x, w: x / (F.col("inr") * w) + F.lit(smoothing)))
          .withColumn("dc", F.zip_with("c", wid, lambda x, w: x / (F.col("inc") * w) + F.lit(smoothing)))
          .withColumn("sr", F.aggregate("dr", F.lit(0.0), add))
          .withColumn("sc", F.aggregate("dc", F.lit(0.0), add))
          .withColumn("p", F.transform("dr", lambda x: x / F.col("sr")))
          .withColumn("q", F.transform("dc", lambda x: x / F.col("sc")))
          .withColumn("t", F.zip_with("p", "q", lambda a, b: a * F.ln(a / ((a + b) / F.lit(2.0)))
                                      + b * F.ln(b / ((a + b) / F.lit(2.0)))))
          .withColumn("js", F.sqrt(F.aggregate("t", F.lit(0.0), add) / F.lit(2.0))))
    return st.select(
        F.col("js").alias("js_divergence"),
        (F.col("js") > F.lit(threshold)).alias("drift_detected"),
        (F.col("mc") - F.col("mr")).alias("prediction_shift"))


# ------------------------------------------------------ chi-square / PSI ------

def _ref_binned(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """(feature, bin, c_ref, c_cur) on `bins` equal-width bins of the *reference* range
    (right-closed, lowest edge lowered by 0.1% of the range); values of the current
    sample beyond the outer edges go to the outer bins."""
    long = tagged_long(ref, cur, features).where(F.col("value").isNotNull())
    ranges = value_ranges(long.where(~F.col("is_cur")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    x = F.col("value")
    # bin k covers (lo + k*w, lo + (k+1)*w]; outer bins are open-ended
    raw = F.ceil((x - F.col("lo")) / width).cast("int") - 1
    b = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    binned = with_ranges(long, ranges).withColumn("bin", b)
    return binned.groupBy("feature", "bin").agg(
        F.count_if(~F.col("is_cur")).alias("c_ref"), F.count_if(F.col("is_cur")).alias("c_cur"))


def chi2_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
               bins: int = CHI2_BINS, alpha: float = SIGNIFICANCE) -> DataFrame:
    """#93 (repaired): chi-square goodness of fit of the current bin counts against
    the reference shares on shared reference bins. expected = ref share x n_cur;
    statistic = sum over bins with expected > 0 of (o - e)^2 / e; dof = such bins - 1."""
    if not 2 <= bins <= CHI2_MAX_BINS:
        raise ValueError(f"bins must lie in 2..{CHI2_MAX_BINS}")
    feats = common_features(ref, cur, features)
    c = _ref_binned(ref, cur, feats, bins)
    w = Window.partitionBy("feature")  # <= bins rows per feature
    e = c.select("feature", "bin", F.col("c_cur").cast("double").alias("o"),
                 (F.col("c_ref") / F.sum("c_ref").over(w) * F.sum("c_cur").over(w)).alias("e"))
    s = e.where(F.col("e") > 0).groupBy("feature").agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("dof"))
    p = chi2_sf("statistic", "dof")
    return s.select("feature", "statistic", "dof", p.alias("p_value"), (p < F.lit(alpha)).alias("is_drift"))


def psi_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
              bins: int = CHI2_BINS, threshold: float = PSI_THRESHOLD, floor: float = PSI_FLOOR) -> DataFrame:
    """#106: population stability index sum (a - e) * ln(a / e) on reference bins;
    shares are floored at `floor` so empty bins stay finite. is_drift = psi > threshold."""
    feats = common_features(ref, cur, features)
    c = _ref_binned(ref, cur, feats, bins)
    w = Window.partitionBy("feature")
    a = F.greatest(F.col("c_cur") / F.sum("c_cur").over(w), F.lit(floor))
    e = F.greatest(F.col("c_ref") / F.sum("c_ref").over(w), F.lit(floor))
    t = c.select("feature", ((a - e) * F.ln(a / e)).alias("t"))
    s = t.groupBy("feature").agg(F.sum("t").alias("psi"))
    return s.select("feature", "psi", (F.col("psi") > F.lit(threshold)).alias("is_drift"))


def bin_align(ref_hist: DataFrame, cur_hist: DataFrame, keys: Sequence[str] = ("feature", "bin")) -> DataFrame:
    """#54: align two histograms (keys..., count) over the union of bins, missing -> 0."""
    keys = list(keys)
    j = ref_hist.withColumnRenamed("count", "c_ref").join(
        cur_hist.withColumnRenamed("count", "c_cur"), keys, "full_outer")
    return j.select(*keys, F.coalesce("c_ref", F.lit(0)).alias("c_ref"), F.coalesce("c_cur", F.lit(0)).alias("c_cur"))


# ------------------------------------------------------ predictions -----------

def prediction_drift(ref: DataFrame, cur: DataFrame, prob: str = "prob", label: str | None = "label",
                     alpha: float = SIGNIFICANCE, auc_drop: float = 0.05) -> DataFrame:
    """#94-96: prediction KS, mean shift, and (with labels) AUC degradation ref - cur. The samples are read once, into
    a written table of how often each has each score and how many of those rows have label 1."""
    from scorewatch.operators.rankstats import auc_terms

    p = checked_score(prob) if label else F.col(prob).cast("double")
    y = checked_label(label).cast("bigint") if label else F.lit(0).cast("bigint")
    of = lambda df, flag: df.where(F.col(prob).isNotNull()).select(p.alias("value"), y.alias("y"), F.lit(flag).alias("is_cur"))
    counts = of(ref, False).unionByName(of(cur, True)).groupBy("is_cur", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    counts = cut_lineage(counts, "prediction-counts").withColumn("feature", F.lit("prob"))
    num = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    side = lambda flag: F.sum(F.when(F.col("is_cur") == flag, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    both = counts.withColumn("value", num).where("value IS NOT NULL").groupBy("feature", "value").agg(side(False).alias("c_ref"), side(True).alias("c_cur"))
    ks = _ks_of_ecdf(_ecdf_of_counts(both), alpha)
    mean = lambda flag: F.try_divide(F.sum(F.when(F.col("is_cur") == flag, F.col("value") * F.col("n"))), F.sum(F.when(F.col("is_cur") == flag, F.col("n"))))
    out = ks.join(counts.groupBy("feature").agg(mean(False).alias("mr"), mean(True).alias("mc")), "feature").select(
        F.col("statistic").alias("prediction_ks_statistic"),
        F.col("p_value").alias("prediction_ks_p_value"),
        F.col("is_drift").alias("prediction_drift"),
        (F.col("mc") - F.col("mr")).alias("mean_prediction_shift"),
        "feature",
    )
    if label:
        scores = counts.select("is_cur", F.col("value").alias("prob"), "pos", (F.col("n") - F.col("pos")).alias("neg"))
        a = auc_terms(prefix_sums(scores, ["is_cur"], "prob", ["pos", "neg"], None, "unit"), ["is_cur"]).groupBy().agg(
            F.max(F.when(~F.col("is_cur"), F.col("auc_roc"))).alias("ra"),
            F.max(F.when(F.col("is_cur"), F.col("auc_roc"))).alias("ca")).withColumn("feature", F.lit("prob"))
        out = out.join(a, "feature").select(
            *[cc for cc in out.columns if cc != "feature"],
            (F.col("ra") - F.col("ca")).alias("auc_degradation"),
            F.coalesce((F.col("ra") - F.col("ca")) > F.lit(auc_drop), F.lit(False)).alias("significant_auc_drop"))
    else:
        out = out.drop("feature")
    return out


# ------------------------------------------------------ summaries -------------

def drift_summary(ks: DataFrame, js: DataFrame) -> DataFrame:
    """#100: totals, counts and ratios for KS and JS (ratio 0 if no feature)."""
    k = ks.agg(F.count(F.lit(1)).alias("total_features"), F.count_if("is_drift").alias("ks_drift_count"))
    j = js.agg(F.count(F.lit(1)).alias("js_total"), F.count_if("is_drift").alias("js_drift_count"))
    u = k.withColumn("k", F.lit(1)).unionByName(j.withColumn("k", F.lit(1)), allowMissingColumns=True)
    m = u.groupBy().agg(*[F.max(c).alias(c) for c in ("total_features", "ks_drift_count", "js_total", "js_drift_count")])
    return m.select(
        "total_features", "ks_drift_count", "js_drift_count",
        F.coalesce(F.try_divide(F.col("ks_drift_count").cast("double"), F.col("total_features").cast("double")), F.lit(0.0)).alias("ks_drift_ratio"),
        F.coalesce(F.try_divide(F.col("js_drift_count").cast("double"), F.col("js_total").cast("double")), F.lit(0.0)).alias("js_drift_ratio"),
    )


def overall_drift_score(ks_ratio, js_ratio, pred_drift) -> Column:
    """#101: 0.7 * max(ks_ratio, js_ratio) + 0.3 * (prediction drift ? 1 : 0)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.lit(0.7) * F.greatest(c(ks_ratio), c(js_ratio)) + F.lit(0.3) * F.when(c(pred_drift), F.lit(1.0)).otherwise(F.lit(0.0))


# fixed values (must equal the original's): recommendation texts in order
REC_RETRAIN = "HIGH DRIFT DETECTED: Consider immediate model retraining"
REC_REVIEW = "Significant feature drift detected: Review data pipeline and feature engineering"
REC_RECALIBRATE = "Prediction distribution has shifted: Model recalibration recommended"
REC_URGENT = "Model performance has significantly degraded: Urgent retraining required"
REC_CONTINUE = "No significant drift detected: Continue monitoring"


def recommendations(score, ks_ratio, pred_drift, auc_deg) -> Column:
    """#103: list of advice strings; the 'continue' line when nothing fires."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    arr = F.array(
        F.when(c(score) > F.lit(0.3), F.lit(REC_RETRAIN)),
        F.when(c(ks_ratio) > F.lit(0.2), F.lit(REC_REVIEW)),
        F.when(c(pred_drift), F.lit(REC_RECALIBRATE)),
        F.when(F.coalesce(c(auc_deg), F.lit(0.0)) > F.lit(0.05), F.lit(REC_URGENT)),
    )
    fired = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.size(fired) == 0, F.array(F.lit(REC_CONTINUE))).otherwise(fired)


#: Metrics that a report compares between the two samples.
COMPARED = ("auc_roc", "auc_pr", "precision", "recall", "f1_score", "accuracy", "specificity", "sensitivity", "false_positive_rate",
            "brier_score", "log_loss", "calibration_error", "optimal_threshold", "max_profit", "profit_at_05_threshold",
            "approval_rate_optimal", "default_rate_if_all_approved")


PREDICTION = "__prediction__"


def sample_columns(df: DataFrame, sample: str, samples: Sequence[object], features: Sequence[str], prob: str, label: str | None) -> DataFrame:
    """(feature, value, n0, pos0, n1, pos1, ...): how often each of `samples` has each value of each feature and of the
    prediction, and how many of those rows have label 1. Written once: whatever a report says is a
    function of these counts."""
    y = checked_label(label).cast("bigint") if label else F.lit(0).cast("bigint")
    wide = df.select(F.col(sample).alias("_s"), y.alias("_y"), *[F.col(f"`{f}`") for f in features], checked_score(prob).alias(PREDICTION))
    long = unpivot(wide, [*features, PREDICTION], keep=["_s", "_y"]).where(F.col("value").isNotNull() & F.col("_s").isin(*samples))
    of = lambda s, x: F.sum(F.when(F.col("_s") == F.lit(s), x).otherwise(F.lit(0))).cast("bigint")
    aggs = [a for i, s in enumerate(samples) for a in (of(s, F.lit(1)).alias(f"n{i}"), of(s, F.col("_y")).alias(f"pos{i}"))]
    return cut_lineage(long.groupBy("feature", "value").agg(*aggs), "sample-counts")


def drift_reports(df: DataFrame, sample: str, pairs: Sequence[tuple[str, object, object]], features: Sequence[str],
                  prob: str = "prob", label: str | None = "label", alpha: float = SIGNIFICANCE) -> DataFrame:
    """#104/#105: one report per (name, reference sample, current sample) of `pairs`: KS/JS summary,
    prediction drift, overall score, level, recommendations, and with labels the performance
    comparison, `<metric>_degradation` = reference - current (#57).

    The rows are read once, into a written table of one row per (feature, value) with the counts of every sample of
    `pairs`; a pair's counts are two of its columns, so nothing is shuffled again for the pairs."""
    from scorewatch.operators.metrics import metric_rows

    samples = list(dict.fromkeys(s for _, ref, cur in pairs for s in (ref, cur)))
    c = sample_columns(df, sample, samples, features, prob, label)
    at = {s: i for i, s in enumerate(samples)}
    roles = F.explode(F.array(*[F.struct(F.lit(name).alias("pair"), F.col(f"n{at[ref]}").alias("c_ref"), F.col(f"n{at[cur]}").alias("c_cur")) for name, ref, cur in pairs]))
    paired = c.select(roles.alias("r"), "feature", "value").select("r.pair", "feature", "value", "r.c_ref", "r.c_cur").where("c_ref + c_cur > 0")

    is_pred = F.col("feature") == PREDICTION
    ranked = prefix_sums(paired, ["pair", "feature"], "value", ["c_ref", "c_cur"], None, "quantile")
    share = lambda x: F.try_divide((F.col(f"{x}_below") + F.col(x)).cast("double"), F.col(f"{x}_total").cast("double"))
    d = ranked.groupBy("pair", "feature").agg(F.max(F.abs(share("c_ref") - share("c_cur"))).alias("statistic"), F.max("c_ref_total").alias("n_ref"), F.max("c_cur_total").alias("n_cur"))
    d = d.withColumn("p_value", ks_pvalue("statistic", "n_ref", "n_cur")).withColumn("is_drift", F.col("p_value") < F.lit(alpha))
    of_pred = lambda x, name: F.max(F.when(is_pred, F.col(x))).alias(name)
    k = d.groupBy("pair").agg(F.count_if(~is_pred).alias("total_features"), F.count_if(~is_pred & F.col("is_drift")).alias("ks_drift_count"),
                              of_pred("statistic", "prediction_ks_statistic"), of_pred("p_value", "prediction_ks_p_value"), of_pred("is_drift", "prediction_drift"))
    js = js_of_counts(paired.where(~is_pred), ["pair", "feature"]).groupBy("pair").agg(F.count(F.lit(1)).alias("js_total"), F.count_if("is_drift").alias("js_drift_count"))

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"n{i}").alias("n"), F.col(f"pos{i}").alias("pos")) for s, i in at.items()]))
    pred = c.where(is_pred).select(each.alias("r"), "value").select("r.*", "value").where("n > 0")
    m = pred.groupBy("sample").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    if label:
        scores = pred.select("sample", F.col("value").alias("prob"), F.col("pos").cast("bigint").alias("pos"), (F.col("n") - F.col("pos")).cast("bigint").alias("neg"))
        rows = metric_rows(prefix_sums(scores, ["sample"], "prob", ["pos", "neg"], None, "unit"), ["sample"])
        m = m.join(rows.withColumn("auc", F.when(~F.col("degenerate"), F.col("auc_roc"))), "sample")
    m = cut_lineage(m, "sample-metrics")
    names = df.sparkSession.createDataFrame([(n, r, x) for n, r, x in pairs], StructType([StructField("pair", StringType()), *(
        StructField(s, df.schema[sample].dataType) for s in ("ref", "cur"))]))
    side = lambda x: m.select(F.col("sample").alias(x), F.struct(*m.columns).alias(f"{x}_m"))
    both = names.join(side("ref"), "ref", "left").join(side("cur"), "cur", "left")
    gap = lambda x: F.col(f"ref_m.{x}") - F.col(f"cur_m.{x}")
    out = [(F.col("cur_m.mean") - F.col("ref_m.mean")).alias("mean_prediction_shift")]
    if label:
        out += [gap("auc").alias("auc_degradation"), F.coalesce(gap("auc") > F.lit(0.05), F.lit(False)).alias("significant_auc_drop"), *[gap(x).alias(f"{x}_degradation") for x in COMPARED]]
    row = both.select("pair", *out).join(k, "pair").join(js, "pair")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    row = row.withColumn("ks_drift_ratio", ratio("ks_drift_count", "total_features")).withColumn("js_drift_ratio", ratio("js_drift_count", "js_total"))
    score = overall_drift_score("ks_drift_ratio", "js_drift_ratio", "prediction_drift")
    auc_deg = F.col("auc_degradation") if label else F.lit(None).cast("double")
    return row.drop("js_total").select(
        "*", score.alias("overall_drift_score"), drift_level(score).alias("drift_level"),
        recommendations(score, "ks_drift_ratio", "prediction_drift", auc_deg).alias("recommendations"))


def js_of_counts(counts: DataFrame, by: Sequence[str], edges: int = JS_EDGES, threshold: float = JS_THRESHOLD) -> DataFrame:
    """(by..., js_distance, js_divergence, is_drift) of counted values (by..., value, c_ref, c_cur); see `js_drift`."""
    by, nb = list(by), edges - 1
    ranges = counts.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(nb))
    binned = with_edge_bin(counts.join(ranges.where(F.col("hi") > F.col("lo")), by), "value", F.col("lo"), step, nb, F.col("hi"))
    bins = binned.groupBy(*by, "bin").agg(F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur"))
    w = Window.partitionBy(*by)  # at most `edges` rows a group
    probs = bins.select(*by, "bin", F.try_divide("c_ref", F.sum("c_ref").over(w)).alias("p"), F.try_divide("c_cur", F.sum("c_cur").over(w)).alias("q"))
    dist, div = _js_from_probs("p", "q", by)
    js = probs.groupBy(*by).agg(dist.alias("js_distance"), div.alias("js_divergence"))
    return ranges.select(*by).join(js, by, "left").select(*by, "js_distance", "js_divergence", F.coalesce(F.col("js_distance") > F.lit(threshold), F.lit(False)).alias("is_drift"))


def drift_report(ref: DataFrame, cur: DataFrame, features: Sequence[str], prob: str = "prob",
                 label: str | None = "label", alpha: float = SIGNIFICANCE) -> DataFrame:
    """#104: the report of one pair of samples, one row."""
    cols = list(dict.fromkeys([*features, prob, *([label] if label else [])]))
    both = ref.select(*cols).withColumn("_sample", F.lit("ref")).unionByName(cur.select(*cols).withColumn("_sample", F.lit("cur")))
    return drift_reports(both, "_sample", [("report", "ref", "cur")], features, prob, label, alpha).drop("pair")


def window_drift(ref_tail: DataFrame, cur: DataFrame, features: Sequence[str],
                 alpha: float = SIGNIFICANCE) -> DataFrame:
    """#98: KS against a reference window: any drift, ratio, drifted feature list
    (sorted by feature order), mean and min p-value."""
    ks = ks_drift(ref_tail, cur, features, alpha)
    order = {f: i for i, f in enumerate(features)}
    idx = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(order[f]))])
    ks = ks.withColumn("idx", idx[F.col("feature")])
    agg = ks.agg(
        F.count_if("is_drift").alias("n_drift"), F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("is_drift"), F.col("idx")))).alias("drifted_features"),
        F.avg("p_value").alias("mean_p_value"), F.min("p_value").alias("min_p_value"))
    return agg.select(
        (F.col("n_drift") > 0).alias("drift_detected"),
        (F.col("n_drift") / F.col("n")).alias("drift_ratio"),
        "drifted_features", "mean_p_value", "min_p_value")


def reference_tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """#84: the last n rows by `order` (top-k: each partition keeps n, then merge)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def performance_comparison(ref_metrics: DataFrame, cur_metrics: DataFrame, metric_cols: Sequence[str]) -> DataFrame:
    """#57: metric-wise comparison of two one-row metric frames: (metric, reference, current,
    degradation = reference - current)."""
    def long(df):
        parts = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metric_cols)
        return df.selectExpr(f"stack({len(metric_cols)}, {parts}) AS (metric, value)")
    j = long(ref_metrics).withColumnRenamed("value", "reference").join(
        long(cur_metrics).withColumnRenamed("value", "current"), "metric")
    return j.select("metric", "reference", "current", (F.col("reference") - F.col("current")).alias("degradation"))


def drift_history(checks: Sequence[tuple[int, DataFrame]], path: str) -> DataFrame:
    """#99: append one result row per drift check to a results table (check_no keyed,
    overwrite of the check's own partition keeps re-runs idempotent) and read it back."""
    spark = None
    for check_no, row in checks:
        spark = row.sparkSession
        row.withColumn("check_no", F.lit(check_no)).write.mode("overwrite").parquet(f"{path}/check={check_no}")
    return spark.read.parquet(path).drop("check")
