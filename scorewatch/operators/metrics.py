"""Grouped score-quality metrics (#18-22, #62-81).

Input: a scored frame with group columns, a 0/1 label and a probability
(optionally a weight). Every metric takes `by` so one call serves the whole
set, a split, a period, a model or a fold.

Plan shape: one grouped aggregate computes every threshold / calibration /
profit quantity in a single pass (conditional sums; ECE is
sum_b |sum_{i in b}(p_i - y_i)| / N, so it needs ten sums, not a second
grouping). Rank metrics (AUC, AP) come from the bucketed score-count table in
`rankstats`. The two per-group results are merged by union + grouped max,
which needs no join and no cross product even when `by` is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.columns import (
    DEFAULT_LOSS, LOG_LOSS_EPS, PROFIT_MARGIN, PROFIT_THRESHOLDS, div0, lin_edges,
)
from scorewatch.operators.rankstats import DEFAULT_BUCKETS, auc_terms, ranked_scores

ECE_BINS = 10


def _y(label: str) -> Column:
    return F.col(label).cast("double")


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _wsum(cond: Column, weight: str | None) -> Column:
    if weight:
        return F.sum(F.when(cond, F.col(weight).cast("double")).otherwise(F.lit(0.0)))
    return F.count_if(cond)


def validate_scores(df: DataFrame, label: str = "label", prob: str = "prob",
                    weight: str | None = None, strict: bool = False) -> DataFrame:
    """#21: one data-quality row. strict=True raises ValueError on the first problem."""
    p, y = F.col(prob), F.col(label)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull()).alias("null_label"),
        F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("bad_label"),
        F.count_if(p.isNull()).alias("null_prob"),
        F.count_if(F.isnan(p)).alias("nan_prob"),
        F.count_if(p.isin(float("inf"), float("-inf"))).alias("inf_prob"),
        F.count_if(~F.isnan(p) & ((p < 0) | (p > 1))).alias("out_of_range"),
        F.count(F.when(y == 1, 1)).alias("n_pos"),
        F.count(F.when(y == 0, 1)).alias("n_neg"),
    ]
    if weight:
        aggs += [F.count_if(F.col(weight) < 0).alias("neg_weight"),
                 F.count_if(F.col(weight) != 0).alias("nonzero_weight")]
    out = df.agg(*aggs)
    bad = (F.col("null_label") + F.col("bad_label") + F.col("null_prob") + F.col("nan_prob")
           + F.col("inf_prob") + F.col("out_of_range"))
    out = out.withColumn("valid", (F.col("n") > 0) & (bad == 0))
    if strict:
        r = out.first()
        if r["n"] == 0:
            raise ValueError("Input arrays cannot be empty")
        if r["bad_label"] or r["null_label"]:
            raise ValueError("y_true must contain only binary values (0 and 1)")
        if r["null_prob"] or r["nan_prob"] or r["inf_prob"]:
            raise ValueError("y_prob contains NaN or infinite values")
        if r["out_of_range"]:
            raise ValueError("y_prob must contain probabilities between 0 and 1")
    return out


def confusion_counts(by: Sequence[str], label: str, prob: str, weight: str | None,
                     threshold: float) -> list[Column]:
    pred = F.col(prob) > F.lit(threshold)
    y1 = F.col(label) == 1
    return [
        _wsum(pred & y1, weight).alias("tp"),
        _wsum(pred & ~y1, weight).alias("fp"),
        _wsum(~pred & ~y1, weight).alias("tn"),
        _wsum(~pred & y1, weight).alias("fn"),
    ]


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                     threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """#69: tp, fp, tn, fn per group (class = p > threshold)."""
    return df.groupBy(*by).agg(*confusion_counts(by, label, prob, weight, threshold))


def _threshold_cols() -> list[Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision = div0(tp, tp + fp)
    recall = div0(tp, tp + fn)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall))
        .otherwise(F.lit(0.0)).alias("f1_score"),
        div0(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        div0(tn, tn + fp).alias("specificity"),
        div0(tp, tp + fn).alias("sensitivity"),
        div0(fp, fp + tn).alias("false_positive_rate"),
    ]


def threshold_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                      threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """#68/#70: precision, recall, F1, accuracy, specificity, sensitivity, FPR (0 on empty)."""
    cm = confusion_matrix(df, by, label, prob, threshold, weight)
    return cm.select(*by, *_threshold_cols())


def brier_expr(label: str, prob: str, weight: str | None = None) -> Column:
    d2 = (F.col(prob) - _y(label)) * (F.col(prob) - _y(label))
    if weight:
        return F.try_divide(F.sum(_w(weight) * d2), F.sum(_w(weight)))
    return F.avg(d2)


def log_loss_expr(label: str, prob: str, weight: str | None = None) -> Column:
    pc = F.least(F.greatest(F.col(prob), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    y = _y(label)
    term = -(y * F.ln(pc) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - pc))
    if weight:
        return F.try_divide(F.sum(_w(weight) * term), F.sum(_w(weight)))
    return F.avg(term)


def brier(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
          weight: str | None = None) -> DataFrame:
    """#71: avg((p - y)^2)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier_expr(label, prob, weight).alias("brier_score"))


def log_loss(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
             weight: str | None = None) -> DataFrame:
    """#72: mean negative log-likelihood, p clipped to [eps, 1-eps] (eps = float64 eps)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), log_loss_expr(label, prob, weight).alias("log_loss"))


def ece_aggs(label: str, prob: str, bins: int = ECE_BINS) -> list[Column]:
    """Per-bin sums of (p - y) over (e_b, e_{b+1}], the p == 0 sum, and bin counts
    with p == 0 counted in bin 0."""
    e = lin_edges(0.0, 1.0, bins + 1)
    p, y = F.col(prob), _y(label)
    d = p - y
    out = []
    for b in range(bins):
        inb = (p > F.lit(e[b])) & (p <= F.lit(e[b + 1]))
        out.append(F.sum(F.when(inb, d).otherwise(F.lit(0.0))).alias(f"_s{b}"))
        cnt_in = (inb | (p == F.lit(0.0))) if b == 0 else inb
        out.append(F.count_if(cnt_in).alias(f"_c{b}"))
    out.append(F.sum(F.when(p == F.lit(0.0), d).otherwise(F.lit(0.0))).alias("_z"))
    out.append(F.count(F.lit(1)).alias("_n"))
    return out


def ece_from_aggs(bins: int = ECE_BINS, mode: str = "standard") -> Column:
    n = F.col("_n").cast("double")
    if mode == "standard":
        total = F.abs(F.col("_s0") + F.col("_z"))
        for b in range(1, bins):
            total = total + F.abs(F.col(f"_s{b}"))
        return F.try_divide(total, n)
    if mode == "compat":
        k = F.lit(0)
        for b in range(bins):
            k = k + F.when(F.col(f"_c{b}") > 0, F.lit(1)).otherwise(F.lit(0))
        total = F.lit(0.0)
        for b in range(bins):
            total = total + F.when(F.lit(b) < k, F.abs(F.col(f"_s{b}"))).otherwise(F.lit(0.0))
        return F.try_divide(total, n)
    raise ValueError("mode must be 'standard' or 'compat'")


def calibration_error(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                      bins: int = ECE_BINS, mode: str = "standard") -> DataFrame:
    """#74: expected calibration error, 10 right-closed bins.

    standard: every bin, p = 0 counted in bin 0. compat: the original's
    behaviour (p = 0 in no bin; only the first K bins read, K = number of
    non-empty bins).
    """
    a = df.groupBy(*by).agg(*ece_aggs(label, prob, bins))
    return a.select(*by, F.col("_n").alias("n"), ece_from_aggs(bins, mode).alias("calibration_error"))


def reliability(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                bins: int = ECE_BINS) -> DataFrame:
    """#75: fraction of positives and mean p per non-empty bin (right-closed, p = 0 in bin 0)."""
    from scorewatch.functions.columns import right_closed_bin

    e = lin_edges(0.0, 1.0, bins + 1)
    return (df.withColumn("bin", right_closed_bin(prob, e, include_lowest=True))
            .where(F.col("bin").isNotNull())
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(_y(label)).alias("fraction_positive"),
                                     F.avg(F.col(prob)).alias("mean_predicted")))


def profit_aggs(label: str, prob: str, thresholds: Sequence[float] = PROFIT_THRESHOLDS) -> list[Column]:
    p, y1 = F.col(prob), F.col(label) == 1
    out = []
    for i, t in enumerate(thresholds):
        keep = p <= F.lit(t)  # class 0 = approved
        out.append(F.count_if(keep & ~y1).alias(f"_tn{i}"))
        out.append(F.count_if(keep & y1).alias(f"_fn{i}"))
    return out


def _profit(i: int, margin: float, loss: float) -> Column:
    return F.col(f"_tn{i}").cast("double") * F.lit(margin) - F.col(f"_fn{i}").cast("double") * F.lit(loss)


def profit_curve(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                 thresholds: Sequence[float] = PROFIT_THRESHOLDS, margin: float = PROFIT_MARGIN,
                 loss: float = DEFAULT_LOSS) -> DataFrame:
    """#76: profit = tn*margin - fn*loss for class = p > t, one row per (group, threshold).

    One pass of conditional counts, then `stack` to long form: no cross join.
    """
    a = df.groupBy(*by).agg(*profit_aggs(label, prob, thresholds))
    parts = ", ".join(f"{float(t)!r}D, _tn{i}, _fn{i}" for i, t in enumerate(thresholds))
    long = a.selectExpr(*[f"`{b}`" for b in by],
                        f"stack({len(thresholds)}, {parts}) AS (threshold, tn, fn)")
    return long.withColumn(
        "profit", F.col("tn").cast("double") * F.lit(margin) - F.col("fn").cast("double") * F.lit(loss))


def best_threshold_cols(thresholds: Sequence[float] = PROFIT_THRESHOLDS, margin: float = PROFIT_MARGIN,
                        loss: float = DEFAULT_LOSS) -> list[Column]:
    """#77/#78 from the profit aggregates: first maximum wins."""
    profits = [_profit(i, margin, loss) for i in range(len(thresholds))]
    best = F.greatest(*profits)
    bt = F.lit(None).cast("double")
    for i in range(len(thresholds) - 1, -1, -1):
        bt = F.when(profits[i] == best, F.lit(float(thresholds[i]))).otherwise(bt)
    i05 = [i for i, t in enumerate(thresholds) if t == 0.5]
    p05 = profits[i05[0]] if i05 else F.lit(None).cast("double")
    return [
        bt.alias("optimal_threshold"),
        best.alias("max_profit"),
        p05.alias("profit_at_05_threshold"),
        (F.lit(1.0) - bt).alias("approval_rate_optimal"),
    ]


def best_threshold(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                   thresholds: Sequence[float] = PROFIT_THRESHOLDS, margin: float = PROFIT_MARGIN,
                   loss: float = DEFAULT_LOSS) -> DataFrame:
    """#77/#78: optimal threshold (first max), max profit, profit at 0.5, 1 - t,
    overall default rate, and the measured approval rate avg(p <= t)."""
    a = df.groupBy(*by).agg(
        *profit_aggs(label, prob, thresholds),
        F.avg(_y(label)).alias("default_rate_if_all_approved"),
        *[F.avg(F.when(F.col(prob) <= F.lit(t), F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"_ap{i}")
          for i, t in enumerate(thresholds)],
    )
    cols = best_threshold_cols(thresholds, margin, loss)
    measured = F.lit(None).cast("double")
    for i in range(len(thresholds) - 1, -1, -1):
        measured = F.when(F.col("_bt") == F.lit(float(thresholds[i])), F.col(f"_ap{i}")).otherwise(measured)
    return (a.select("*", cols[0].alias("_bt"), *cols)
            .select(*by, "optimal_threshold", "max_profit", "profit_at_05_threshold",
                    "approval_rate_optimal", "default_rate_if_all_approved",
                    measured.alias("measured_approval_rate")))


def all_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob",
                weight: str | None = None, threshold: float = 0.5, bins: int = ECE_BINS,
                ece_mode: str = "standard", buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """#79/#80: the full metric row per group, from ONE pass over the rows.

    Every metric here is a function of the per-(group, score) label counts, so
    the raw rows are aggregated once (map-side partial aggregation) into the
    score-count table; the bucketed prefix sums add the rank terms, and one
    grouped aggregate over that table yields AUC, AP, confusion counts, Brier,
    log loss, ECE bins and profit counts together.

    Single-class groups get auc_roc = 0.5 and degenerate = true (#80); the
    other metrics are still computed. Weighted forms (#73) apply to
    AUC/AP/threshold metrics/Brier/log loss; ECE and profit ignore weights.
    Rows with a NULL probability are not scored (validate with #21 first).
    """
    return metric_rows(ranked_scores(df, by, prob, label, weight, buckets), by, prob, weight is not None, threshold, bins, ece_mode)


def metric_rows(r: DataFrame, by: Sequence[str], prob: str = "prob", weight: bool = False, threshold: float = 0.5,
                bins: int = ECE_BINS, ece_mode: str = "standard") -> DataFrame:
    """`all_metrics` from a ranked score-count table (by..., prob, pos, neg and their prefix sums)."""
    by = list(by)
    p = F.col(prob).cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pn = F.col("pos_n") if weight else F.col("pos")
    nn = F.col("neg_n") if weight else F.col("neg")
    pnd, nnd = pn.cast("double"), nn.cast("double")
    above = p > F.lit(threshold)
    wsum = (lambda cond, c: F.sum(F.when(cond, c).otherwise(F.lit(0.0)))) if weight else \
        (lambda cond, c: F.sum(F.when(cond, c).otherwise(F.lit(0))).cast("bigint"))
    pc = F.least(F.greatest(p, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    e = lin_edges(0.0, 1.0, bins + 1)
    dsum = pnd * (p - F.lit(1.0)) + nnd * p            # sum of (p - y) over the rows at this score
    ece_parts_ = []
    for b in range(bins):
        inb = (p > F.lit(e[b])) & (p <= F.lit(e[b + 1]))
        ece_parts_.append(F.sum(F.when(inb, dsum).otherwise(F.lit(0.0))).alias(f"_s{b}"))
        cnt_in = (inb | (p == F.lit(0.0))) if b == 0 else inb
        ece_parts_.append(F.sum(F.when(cnt_in, pn + nn).otherwise(F.lit(0))).alias(f"_c{b}"))
    prof = []
    for i, t in enumerate(PROFIT_THRESHOLDS):
        keep = p <= F.lit(t)
        prof.append(F.sum(F.when(keep, nn).otherwise(F.lit(0))).alias(f"_tn{i}"))
        prof.append(F.sum(F.when(keep, pn).otherwise(F.lit(0))).alias(f"_fn{i}"))
    if weight:
        auc_num = F.sum(pos * (F.lit(2.0) * F.col("neg_below") + neg))
        auc = F.try_divide(auc_num, F.lit(2.0) * F.max("pos_total") * F.max("neg_total"))
    else:
        ex = lambda c: F.col(c).cast("decimal(38,0)")
        auc_num = F.sum(ex("pos") * (ex("neg_below") * F.lit(2) + ex("neg"))).cast("double")
        auc = F.try_divide(auc_num, F.lit(2.0) * F.max("pos_total").cast("double") * F.max("neg_total").cast("double"))
    pos_ge = (F.col("pos_total") - F.col("pos_below")).cast("double")
    all_ge = pos_ge + (F.col("neg_total") - F.col("neg_below")).cast("double")
    ap = F.try_divide(F.sum(pos * F.try_divide(pos_ge, all_ge)), F.max("pos_total").cast("double"))
    a = r.groupBy(*by).agg(
        F.sum(pn + nn).alias("_n"), F.sum(pn).alias("n_pos_rows"),
        wsum(above, F.col("pos")).alias("tp"), wsum(above, F.col("neg")).alias("fp"),
        wsum(~above, F.col("neg")).alias("tn"), wsum(~above, F.col("pos")).alias("fn"),
        F.try_divide(F.sum(pos * (p - F.lit(1.0)) * (p - F.lit(1.0)) + neg * p * p), F.sum(pos + neg)).alias("brier_score"),
        F.try_divide(F.sum(-(pos * F.ln(pc) + neg * F.ln(F.lit(1.0) - pc))), F.sum(pos + neg)).alias("log_loss"),
        *ece_parts_,
        F.sum(F.when(p == F.lit(0.0), dsum).otherwise(F.lit(0.0))).alias("_z"),
        *prof, auc.alias("_auc"), ap.alias("auc_pr"))
    degenerate = (F.col("n_pos_rows") == 0) | (F.col("n_pos_rows") == F.col("_n"))
    dr = F.try_divide(F.col("n_pos_rows").cast("double"), F.col("_n").cast("double"))
    return a.select(
        *by, F.col("_n").alias("n"), dr.alias("default_rate"), "brier_score", "log_loss", *_threshold_cols(),
        ece_from_aggs(bins, ece_mode).alias("calibration_error"),
        *best_threshold_cols(),
        dr.alias("default_rate_if_all_approved"),
        degenerate.alias("degenerate"),
        F.when(degenerate, F.lit(0.5)).otherwise(F.col("_auc")).alias("auc_roc"),
        "auc_pr")


def prediction_summary(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                       prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """#64: n, actual rate, predicted rate, mean / sample std / min / max of p."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_y(label)).alias("actual_rate"),
        F.avg((F.col(prob) > F.lit(threshold)).cast("double")).alias("predicted_rate"),
        F.avg(prob).alias("mean_prob"),
        F.stddev_samp(prob).alias("std_prob"),
        F.min(prob).alias("min_prob"),
        F.max(prob).alias("max_prob"),
    )


def risk_segments(df: DataFrame, label: str = "label", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """#22: high (p > 0.5) / low risk segment: count and actual rate."""
    seg = F.when(F.col(prob) > F.lit(threshold), F.lit("high")).otherwise(F.lit("low"))
    return df.groupBy(seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_y(label)).alias("actual_rate"))
