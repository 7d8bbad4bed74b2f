"""Stability over time and target checks (#107-113, #124-127)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.columns import stability_level

# fixed values (must equal the original's)
TARGETS = (("auc_roc", 0.82), ("brier_score", 0.12), ("calibration_error", 0.05))
HIGHER_IS_BETTER = ("auc_roc", "auc_pr", "precision", "recall", "f1_score")
ADVICE_AUC = "Consider feature engineering or hyperparameter tuning to improve discrimination"
ADVICE_ECE = "Implement calibration techniques to improve probability estimates"
ADVICE_DRIFT = "Monitor for concept drift and consider model retraining"
ADVICE_DIVERSITY = "Consider increasing model diversity to improve ensemble robustness"
ADVICE_STABILITY = "Implement more robust temporal validation strategies"
ADVICE_OK = ("Model performance is meeting targets - continue monitoring",
             "Consider A/B testing for production deployment",
             "Implement automated drift monitoring in production")
COMPOSITE_WEIGHTS = (0.3, 0.4, 0.3)


def to_long(metrics: DataFrame, by: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Wide metric rows -> (by..., metric, value)."""
    parts = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metric_cols)
    return metrics.selectExpr(*[f"`{b}`" for b in by], f"stack({len(metric_cols)}, {parts}) AS (metric, value)")


def stability_stats(metrics_by_period: DataFrame, metric_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """#108: per metric mean, population std, min, max, range, cv = std/mean (inf if mean 0).

    Needs more than one period per group (groups with one period are dropped).
    """
    long = to_long(metrics_by_period, by, metric_cols)
    g = long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("periods"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(float("inf")))
    return g.where(F.col("periods") > 1).select(
        *by, "metric", "mean", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"), cv.alias("cv"))


def stability_score(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """#109/#110: 0.5*min(cv_auc, 1) + 0.5*min(cv_brier, 1) and its level."""
    p = stats.groupBy(*by).agg(
        F.max(F.when(F.col("metric") == "auc_roc", F.col("cv"))).alias("cv_auc"),
        F.max(F.when(F.col("metric") == "brier_score", F.col("cv"))).alias("cv_brier"))
    inf = F.lit(float("inf"))
    s = (F.lit(0.5) * F.least(F.coalesce("cv_auc", inf), F.lit(1.0))
         + F.lit(0.5) * F.least(F.coalesce("cv_brier", inf), F.lit(1.0)))
    return p.select(*by, s.alias("overall_stability_score"), stability_level(s).alias("stability_level"))


def target_table(spark, targets=TARGETS) -> DataFrame:
    rows = [(m, float(t), m in HIGHER_IS_BETTER) for m, t in targets]
    return spark.createDataFrame(rows, "metric string, target double, higher_is_better boolean")


def target_check(metrics_long: DataFrame, targets: DataFrame) -> DataFrame:
    """#111: met = value >= target (higher-better metrics) else value <= target.
    The target table has one row per configured metric; it is broadcast."""
    j = metrics_long.join(F.broadcast(targets), "metric")
    met = F.when(F.col("higher_is_better"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return j.select(*[c for c in metrics_long.columns], "target", met.alias("met"))


def generalisation_expr(auc_a, auc_b) -> Column:
    """#112: Good if |auc_a - auc_b| < 0.1 else Needs attention."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(c(auc_a) - c(auc_b)) < F.lit(0.1), F.lit("Good")).otherwise(F.lit("Needs attention"))


def advice(auc, ece, drift, entropy, stability) -> Column:
    """#113: final advice list; three 'on target' lines when nothing fires."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    arr = F.array(
        F.when(c(auc) < F.lit(0.82), F.lit(ADVICE_AUC)),
        F.when(c(ece) > F.lit(0.05), F.lit(ADVICE_ECE)),
        F.when(c(drift) > F.lit(0.2), F.lit(ADVICE_DRIFT)),
        F.when(c(entropy) < F.lit(0.5), F.lit(ADVICE_DIVERSITY)),
        F.when(c(stability) > F.lit(0.15), F.lit(ADVICE_STABILITY)),
    )
    fired = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.size(fired) == 0, F.array(*[F.lit(a) for a in ADVICE_OK])).otherwise(fired)


def composite_stability(scored: DataFrame, history: DataFrame, by: Sequence[str], prob: str = "prob",
                        label: str = "label", hist_order: str = "period", hist_value: str = "value",
                        weights: tuple[float, float, float] = COMPOSITE_WEIGHTS,
                        has_previous: bool = True) -> DataFrame:
    """#124-#127: a*(1 - clip(brier)) + b*consistency + c*trend per group.

    consistency = 1/(1 + population std of p) (1.0 without previous predictions);
    trend = 0.5 + 0.5*tanh(10*slope) of the history values over their index (1.0 for < 2 points).
    """
    a, b, g = weights
    if abs(a + b + g - 1.0) > 1e-9:
        raise ValueError("Weights must sum to 1.0")
    y = F.col(label).cast("double")
    s = scored.groupBy(*by).agg(
        F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier"), F.stddev_pop(prob).alias("p_std"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(hist_order)  # history: one row per period per group
    h = history.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    t = h.groupBy(*by).agg(F.regr_slope(F.col(hist_value), F.col("_x")).alias("slope"), F.count(F.lit(1)).alias("n_hist"))
    m = s.join(t, list(by), "left")
    calib = F.lit(1.0) - F.least(F.greatest(F.col("brier"), F.lit(0.0)), F.lit(1.0))
    consist = F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.col("p_std")), F.lit(0.0)), F.lit(1.0)) if has_previous else F.lit(1.0)
    trend = F.when(F.coalesce(F.col("n_hist"), F.lit(0)) < 2, F.lit(1.0)).otherwise(
        F.least(F.greatest(F.lit(0.5) + F.tanh(F.col("slope") * F.lit(10.0)) * F.lit(0.5), F.lit(0.0)), F.lit(1.0)))
    score = F.least(F.greatest(F.lit(a) * calib + F.lit(b) * consist + F.lit(g) * trend, F.lit(0.0)), F.lit(1.0))
    return m.select(*by, calib.alias("calibration_score"), consist.alias("consistency_score"),
                    trend.alias("trend_score"), score.alias("stability_score"))
