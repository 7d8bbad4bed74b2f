"""Registered scans, splits, filters, bands, descriptive aggregates and single metrics
(#1, #2, #4, #11-22, #58-78, #80, #81, #85-87, #130)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewatch.functions.columns import age_group, classify, quarter, recommendation, risk_band
from scorewatch.operators import descriptive as DS
from scorewatch.operators import metrics as M
from scorewatch.operators import rankstats as RS
from scorewatch.operators import splits as SP
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import (
    all_metrics_sql, best_parts, dlit, ece_parts, long_sql, profit_parts, r6, ranked_sql, with_views,
)
from scorewatch.plans.q_drift import FEATURES as _DRIFT_FEATS
from scorewatch.sources import fixtures as FX
from scorewatch.sources.tables import LoanSpec, read_loans, read_table

LOAN_DOUBLES = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "installment", "revol_util",
                "score_a", "score_b", "score_c"]
W_LOANS = with_views("loans")
W_LONG = with_views("scored_long")


def _loans_sel(extra: str = "") -> str:
    cols = ["loan_id", "customer_id", "month_no", "ORGANIZATION_TYPE", "DAYS_BIRTH", "CNT_ITEMS", "TARGET"]
    return ", ".join(cols + [r6(c, c) for c in LOAN_DOUBLES]) + extra


@register("scan_loans", W_LOANS + f"SELECT {_loans_sel()} FROM loans")
def scan_loans(spark, sf_dir):
    """#1: the loan view over orders read and checked by the loan reader."""
    orders = read_loans(spark, f"{sf_dir}/orders.parquet", LoanSpec(label="o_totalprice", period="o_orderdate"))
    return FX.loans(spark, sf_dir, orders)


@register("scan_items", """
SELECT CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS dup_no,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ISSUE_MONTH,
  round(l_quantity * 1e6) / 1e6 AS loan_amnt, round(l_extendedprice * 1e6) / 1e6 AS term_price,
  round(l_discount * 100e0 * 1e6) / 1e6 AS dti, CAST(l_returnflag = 'R' AS INTEGER) AS loan_status
FROM lineitem""")
def scan_items(spark, sf_dir):
    """#2: second schema (label loan_status) from lineitem with a duplicate-safe key."""
    items = read_loans(spark, f"{sf_dir}/lineitem.parquet", LoanSpec(label="l_returnflag", period="l_shipdate"))
    return FX.items_book(spark, sf_dir, items).drop("row_hash")


@register("sample_n", W_LOANS + """
SELECT loan_id, month_no, TARGET FROM loans
ORDER BY ((loan_id * 48271 + 42) % 2147483647), loan_id LIMIT 1000""")
def sample_n(spark, sf_dir):
    """#4: exact, repeatable 1000-row sample without replacement (seeded key mix)."""
    return DS.sample_exact(FX.loans(spark, sf_dir).select("loan_id", "month_no", "TARGET"), 1000, "loan_id", 42)


@register("temporal_split", W_LOANS + """
SELECT loan_id, CASE WHEN month_no < 12 THEN 'train' WHEN month_no < 16 THEN 'val' ELSE 'test' END AS split
FROM loans WHERE month_no IS NOT NULL""")
def temporal_split(spark, sf_dir):
    """#11: default 12/4/8 split on month_no (period column dropped)."""
    return SP.temporal_split(FX.loans(spark, sf_dir).select("loan_id", "month_no"), "month_no", 12, 4, 8)


@register("split_summary", with_views("loans_split") + f"""
SELECT split, count(*) AS rows, {r6('avg(TARGET)', 'default_rate')} FROM loans_split GROUP BY split""")
def split_summary(spark, sf_dir):
    """#12: rows and default rate per split (40/15/25)."""
    return SP.split_summary(FX.loans_split(spark, sf_dir), "TARGET")


@register("drop_null_period", W_LOANS + """
SELECT count(*) AS rows, count_if(p IS NULL) AS dropped, count(p) AS kept
FROM (SELECT CASE WHEN AMT_ANNUITY IS NULL THEN NULL ELSE month_no END AS p FROM loans)""")
def drop_null_period(spark, sf_dir):
    """#14: NULL-period filter count (period made NULL where AMT_ANNUITY is NULL)."""
    df = FX.loans(spark, sf_dir).select(F.when(F.col("AMT_ANNUITY").isNotNull(), F.col("month_no")).alias("p"))
    return SP.null_period_count(df, "p")


_ROLE_COLS = ["loan_id", "month_no", "ORGANIZATION_TYPE", "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY",
              "revol_util", "DAYS_BIRTH", "CNT_ITEMS", "TARGET"]
_NUMERIC = ["loan_id", "month_no", "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "revol_util", "DAYS_BIRTH",
            "CNT_ITEMS", "TARGET"]


def _roles_sql() -> str:
    cnt = ", ".join(f"CAST(count(DISTINCT {c}) AS BIGINT) AS {c}" for c in _ROLE_COLS)
    lab = " OR ".join(f"contains(lower(col), '{p}')" for p in DS.LABEL_NAME_PARTS)
    tem = " OR ".join(f"contains(lower(col), '{p}')" for p in DS.TEMPORAL_NAME_PARTS)
    num = ", ".join(f"'{c}'" for c in _NUMERIC)
    return W_LOANS + f"""
SELECT col AS "column", d AS "distinct", rows,
  CASE WHEN {lab} THEN 'label' WHEN {tem} THEN 'temporal'
       WHEN col IN ({num}) AND (CAST(d AS DOUBLE) / CAST(rows AS DOUBLE) > 0.05e0 OR d > 50) THEN 'numeric'
       ELSE 'categorical' END AS role
FROM (UNPIVOT (SELECT count(*) AS rows, {cnt} FROM loans) ON {', '.join(_ROLE_COLS)} INTO NAME col VALUE d)"""


@register("detect_roles", _roles_sql())
def detect_roles(spark, sf_dir):
    """#15: column roles from one distinct-count aggregate."""
    return DS.column_roles(FX.loans(spark, sf_dir).select(*_ROLE_COLS))


_FITTED = ["AMT_CREDIT", "missing_col", "TARGET", "loan_id"]


@register("align_columns", W_LOANS + f"SELECT {r6('AMT_CREDIT', 'AMT_CREDIT')}, 0 AS missing_col, TARGET, loan_id FROM loans")
def align_columns(spark, sf_dir):
    """#16: align to a fitted column list (missing filled with 0, extras dropped)."""
    return DS.align_columns(FX.loans(spark, sf_dir), _FITTED)


@register("regime_rates", W_LOANS + f"""
SELECT CASE WHEN month_no % 24 < 8 THEN 'stable' WHEN month_no % 24 < 16 THEN 'recession' ELSE 'recovery' END AS regime,
  count(*) AS rows, {r6('avg(TARGET)', 'default_rate')} FROM loans GROUP BY 1""")
def regime_rates(spark, sf_dir):
    """#17: default rate per regime band of month_no % 24."""
    return SP.regime_rates(FX.loans(spark, sf_dir), "month_no", "TARGET", 24)


@register("classify", W_LOANS + "SELECT loan_id, CAST(score_c > 0.5e0 AS INTEGER) AS predicted_class FROM loans")
def classify_q(spark, sf_dir):
    """#18: class = p > 0.5."""
    return FX.loans(spark, sf_dir).select("loan_id", classify("score_c").alias("predicted_class"))


_BAND_SQL = ("CASE WHEN {p} > 0e0 AND {p} <= 0.3e0 THEN 'Low' WHEN {p} > 0.3e0 AND {p} <= 0.6e0 THEN 'Medium' "
             "WHEN {p} > 0.6e0 AND {p} <= 1e0 THEN 'High' END")
_REC_SQL = "CASE WHEN {p} < 0.5e0 THEN 'Approve' WHEN {p} IS NOT NULL THEN 'Reject' END"


@register("risk_band", W_LOANS + f"SELECT loan_id, {_BAND_SQL.format(p='score_a')} AS risk_band FROM loans")
def risk_band_q(spark, sf_dir):
    """#19: right-closed risk bands; p = 0 -> NULL (score_a has exact zeros)."""
    return FX.loans(spark, sf_dir).select("loan_id", risk_band("score_a").alias("risk_band"))


@register("recommendation", W_LOANS + f"SELECT loan_id, {_REC_SQL.format(p='score_a')} AS recommendation FROM loans")
def recommendation_q(spark, sf_dir):
    """#20: Approve if p < 0.5 else Reject."""
    return FX.loans(spark, sf_dir).select("loan_id", recommendation("score_a").alias("recommendation"))


@register("validate_scores", W_LONG + """
SELECT count(*) AS n, count_if(label IS NULL) AS null_label, count_if(label IS NOT NULL AND label NOT IN (0, 1)) AS bad_label,
  count_if(prob IS NULL) AS null_prob, count_if(isnan(prob)) AS nan_prob, count_if(isinf(prob)) AS inf_prob,
  count_if(NOT isnan(prob) AND (prob < 0 OR prob > 1)) AS out_of_range,
  count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg,
  count(*) > 0 AND count_if(label IS NULL) + count_if(label IS NOT NULL AND label NOT IN (0, 1)) + count_if(prob IS NULL)
    + count_if(isnan(prob)) + count_if(isinf(prob)) + count_if(NOT isnan(prob) AND (prob < 0 OR prob > 1)) = 0 AS valid
FROM scored_long""")
def validate_scores(spark, sf_dir):
    """#21: data-quality row for a scored table."""
    return M.validate_scores(FX.scored_long(spark, sf_dir))


@register("risk_segments", W_LONG + f"""
SELECT model_id, CASE WHEN prob > 0.5e0 THEN 'high' ELSE 'low' END AS segment, count(*) AS n, {r6('avg(label)', 'actual_rate')}
FROM scored_long GROUP BY ALL""")
def risk_segments(spark, sf_dir):
    """#22: high/low risk segments per model: count and actual rate."""
    sl = FX.scored_long(spark, sf_dir)
    seg = F.when(F.col("prob") > 0.5, F.lit("high")).otherwise(F.lit("low"))
    return sl.groupBy("model_id", seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("actual_rate"))


@register("monthly_default_rate", W_LOANS + f"SELECT month_no, {r6('avg(TARGET)', 'default_rate')} FROM loans GROUP BY month_no")
def monthly_default_rate(spark, sf_dir):
    """#58: default rate by month."""
    return DS.monthly_rates(FX.loans(spark, sf_dir), "month_no", "TARGET").select("month_no", "default_rate")


@register("monthly_volume", W_LOANS + "SELECT month_no, count(*) AS volume FROM loans GROUP BY month_no")
def monthly_volume(spark, sf_dir):
    """#59: volume by month."""
    return DS.monthly_rates(FX.loans(spark, sf_dir), "month_no", "TARGET").select("month_no", "volume")


@register("monthly_mean_credit", W_LOANS + f"SELECT month_no, {r6('avg(AMT_CREDIT)', 'mean_amount')} FROM loans GROUP BY month_no")
def monthly_mean_credit(spark, sf_dir):
    """#60: mean credit by month."""
    return DS.monthly_rates(FX.loans(spark, sf_dir), "month_no", "TARGET", "AMT_CREDIT").select("month_no", "mean_amount")


def _density_sql() -> str:
    from scorewatch.plans.sqlparts import edge_bin_sql

    b = edge_bin_sql("score_b", "r.lo", "((r.hi - r.lo) / 30e0)", "r.hi", 30)
    return W_LOANS.rstrip("\n") + f""",
r AS (SELECT min(score_b) AS lo, max(score_b) AS hi FROM loans),
c AS (SELECT CASE WHEN month_no < 8 THEN 'early' WHEN month_no >= 16 THEN 'late' ELSE 'middle' END AS band, {b} AS bin, (r.hi - r.lo) / 30e0 AS step
      FROM loans CROSS JOIN r)
SELECT band, bin, count(*) AS count, {r6('count(*) / (sum(count(*)) OVER (PARTITION BY band) * any_value(step))', 'density')}
FROM c WHERE bin IS NOT NULL GROUP BY band, bin"""


@register("density_histogram", _density_sql())
def density_histogram(spark, sf_dir):
    """#61: 30-bin density histogram of score_b for early / middle / late months."""
    lo = FX.loans(spark, sf_dir).withColumn(
        "band", F.when(F.col("month_no") < 8, F.lit("early")).when(F.col("month_no") >= 16, F.lit("late"))
        .otherwise(F.lit("middle")))
    return DS.density_histogram(lo, "score_b", "band", 30)


@register("label_distribution", W_LOANS + "SELECT TARGET, count(*) AS count FROM loans GROUP BY TARGET")
def label_distribution(spark, sf_dir):
    """#62: rows per label."""
    return DS.label_distribution(FX.loans(spark, sf_dir), "TARGET")


_MISS_COLS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "installment", "revol_util", "TARGET"]


@register("missing_profile", W_LOANS + f"""
SELECT col AS "column", CAST(m AS BIGINT) AS missing, {r6('CAST(m AS DOUBLE) / CAST(n AS DOUBLE)', 'missing_share')},
  CAST(m AS DOUBLE) / CAST(n AS DOUBLE) > 0.1e0 AS high_missing
FROM (UNPIVOT (SELECT count(*) AS n, {', '.join(f'count_if({c} IS NULL) AS {c}' for c in _MISS_COLS)} FROM loans)
      ON {', '.join(_MISS_COLS)} INTO NAME col VALUE m)""")
def missing_profile(spark, sf_dir):
    """#63: missing counts and shares per column (one pass)."""
    return DS.missing_profile(FX.loans(spark, sf_dir), _MISS_COLS)


@register("prediction_summary", W_LONG + f"""
SELECT model_id, count(*) AS n, {r6('avg(label)', 'actual_rate')}, {r6('avg(CASE WHEN prob > 0.5e0 THEN 1e0 ELSE 0e0 END)', 'predicted_rate')},
  {r6('avg(prob)', 'mean_prob')}, {r6('stddev_samp(prob)', 'std_prob')}, {r6('min(prob)', 'min_prob')}, {r6('max(prob)', 'max_prob')}
FROM scored_long GROUP BY model_id""")
def prediction_summary(spark, sf_dir):
    """#64: n, actual and predicted rate, mean / sample std / min / max of p per model."""
    return M.prediction_summary(FX.scored_long(spark, sf_dir), ["model_id"])


@register("band_counts", W_LOANS + f"""
SELECT {_BAND_SQL.format(p='score_c')} AS risk_band, {_REC_SQL.format(p='score_c')} AS recommendation, count(*) AS count
FROM loans GROUP BY GROUPING SETS ((1), (2))""")
def band_counts(spark, sf_dir):
    """#65: risk band and recommendation counts in one grouping-sets pass."""
    return DS.band_counts(FX.loans(spark, sf_dir), "score_c")


_CM = """count_if(prob > 0.5e0 AND label = 1) AS tp, count_if(prob > 0.5e0 AND label <> 1) AS fp,
  count_if(NOT (prob > 0.5e0) AND label <> 1) AS tn, count_if(NOT (prob > 0.5e0) AND label = 1) AS fn"""


@register("confusion_matrix", W_LONG + f"SELECT model_id, {_CM} FROM scored_long GROUP BY model_id")
def confusion_matrix(spark, sf_dir):
    """#69: confusion counts per model at 0.5."""
    return M.confusion_matrix(FX.scored_long(spark, sf_dir), ["model_id"])


def _thr_sql() -> str:
    from scorewatch.plans.sqlparts import div0
    prec, rec = div0("tp", "tp + fp"), div0("tp", "tp + fn")
    cols = {
        "precision": prec, "recall": rec,
        "f1_score": f"CASE WHEN {prec} + {rec} > 0 THEN 2e0 * {prec} * {rec} / ({prec} + {rec}) ELSE 0e0 END",
        "accuracy": div0("tp + tn", "tp + fp + tn + fn"), "specificity": div0("tn", "tn + fp"),
        "sensitivity": div0("tp", "tp + fn"), "false_positive_rate": div0("fp", "fp + tn"),
    }
    return W_LONG + f"SELECT model_id, {', '.join(r6(v, k) for k, v in cols.items())} FROM (SELECT model_id, {_CM} FROM scored_long GROUP BY model_id)"


@register("threshold_metrics", _thr_sql())
def threshold_metrics(spark, sf_dir):
    """#68/#70: precision, recall, F1, accuracy, specificity, sensitivity, FPR per model."""
    return M.threshold_metrics(FX.scored_long(spark, sf_dir), ["model_id"])


@register("brier", W_LONG + f"SELECT month_no, model_id, count(*) AS n, {r6('avg((prob - label) * (prob - label))', 'brier_score')} FROM scored_long GROUP BY ALL")
def brier(spark, sf_dir):
    """#71: Brier score per (month, model)."""
    return M.brier(FX.scored_long(spark, sf_dir), ["month_no", "model_id"])


@register("log_loss", W_LONG + f"""
SELECT model_id, count(*) AS n, {r6('avg(-(label * ln(least(greatest(prob, 2.220446049250313e-16), 0.9999999999999998e0)) + (1 - label) * ln(1 - least(greatest(prob, 2.220446049250313e-16), 0.9999999999999998e0))))', 'log_loss')}
FROM scored_long GROUP BY model_id""")
def log_loss(spark, sf_dir):
    """#72: log loss with float-eps clipping per model."""
    return M.log_loss(FX.scored_long(spark, sf_dir), ["model_id"])


def _ece_sql(mode: str) -> str:
    aggs, std, compat = ece_parts()
    return W_LONG + f"SELECT model_id, _n AS n, {r6(std if mode == 'standard' else compat, 'calibration_error')} FROM (SELECT model_id, {', '.join(aggs)} FROM scored_long GROUP BY model_id)"


@register("ece", _ece_sql("standard"))
def ece(spark, sf_dir):
    """#74: expected calibration error, standard mode (p = 0 in bin 0)."""
    return M.calibration_error(FX.scored_long(spark, sf_dir), ["model_id"], mode="standard")


@register("ece_compat", _ece_sql("compat"))
def ece_compat(spark, sf_dir):
    """#74: ECE in the original's mode (p = 0 in no bin, first K bins read)."""
    return M.calibration_error(FX.scored_long(spark, sf_dir), ["model_id"], mode="compat")


def _rel_sql() -> str:
    from scorewatch.functions.columns import lin_edges
    e = lin_edges(0.0, 1.0, 11)
    case = "CASE " + " ".join(
        f"WHEN prob {'>=' if i == 0 else '>'} {dlit(e[i])} AND prob <= {dlit(e[i + 1])} THEN {i}" for i in range(10)) + " END"
    return W_LONG + f"""
SELECT model_id, bin, count(*) AS n, {r6('avg(label)', 'fraction_positive')}, {r6('avg(prob)', 'mean_predicted')}
FROM (SELECT *, {case} AS bin FROM scored_long) WHERE bin IS NOT NULL GROUP BY model_id, bin"""


@register("reliability", _rel_sql())
def reliability(spark, sf_dir):
    """#75: reliability table per model and bin."""
    return M.reliability(FX.scored_long(spark, sf_dir), ["model_id"])


def _profit_sql() -> str:
    aggs, profits = profit_parts()
    from scorewatch.functions.columns import PROFIT_THRESHOLDS as T
    rows = " UNION ALL ".join(
        f"SELECT model_id, {dlit(t)} AS threshold, _tn{i} AS tn, _fn{i} AS fn FROM a" for i, t in enumerate(T))
    return W_LONG.rstrip("\n") + f""",
a AS (SELECT model_id, {', '.join(aggs)} FROM scored_long GROUP BY model_id)
SELECT model_id, {r6('threshold', 'threshold')}, tn, fn, {r6('CAST(tn AS DOUBLE) * 0.15e0 - CAST(fn AS DOUBLE) * 1e0', 'profit')} FROM ({rows})"""


@register("profit_curve", _profit_sql())
def profit_curve(spark, sf_dir):
    """#76: profit at the nine thresholds per model (one pass + stack)."""
    return M.profit_curve(FX.scored_long(spark, sf_dir), ["model_id"])


def _best_sql() -> str:
    aggs, profits = profit_parts()
    bp = best_parts(profits)
    from scorewatch.functions.columns import PROFIT_THRESHOLDS as T
    ap = ", ".join(f"avg(CASE WHEN prob <= {dlit(t)} THEN 1e0 ELSE 0e0 END) AS _ap{i}" for i, t in enumerate(T))
    measured = "CASE " + " ".join(f"WHEN {bp['optimal_threshold']} = {dlit(t)} THEN _ap{i}" for i, t in enumerate(T)) + " END"
    return W_LONG + f"""
SELECT model_id, {r6(bp['optimal_threshold'], 'optimal_threshold')}, {r6(bp['max_profit'], 'max_profit')},
  {r6(bp['profit_at_05_threshold'], 'profit_at_05_threshold')}, {r6(bp['approval_rate_optimal'], 'approval_rate_optimal')},
  {r6('dr', 'default_rate_if_all_approved')}, {r6(measured, 'measured_approval_rate')}
FROM (SELECT model_id, {', '.join(aggs)}, avg(label) AS dr, {ap} FROM scored_long GROUP BY model_id)"""


@register("best_threshold", _best_sql())
def best_threshold(spark, sf_dir):
    """#77/#78: optimal threshold, max profit, profit at 0.5, approval rates."""
    return M.best_threshold(FX.scored_long(spark, sf_dir), ["model_id"])


@register("metrics_degenerate", W_LOANS + "SELECT CNT_ITEMS, auc_roc, degenerate, brier_score FROM (" + all_metrics_sql(
    "(SELECT CNT_ITEMS, TARGET AS label, score_c AS prob FROM loans)", ["CNT_ITEMS"]) + ")")
def metrics_degenerate(spark, sf_dir):
    """#80: per number of items; a single-class group (orders without items) has AUC 0.5 and is flagged,
    its Brier score is still computed."""
    lo = FX.loans(spark, sf_dir).select(
        "CNT_ITEMS", F.col("TARGET").alias("label"), F.col("score_c").alias("prob"))
    return M.all_metrics(lo, ["CNT_ITEMS"]).select("CNT_ITEMS", "auc_roc", "degenerate", "brier_score")


def _points_sql(kind: str) -> str:
    rk = ranked_sql("scored_long", ["model_id"])
    tp, fp = "(pos_total - pos_below)", "(neg_total - neg_below)"
    if kind == "roc":
        sel = f"{r6(f'CAST({tp} AS DOUBLE) / CAST(pos_total AS DOUBLE)', 'tpr')}, {r6(f'CAST({fp} AS DOUBLE) / CAST(neg_total AS DOUBLE)', 'fpr')}"
    else:
        sel = f"{r6(f'CAST({tp} AS DOUBLE) / CAST({tp} + {fp} AS DOUBLE)', 'precision')}, {r6(f'CAST({tp} AS DOUBLE) / CAST(pos_total AS DOUBLE)', 'recall')}"
    return W_LONG + f"SELECT model_id, {r6('prob', 'threshold')}, CAST({tp} AS BIGINT) AS tp, CAST({fp} AS BIGINT) AS fp, {sel} FROM ({rk})"


@register("roc_points", _points_sql("roc"))
def roc_points(spark, sf_dir):
    """#81: ROC points (one per distinct score) per model."""
    return RS.curve_points(FX.scored_long(spark, sf_dir), ["model_id"]).select("model_id", "threshold", "tp", "fp", "tpr", "fpr")


@register("pr_points", _points_sql("pr"))
def pr_points(spark, sf_dir):
    """#81: precision-recall points per model."""
    return RS.curve_points(FX.scored_long(spark, sf_dir), ["model_id"]).select("model_id", "threshold", "tp", "fp", "precision", "recall")


@register("sort_by_period", W_LOANS + f"SELECT month_no, loan_id, {r6('score_c', 'score_c')} FROM loans ORDER BY month_no, loan_id")
def sort_by_period(spark, sf_dir):
    """#85: rows ordered by period (range-partitioned sort at output only)."""
    return FX.loans(spark, sf_dir).select("month_no", "loan_id", "score_c").orderBy("month_no", "loan_id")


@register("top_features", with_views("loans_shift") + f"""
SELECT feature, {r6('d', 'statistic')} FROM (
  SELECT feature, max(abs(cdf_ref - cdf_cur)) AS d FROM (
    SELECT feature,
      CAST(sum(c_ref) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(c_ref) OVER (PARTITION BY feature) AS DOUBLE) AS cdf_ref,
      CAST(sum(c_cur) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(c_cur) OVER (PARTITION BY feature) AS DOUBLE) AS cdf_cur
    FROM (SELECT feature, value, count_if(NOT is_cur) AS c_ref, count_if(is_cur) AS c_cur FROM (__LONG__) GROUP BY feature, value))
  GROUP BY feature) ORDER BY d DESC, feature LIMIT 3""".replace("__LONG__", long_sql("loans_shift", _DRIFT_FEATS, "is_current")))
def top_features(spark, sf_dir):
    """#86: top-3 drifted features by KS statistic (ties by name)."""
    from scorewatch.operators import drift as D
    from scorewatch.plans.q_drift import FEATURES
    ref, cur = D.split_frame(FX.loans_shift(spark, sf_dir), "is_current")
    ks = D.ks_drift(ref, cur, FEATURES)
    return ks.orderBy(F.col("statistic").desc(), "feature").limit(3).select("feature", "statistic")


@register("dominant_model", W_LONG + f"""
SELECT month_no, arg_min(model_id, struct_pack(b := b, m := model_id)) AS dominant_model, {r6('min(b)', 'best_brier')}
FROM (SELECT month_no, model_id, avg((prob - label) * (prob - label)) AS b FROM scored_long GROUP BY ALL) GROUP BY month_no""")
def dominant_model(spark, sf_dir):
    """#87: per month the model with the lowest Brier score, first model id on ties."""
    b = M.brier(FX.scored_long(spark, sf_dir), ["month_no", "model_id"])
    return b.groupBy("month_no").agg(
        F.min_by("model_id", F.struct("brier_score", "model_id")).alias("dominant_model"),
        F.min("brier_score").alias("best_brier"))


@register("union_train_val", with_views("loans_split") + "SELECT split, count(*) AS rows FROM (SELECT loan_id, split FROM loans_split WHERE split = 'train' UNION ALL SELECT loan_id, split FROM loans_split WHERE split = 'val') GROUP BY split")
def union_train_val(spark, sf_dir):
    """#55: union of train and validation rows (counts per source split)."""
    ls = FX.loans_split(spark, sf_dir)
    u = ls.where(F.col("split") == "train").select("loan_id", "split").unionByName(
        ls.where(F.col("split") == "val").select("loan_id", "split"))
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("join_scores", W_LOANS + f"""
SELECT o.o_orderkey AS loan_id, l.TARGET AS label, {r6('l.score_c', 'prob')}, o.o_orderpriority AS ORGANIZATION_TYPE
FROM orders o JOIN loans l ON o.o_orderkey = l.loan_id""")
def join_scores(spark, sf_dir):
    """#51: align features, labels and predictions by key (equi-join, not row position)."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("loan_id"),
                                                         F.col("o_orderpriority").alias("ORGANIZATION_TYPE"))
    sc = FX.loans(spark, sf_dir).select("loan_id", F.col("TARGET").alias("label"), F.col("score_c").alias("prob"))
    return orders.join(sc, "loan_id")


_NAMED = ["month_no", "AMT_CREDIT", "revol_util", "installment", "DAYS_BIRTH", "TARGET"]


def _nw_sql() -> str:
    cases = []
    for weight, words in DS.NAME_WEIGHTS:
        cond = " OR ".join(f"contains(lower(col), '{w}')" for w in words)
        cases.append(f"WHEN {cond} THEN {dlit(weight)}")
    return W_LOANS + f"""
SELECT col AS feature, CASE {' '.join(cases)} ELSE 1e0 END AS weight, count(*) AS n, count(v) AS n_values
FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NAMED)} FROM loans) UNPIVOT INCLUDE NULLS (v FOR col IN ({', '.join(_NAMED)})) GROUP BY col"""


@register("name_weights", _nw_sql())
def name_weights(spark, sf_dir):
    """#39: keyword weights of feature names (1.5 time, 1.3 risk, else 1.0), with the rows and the values of each feature."""
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in _NAMED)
    long = FX.loans(spark, sf_dir).selectExpr(f"stack({len(_NAMED)}, {parts}) AS (feature, value)")
    n = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))
    return n.select("feature", DS.name_weight_expr(F.col("feature")).alias("weight"), "n", "n_values")


@register("stratified_folds", W_LOANS + """
SELECT TARGET, fold, count(*) AS rows FROM (
  SELECT TARGET, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY (loan_id * 48271 + 42) % 2147483647, loan_id) - 1) % 5 AS INTEGER) AS fold
  FROM loans) GROUP BY ALL""")
def stratified_folds(spark, sf_dir):
    """#130: stratified 5-fold sizes per class (exact, seeded, distributed numbering)."""
    f = SP.stratified_folds(FX.loans(spark, sf_dir).select("loan_id", "TARGET"), "loan_id", "TARGET", 5, 42)
    return f.groupBy("TARGET", "fold").agg(F.count(F.lit(1)).alias("rows"))


@register("temporal_features", W_LOANS + """
SELECT loan_id, CAST(floor(month_no / 3) + 1 AS BIGINT) AS quarter, CAST(floor(month_no / 12) AS BIGINT) AS lookback_period
FROM loans""")
def temporal_features_q(spark, sf_dir):
    """#23/#25: quarter index and 12-month lookback period."""
    lo = FX.loans(spark, sf_dir)
    return lo.select("loan_id", quarter("month_no").alias("quarter"),
                     F.floor(F.col("month_no") / F.lit(12)).cast("bigint").alias("lookback_period"))


@register("age_features", W_LOANS + f"""
SELECT loan_id, {r6('abs(DAYS_BIRTH) / 365.25e0', 'age_years')},
  CASE WHEN abs(DAYS_BIRTH) / 365.25e0 >= 0 AND abs(DAYS_BIRTH) / 365.25e0 <= 25 THEN 'age_group_0'
       WHEN abs(DAYS_BIRTH) / 365.25e0 > 25 AND abs(DAYS_BIRTH) / 365.25e0 <= 45 THEN 'age_group_1'
       WHEN abs(DAYS_BIRTH) / 365.25e0 > 45 AND abs(DAYS_BIRTH) / 365.25e0 <= 65 THEN 'age_group_2'
       WHEN abs(DAYS_BIRTH) / 365.25e0 > 65 AND abs(DAYS_BIRTH) / 365.25e0 <= 100 THEN 'age_group_3' END AS age_group
FROM loans""")
def age_features(spark, sf_dir):
    """#33/#34: age in years from days and its group."""
    yrs = F.abs(F.col("DAYS_BIRTH")) / F.lit(365.25)
    return FX.loans(spark, sf_dir).select("loan_id", yrs.alias("age_years"), age_group(yrs).alias("age_group"))
