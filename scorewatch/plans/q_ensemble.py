"""Registered ensemble, calibration-monitoring and stability queries (#82, #83, #89, #107-128)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.operators import ensemble as EN
from scorewatch.operators import metrics as M
from scorewatch.operators import rankstats as RS
from scorewatch.operators import splits as SP
from scorewatch.operators import stability as ST
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import all_metrics_sql, auc_sql, r6, ranked_sql, with_views
from scorewatch.session import cut_lineage
from scorewatch.sources import fixtures as FX

W_LONG = with_views("scored_long")


_MONTH_AUC = auc_sql(ranked_sql("scored_long", ["model_id", "month_no"]), ["model_id", "month_no"])

_ROLLING_SQL = """SELECT model_id, month_no, n_window, rolling_brier FROM (
  SELECT model_id, month_no, row_number() OVER (PARTITION BY model_id, month_no ORDER BY loan_id DESC) AS r,
    count(*) OVER w AS n_window,
    CASE WHEN count(*) OVER w >= 100 THEN avg((prob - label) * (prob - label)) OVER w ELSE 0e0 END AS rolling_brier
  FROM scored_long WINDOW w AS (PARTITION BY model_id ORDER BY month_no, loan_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
WHERE r = 1"""

# What the weight update of each month reads: rolling score of the monitor, AUC of the month.
_MON_SQL = f"""rb AS ({_ROLLING_SQL}),
ma AS (SELECT model_id, month_no, coalesce(auc_roc, 0.5e0) AS auc_roc FROM ({_MONTH_AUC})),
mon AS (SELECT model_id, month_no, rb.rolling_brier AS brier_score, ma.auc_roc FROM rb JOIN ma USING (model_id, month_no))"""

_MM_SQL = _MON_SQL + """,
mm AS (SELECT model_id, auc_roc, brier_score FROM mon WHERE month_no = (SELECT max(month_no) FROM mon)),
w0 AS (SELECT model_id, 1e0 / count(*) OVER () AS weight FROM mm),
s AS (SELECT mm.model_id, w0.weight, 0.6e0 * auc_roc + 0.4e0 / (brier_score + 1e-8) AS s FROM mm JOIN w0 USING (model_id)),
e AS (SELECT model_id, weight, exp(s - max(s) OVER ()) AS e FROM s),
f AS (SELECT model_id, greatest(0.9e0 * weight + 0.1e0 * (e / sum(e) OVER ()), 0.05e0) AS w FROM e),
nw AS (SELECT model_id, w / sum(w) OVER () AS weight FROM f)"""


def written_scores(spark, sf_dir):
    """`scored_long` as a written table, for queries that pass over the scores several times: range cuts, rolling
    sums and AUC read it, and the joins of the view run once."""
    return cut_lineage(FX.scored_long(spark, sf_dir), "scored-long")


def _monitored(spark, sf_dir, scores=None):
    """Monitor metrics of every model at every month, a small table that is written once."""
    scores = written_scores(spark, sf_dir) if scores is None else scores
    m = EN.monitor_metrics(scores, [], "month_no", ["month_no", "loan_id"])
    return cut_lineage(m, "monitor-metrics")


def _updated(spark, sf_dir):
    mon = _monitored(spark, sf_dir)
    last = mon.agg(F.max("month_no")).first()[0]
    mm = mon.where(F.col("month_no") == last).select("model_id", "auc_roc", "brier_score")
    w0 = EN.equal_weights(mm, [], "model_id")
    return mm, EN.update_weights(mm, w0, [], "model_id", alpha=0.1, min_weight=0.05)


@register("weight_update", W_LONG.rstrip("\n") + ",\n" + _MM_SQL + f"\nSELECT model_id, {r6('weight', 'weight')} FROM nw")
def weight_update(spark, sf_dir):
    """#89/#116: the last month's update from equal weights (alpha 0.1, floor 0.05): rolling Brier score of
    each model's monitor and the month's AUC."""
    return _updated(spark, sf_dir)[1]


@register("weight_stats", W_LONG.rstrip("\n") + ",\n" + _MM_SQL + f"""
SELECT {r6('max(brier_score)', 'max_brier_score')}, {r6('avg(auc_roc)', 'mean_auc')},
  {r6('-sum(weight * ln(weight + 1e-8))', 'weight_entropy')},
  arg_min(model_id, struct_pack(a := -weight, b := model_id)) AS dominant_model, {r6('max(weight)', 'max_weight')},
  max(brier_score) > 0.15e0 AS needs_recalibration, {r6('exp(-sum(weight * ln(weight + 1e-8)))', 'effective_models')},
  CASE WHEN -sum(weight * ln(weight + 1e-8)) > 1.0e0 THEN 'High' WHEN -sum(weight * ln(weight + 1e-8)) > 0.5e0 THEN 'Medium' ELSE 'Low' END AS diversity_level
FROM nw JOIN mm USING (model_id)""")
def weight_stats(spark, sf_dir):
    """#117/#118: update statistics, effective number of models and diversity level."""
    mm, w = _updated(spark, sf_dir)
    return EN.weight_stats(w, mm, [])


@register("ensemble_score", W_LONG.rstrip("\n") + ",\n" + _MM_SQL + f"""
SELECT loan_id, {r6('sum(nw.weight * sl.prob)', 'prob')} FROM scored_long sl JOIN nw USING (model_id) GROUP BY loan_id""")
def ensemble_score(spark, sf_dir):
    """#52/#114/#115: weighted ensemble probability per loan with the updated weights."""
    _, w = _updated(spark, sf_dir)
    return EN.ensemble_score(FX.scored_long(spark, sf_dir), w, ["loan_id"])


@register("rolling_brier", W_LONG + f"SELECT model_id, month_no, n_window, {r6('rolling_brier', 'rolling_brier')} FROM ({_ROLLING_SQL})")
def rolling_brier(spark, sf_dir):
    """#82: rolling Brier over the last 1000 pairs per model, reported at the end of each month."""
    r = EN.rolling_brier(FX.scored_long(spark, sf_dir), ["model_id"], ["month_no", "loan_id"], 1000, 100)
    return EN.batch_reports(r, ["model_id"], "month_no", ["month_no", "loan_id"])


_HIST_SQL = "hist AS (SELECT model_id, month_no, avg((prob - label) * (prob - label)) AS brier FROM scored_long GROUP BY ALL)"


@register("calibration_trend", W_LONG.rstrip("\n") + ",\n" + _HIST_SQL + f"""
SELECT model_id, month_no, {r6('brier', 'brier')},
  {r6('CASE WHEN count(*) OVER w >= 10 THEN -regr_slope(brier, i) OVER w ELSE 0e0 END', 'calibration_trend')}
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model_id ORDER BY month_no) AS DOUBLE) AS i FROM hist)
WINDOW w AS (PARTITION BY model_id ORDER BY month_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def calibration_trend(spark, sf_dir):
    """#83: -slope of the last 10 monthly Brier values per model (0 with fewer)."""
    h = M.brier(FX.scored_long(spark, sf_dir), ["model_id", "month_no"]).select(
        "model_id", "month_no", F.col("brier_score").alias("brier"))
    return EN.calibration_trend(h, ["model_id"], "month_no", "brier", 10)


@register("early_stop", "WITH RECURSIVE " + W_LONG[len("WITH "):].rstrip("\n") + ",\n" + _HIST_SQL + """,
h AS (SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY month_no) AS i, brier AS v FROM hist),
r AS (SELECT model_id, 0 AS i, 'inf'::DOUBLE AS best, 0 AS cnt, NULL::INTEGER AS stop FROM (SELECT DISTINCT model_id FROM h)
  UNION ALL
  SELECT r.model_id, r.i + 1,
    CASE WHEN h.v < r.best - 0.001e0 THEN h.v ELSE r.best END,
    CASE WHEN h.v < r.best - 0.001e0 THEN 0 ELSE r.cnt + 1 END,
    CASE WHEN r.stop IS NOT NULL THEN r.stop WHEN (CASE WHEN h.v < r.best - 0.001e0 THEN 0 ELSE r.cnt + 1 END) >= 5 THEN CAST(r.i + 1 AS INTEGER) END
  FROM r JOIN h ON h.model_id = r.model_id AND h.i = r.i + 1)
SELECT model_id, arg_max(stop, i) AS stop_at, round(arg_max(best, i) * 1e6) / 1e6 AS best_score, CAST(max(i) AS BIGINT) AS steps
FROM r GROUP BY model_id""")
def early_stop(spark, sf_dir):
    """#120: early stopping (min mode, patience 5, delta 0.001) over each model's monthly Brier."""
    h = M.brier(FX.scored_long(spark, sf_dir), ["model_id", "month_no"])
    r = EN.early_stop(h, ["model_id"], "month_no", "brier_score", 5, 0.001, "min")
    return r.select("model_id", "stop_at", "best_score", F.col("steps").cast("bigint").alias("steps"))


@register("weight_trajectory", "WITH RECURSIVE " + W_LONG[len("WITH "):].rstrip("\n") + ",\n" + _MON_SQL + f""",
mt AS (SELECT *, dense_rank() OVER (ORDER BY month_no) AS i, 0.6e0 * auc_roc + 0.4e0 / (brier_score + 1e-8) AS s FROM mon),
t AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS month_no, model_id, 1e0 / count(*) OVER () AS weight FROM (SELECT DISTINCT model_id FROM mt)
  UNION ALL
  SELECT i, month_no, model_id, w / sum(w) OVER () FROM (
    SELECT i, month_no, model_id, greatest(0.9e0 * weight + 0.1e0 * (e / sum(e) OVER ()), 0.05e0) AS w FROM (
      SELECT mt.i, mt.month_no, t.model_id, t.weight, exp(mt.s - max(mt.s) OVER ()) AS e
      FROM t JOIN mt ON mt.i = t.i + 1 AND mt.model_id = t.model_id)))
SELECT month_no, model_id, {r6('weight', 'weight')} FROM t WHERE i > 0""")
def weight_trajectory(spark, sf_dir):
    """#119: weights after every month, one ordered fold from equal weights."""
    return EN.weight_trajectory(_monitored(spark, sf_dir), [], "month_no")


def _early_sql(updates: int = 20, patience: int = 5) -> str:
    auc = auc_sql(ranked_sql("vl", ["model_id"]), ["model_id"])
    ens = auc_sql(ranked_sql("ens", ["u"]), ["u"])
    return "WITH RECURSIVE " + with_views("loans_split", "scored_long")[len("WITH "):].rstrip("\n") + f""",
vl AS (SELECT s.* FROM scored_long s WHERE month_no >= 40 AND month_no < 55),
wh AS (SELECT model_id, count(*) AS n, sum((prob - label) * (prob - label)) AS s_all FROM vl GROUP BY model_id),
la AS (SELECT model_id, sum(sq) AS s_last FROM (SELECT model_id, (prob - label) * (prob - label) AS sq, row_number() OVER (PARTITION BY model_id ORDER BY month_no DESC, loan_id DESC) AS r FROM vl)
  JOIN wh USING (model_id) WHERE r <= 1000 % n GROUP BY model_id),
mon AS (SELECT u, model_id, 0.6e0 * coalesce(auc_roc, 0.5e0) + 0.4e0 / (CASE WHEN held >= 100 THEN (held // n * s_all + CASE WHEN held % n > 0 THEN s_last ELSE 0e0 END) / held ELSE 0e0 END + 1e-8) AS s
  FROM (SELECT t.u, wh.*, la.s_last, a.auc_roc, least(1000, t.u * wh.n) AS held FROM range(1, {updates}) t(u) CROSS JOIN wh LEFT JOIN la USING (model_id) JOIN ({auc}) a USING (model_id))),
w AS (SELECT CAST(0 AS BIGINT) AS u, model_id, 1e0 / count(*) OVER () AS weight FROM wh
  UNION ALL
  SELECT u, model_id, x / sum(x) OVER () FROM (SELECT u, model_id, greatest(0.9e0 * weight + 0.1e0 * (e / sum(e) OVER ()), 0.05e0) AS x FROM (
    SELECT m.u, m.model_id, w.weight, exp(m.s - max(m.s) OVER ()) AS e FROM w JOIN mon m ON m.u = w.u + 1 AND m.model_id = w.model_id))),
ens AS (SELECT w.u, vl.loan_id, vl.label, least(sum(w.weight * vl.prob), 1e0) AS prob FROM vl JOIN w USING (model_id) GROUP BY ALL),
ev AS (SELECT u, coalesce(auc_roc, 0.5e0) AS auc_roc FROM ({ens})),
st AS (SELECT u, auc_roc, auc_roc AS best, 0 AS misses FROM ev WHERE u = 0
  UNION ALL
  SELECT ev.u, ev.auc_roc, CASE WHEN ev.auc_roc > st.best + 0.001e0 THEN ev.auc_roc ELSE st.best END, CASE WHEN ev.auc_roc > st.best + 0.001e0 THEN 0 ELSE st.misses + 1 END
  FROM st JOIN ev ON ev.u = st.u + 1 WHERE st.misses < {patience})
SELECT CAST(st.u AS INTEGER) AS update, w.model_id, {r6('w.weight', 'weight')}, {r6('st.auc_roc', 'auc_roc')}, st.misses >= {patience} AS stopped FROM st JOIN w USING (u)"""


@register("early_stopped_updates", _early_sql())
def early_stopped_updates(spark, sf_dir):
    """#119/#120: weights updated on the validation months until the ensemble's AUC stops rising (at most 20
    evaluations, patience 5)."""
    val = cut_lineage(FX.scored_long(spark, sf_dir).where("month_no >= 40 AND month_no < 55"), "validation-scores")
    return EN.early_stopped_updates(val, ["month_no", "loan_id"], "loan_id")


@register("fold_brier", with_views("loans") + f"""
SELECT fold, count(*) AS n, {r6('avg((score_c - TARGET) * (score_c - TARGET))', 'brier_score')} FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY (loan_id * 48271 + 42) % 2147483647, loan_id) - 1) % 3 AS INTEGER) AS fold
  FROM loans) GROUP BY fold""")
def fold_brier(spark, sf_dir):
    """#123: 3-fold stratified Brier of the mixed score."""
    f = SP.stratified_folds(FX.loans(spark, sf_dir), "loan_id", "TARGET", 3, 42).select(
        "fold", F.col("TARGET").alias("label"), F.col("score_c").alias("prob"))
    return M.brier(f, ["fold"])


@register("composite_stability", W_LONG.rstrip("\n") + f""",
s AS (SELECT model_id, avg((prob - label) * (prob - label)) AS brier, stddev_pop(prob) AS p_std FROM scored_long GROUP BY model_id),
h AS (SELECT model_id, month_no, auc_roc, CAST(row_number() OVER (PARTITION BY model_id ORDER BY month_no) - 1 AS DOUBLE) AS x FROM ({_MONTH_AUC})),
t AS (SELECT model_id, regr_slope(auc_roc, x) AS slope, count(*) AS n_hist FROM h GROUP BY model_id),
m AS (SELECT s.*, t.slope, t.n_hist,
   1e0 - least(greatest(brier, 0e0), 1e0) AS calib,
   least(greatest(1e0 / (1e0 + p_std), 0e0), 1e0) AS consist,
   CASE WHEN coalesce(n_hist, 0) < 2 THEN 1e0 ELSE least(greatest(0.5e0 + tanh(slope * 10e0) * 0.5e0, 0e0), 1e0) END AS trend
   FROM s LEFT JOIN t USING (model_id))
SELECT model_id, {r6('calib', 'calibration_score')}, {r6('consist', 'consistency_score')}, {r6('trend', 'trend_score')},
  {r6('least(greatest(0.3e0 * calib + 0.4e0 * consist + 0.3e0 * trend, 0e0), 1e0)', 'stability_score')} FROM m""")
def composite_stability(spark, sf_dir):
    """#124-#127: 0.3 calibration + 0.4 consistency + 0.3 trend of monthly AUC, per model."""
    sl = FX.scored_long(spark, sf_dir)
    hist = RS.auc_roc(sl, ["model_id", "month_no"]).select("model_id", "month_no", F.col("auc_roc").alias("value"))
    return ST.composite_stability(sl, hist, ["model_id"], hist_order="month_no", hist_value="value")


_IMP_FEATS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "revol_util", "CNT_ITEMS"]


@register("weighted_importance", with_views("loans") + f"""
, imp AS ({' UNION ALL '.join(f"SELECT '{m}' AS model_id, '{f}' AS feature, abs(corr({f}, score_{m})) AS importance FROM loans" for m in 'abc' for f in _IMP_FEATS)}),
s AS (SELECT feature, sum(importance / 3e0) AS s FROM imp GROUP BY feature)
SELECT feature, {r6('s / sum(s) OVER ()', 'importance')} FROM s""".replace(with_views("loans") + "\n, imp", with_views("loans").rstrip("\n") + ",\nimp"))
def weighted_importance(spark, sf_dir):
    """#128: weight-averaged feature importance (|corr(feature, model score)|), normalised to 1."""
    lo = FX.loans(spark, sf_dir)
    imp = lo.agg(*[F.abs(F.corr(f, f"score_{m}")).alias(f"{m}|{f}") for m in "abc" for f in _IMP_FEATS])
    parts = ", ".join(f"'{m}', '{f}', `{m}|{f}`" for m in "abc" for f in _IMP_FEATS)
    long = imp.selectExpr(f"stack({3 * len(_IMP_FEATS)}, {parts}) AS (model_id, feature, importance)")
    w = EN.equal_weights(long, [], "model_id")
    return EN.weighted_importance(long, w)


_STAB_METRICS = ["auc_roc", "brier_score", "default_rate"]
_PERIOD_SQL = f"""pm AS (SELECT a.model_id, a.month_no, CASE WHEN a.n_pos = 0 OR a.n_neg = 0 THEN 0.5e0 ELSE a.auc_roc END AS auc_roc,
   b.brier_score, b.default_rate FROM ({_MONTH_AUC}) a
   JOIN (SELECT model_id, month_no, avg((prob - label) * (prob - label)) AS brier_score, avg(label) AS default_rate
         FROM scored_long GROUP BY ALL) b USING (model_id, month_no)),
st AS (SELECT model_id, metric, count(*) AS periods, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max
   FROM (UNPIVOT pm ON {', '.join(_STAB_METRICS)} INTO NAME metric VALUE value) GROUP BY model_id, metric HAVING count(*) > 1),
sts AS (SELECT model_id, metric, mean, std, min, max, max - min AS range, CASE WHEN mean <> 0 THEN std / mean ELSE 'inf'::DOUBLE END AS cv FROM st)"""


def _period_metrics(spark, sf_dir):
    return M.all_metrics(FX.scored_long(spark, sf_dir), ["model_id", "month_no"])


def _stability_stats(spark, sf_dir):
    return ST.stability_stats(_period_metrics(spark, sf_dir), _STAB_METRICS, ["model_id"])


@register("stability_stats", W_LONG.rstrip("\n") + ",\n" + _PERIOD_SQL + f"""
SELECT model_id, metric, {r6('mean', 'mean')}, {r6('std', 'std')}, {r6('min', 'min')}, {r6('max', 'max')}, {r6('range', 'range')}, {r6('cv', 'cv')} FROM sts""")
def stability_stats(spark, sf_dir):
    """#108: mean, population std, min, max, range and cv of monthly metrics of every model."""
    return _stability_stats(spark, sf_dir)


_SCORE_SQL = ("0.5e0 * least(coalesce(max(CASE WHEN metric = 'auc_roc' THEN cv END), 'inf'::DOUBLE), 1e0)"
              " + 0.5e0 * least(coalesce(max(CASE WHEN metric = 'brier_score' THEN cv END), 'inf'::DOUBLE), 1e0)")


@register("stability_score", W_LONG.rstrip("\n") + ",\n" + _PERIOD_SQL + f"""
SELECT model_id, {r6(_SCORE_SQL, 'overall_stability_score')},
  CASE WHEN {_SCORE_SQL} < 0.1e0 THEN 'Good' WHEN {_SCORE_SQL} < 0.2e0 THEN 'Moderate' ELSE 'Needs attention' END AS stability_level
FROM sts GROUP BY model_id""")
def stability_score(spark, sf_dir):
    """#109/#110: overall stability score and level of every model."""
    return ST.stability_score(_stability_stats(spark, sf_dir), ["model_id"])


@register("target_check", W_LONG + f"""
SELECT model_id, metric, value, target, met FROM (
  SELECT model_id, metric, value,
    CASE metric WHEN 'auc_roc' THEN 0.82e0 WHEN 'brier_score' THEN 0.12e0 ELSE 0.05e0 END AS target,
    CASE WHEN metric = 'auc_roc' THEN value >= 0.82e0 WHEN metric = 'brier_score' THEN value <= 0.12e0 ELSE value <= 0.05e0 END AS met
  FROM (UNPIVOT ({all_metrics_sql('scored_long', ['model_id'])}) ON auc_roc, brier_score, calibration_error INTO NAME metric VALUE value))""")
def target_check(spark, sf_dir):
    """#111: metric rows per model checked against the configured targets."""
    m = M.all_metrics(FX.scored_long(spark, sf_dir), ["model_id"])
    long = ST.to_long(m, ["model_id"], ["auc_roc", "brier_score", "calibration_error"])
    return ST.target_check(long, ST.target_table(spark))


@register("generalisation", with_views("scored_long", "doc_quality") + f"""
SELECT model_id, {r6('a.auc_roc', 'auc_loans')}, {r6('b.auc_roc', 'auc_docs')}, {r6('abs(a.auc_roc - b.auc_roc)', 'auc_gap')},
  CASE WHEN abs(a.auc_roc - b.auc_roc) < 0.1e0 THEN 'Good' ELSE 'Needs attention' END AS generalisation
FROM ({auc_sql(ranked_sql('scored_long', ['model_id']), ['model_id'])}) a
CROSS JOIN ({auc_sql(ranked_sql('doc_quality', []), [])}) b""")
def generalisation(spark, sf_dir):
    """#112: AUC gap of every model between two datasets (loans vs document quality scores)."""
    a = RS.auc_roc(FX.scored_long(spark, sf_dir), ["model_id"]).select("model_id", F.col("auc_roc").alias("auc_loans"))
    docs = RS.auc_roc(FX.doc_quality(spark, sf_dir), []).first()["auc_roc"]  # one number
    return a.withColumn("auc_docs", F.lit(docs).cast("double")).select(
        "model_id", "auc_loans", "auc_docs", F.abs(F.col("auc_loans") - F.col("auc_docs")).alias("auc_gap"),
        ST.generalisation_expr("auc_loans", "auc_docs").alias("generalisation"))


def _advice_sql() -> str:
    from scorewatch.plans.q_drift import REPORT_CTES, SCORE_SQL

    rules = [("auc_roc < 0.82e0", ST.ADVICE_AUC), ("calibration_error > 0.05e0", ST.ADVICE_ECE), ("drift > 0.2e0", ST.ADVICE_DRIFT),
             ("entropy < 0.5e0", ST.ADVICE_DIVERSITY), ("stability > 0.15e0", ST.ADVICE_STABILITY)]
    fired = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + "], lambda x: x IS NOT NULL)"
    ok = "[" + ", ".join(f"'{t}'" for t in ST.ADVICE_OK) + "]"
    return with_views("scored_long", "loans_shift").rstrip("\n") + ",\n" + REPORT_CTES + ",\n" + _MM_SQL + ",\n" + _PERIOD_SQL + f""",
x AS (SELECT m.model_id, m.auc_roc, m.calibration_error, (SELECT {SCORE_SQL} FROM summ s CROSS JOIN pred p) AS drift,
   (SELECT -sum(weight * ln(weight + 1e-8)) FROM nw) AS entropy, z.stability
  FROM ({all_metrics_sql('scored_long', ['model_id'])}) m
  JOIN (SELECT model_id, {_SCORE_SQL} AS stability FROM sts GROUP BY model_id) z USING (model_id))
SELECT model_id, CASE WHEN len({fired}) = 0 THEN {ok} ELSE {fired} END AS advice FROM x"""


@register("advice", _advice_sql())
def advice(spark, sf_dir):
    """#113: final advice for every model from its metrics and stability, the drift score and the
    entropy of the ensemble's weights."""
    from scorewatch.plans.q_drift import _report

    m = M.all_metrics(FX.scored_long(spark, sf_dir), ["model_id"]).select("model_id", "auc_roc", "calibration_error")
    drift = _report(spark, sf_dir).first()["overall_drift_score"]  # one number each
    mm, w = _updated(spark, sf_dir)
    entropy = EN.weight_stats(w, mm, []).first()["weight_entropy"]
    j = m.join(ST.stability_score(_stability_stats(spark, sf_dir), ["model_id"]), "model_id")
    return j.select("model_id", ST.advice("auc_roc", "calibration_error", F.lit(drift), F.lit(entropy), "overall_stability_score").alias("advice"))
