"""Registered training, calibration, sink and state queries (#7-10, #121-122, #129-134)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.operators import calibration as CA
from scorewatch.operators import ensemble as EN
from scorewatch.operators import fitted as FT
from scorewatch.operators import metrics as M
from scorewatch.operators import training as TR
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import all_metrics_sql, auc_sql, r6, ranked_sql, with_views
from scorewatch.session import cut_lineage, scratch_path
from scorewatch.sources import fixtures as FX
from scorewatch.sources import io as IO

FEATS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "revol_util", "DAYS_BIRTH", "CNT_ITEMS"]


def _train_frame(spark, sf_dir):
    """Imputed features of every loan: a written table, as folds, fits and the test split each read it."""
    ls = FX.loans_split(spark, sf_dir).select("loan_id", "split", F.col("TARGET").alias("label"), *FEATS)
    return cut_lineage(FT.apply_impute(ls, FEATS, []), "train-frame")


@register("train_base", None)
def train_base(spark, sf_dir):
    """#129: Spark ML base learners fit on the train split, metrics on the test split."""
    d = _train_frame(spark, sf_dir)
    models = TR.train_base(d.where(F.col("split") == "train"), FEATS, "label")
    sl = TR.score_long(models, d.where(F.col("split") == "test"), ["loan_id"], "label")
    return M.all_metrics(sl, ["model_id"]).select("model_id", "n", "auc_roc", "brier_score", "calibration_error")


#: Written fold scores by application and folder: both keys below read one cross-validation.
_FOLD_SCORES: dict[tuple[str, str], object] = {}


def fold_scores(spark, sf_dir):
    """Scores of every fold of train+val, features fitted per fold: a written table, made once for an
    application and a folder. A fold that fails fails the query: a summary of the others would look like a whole one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLD_SCORES:
        ls = FX.loans_split(spark, sf_dir).where(F.col("split") != "test").select("loan_id", F.col("TARGET").alias("label"), "month_no", *FEATS)
        ls = cut_lineage(ls, "cv-rows")
        _FOLD_SCORES[key] = cut_lineage(TR.fold_scores(ls, None, "loan_id", "label", max_failed=0.0, pipeline=lambda: FT.FeaturePipeline(label="label", exclude=["loan_id"])), "cv-scores")
    return _FOLD_SCORES[key]


@register("cross_validate", None)
def cross_validate(spark, sf_dir):
    """#131/#132/#136: 5-fold stratified CV of the equal-weight ensemble on train+val, features fitted per fold."""
    return M.all_metrics(fold_scores(spark, sf_dir), ["fold"]).select("fold", "n", "auc_roc", "brier_score", "calibration_error")


@register("cv_summary", None)
def cv_summary(spark, sf_dir):
    """#131: mean / population std of fold metrics and the best fold."""
    return TR.cv_summary(M.all_metrics(fold_scores(spark, sf_dir), ["fold"]))


def isotonic_sql(src: str, by: list[str], out: str) -> str:
    """CTE `out` (by..., lo, hi, n, value, next_lo, next_value): slopes of the greatest convex minorant of the
    cumulated labels, walked from corner to corner. Needs WITH RECURSIVE."""
    b, part = ", ".join(by), f"PARTITION BY {', '.join(by)}"
    on = " AND ".join(f"{out}_c.{c} = h.{c}" for c in by)
    hb = ", ".join(f"h.{c}" for c in by)
    return f"""{out}_c AS (SELECT {b}, x, row_number() OVER w AS i, CAST(sum(n) OVER w AS BIGINT) AS w, CAST(sum(s) OVER w AS BIGINT) AS s
  FROM (SELECT {b}, prob AS x, count(*) AS n, sum(label) AS s FROM {src} GROUP BY ALL) WINDOW w AS ({part} ORDER BY x)),
{out}_h AS (SELECT DISTINCT {b}, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS s FROM {out}_c
  UNION ALL
  SELECT {b}, t.i, t.w, t.s FROM (
    SELECT {hb}, arg_min(struct_pack(i := {out}_c.i, w := {out}_c.w, s := {out}_c.s),
      struct_pack(m := CAST({out}_c.s - h.s AS DOUBLE) / CAST({out}_c.w - h.w AS DOUBLE), d := -{out}_c.i)) AS t
    FROM {out}_h h JOIN {out}_c ON {on} AND {out}_c.i > h.i GROUP BY ALL)),
{out}_b AS (SELECT * FROM (SELECT *, lag(i) OVER v AS i0, w - lag(w) OVER v AS n, s - lag(s) OVER v AS k FROM {out}_h WINDOW v AS ({part} ORDER BY i)) WHERE i > 0),
{out} AS (SELECT *, lead(lo) OVER v AS next_lo, lead(value) OVER v AS next_value, first_value(value) OVER v AS least FROM (
  SELECT {', '.join(f'z.{c}' for c in by)}, a.x AS lo, e.x AS hi, z.n, CAST(z.k AS DOUBLE) / CAST(z.n AS DOUBLE) AS value FROM {out}_b z
  JOIN {out}_c a ON {' AND '.join(f'a.{c} = z.{c}' for c in by)} AND a.i = z.i0 + 1 JOIN {out}_c e ON {' AND '.join(f'e.{c} = z.{c}' for c in by)} AND e.i = z.i)
  WINDOW v AS ({part} ORDER BY lo))"""


_CALIBRATED = """CASE WHEN b.lo IS NULL THEN f.least WHEN t.prob <= b.hi OR b.next_lo IS NULL THEN b.value
    ELSE b.value + (b.next_value - b.value) * ((t.prob - b.hi) / (b.next_lo - b.hi)) END"""
_RECURSIVE = lambda *views: "WITH RECURSIVE " + with_views(*views)[len("WITH "):].rstrip("\n")
_ISO_SQL = _RECURSIVE("split_long") + """,
tr AS (SELECT * FROM split_long WHERE split = 'train' AND prob IS NOT NULL),
""" + isotonic_sql("tr", ["model_id"], "iso")


def _train_calibration(spark, sf_dir):
    lo = FX.loans_split(spark, sf_dir)
    sl = lo.select("split", F.col("TARGET").alias("label"), F.expr("stack(3, 'a', score_a, 'b', score_b, 'c', score_c) AS (model_id, prob)"))
    return sl, CA.fit_isotonic(sl.where(F.col("split") == "train"), by=["model_id"])


@register("isotonic_blocks", _ISO_SQL + f"""
SELECT model_id, {r6('lo', 'lo')}, {r6('hi', 'hi')}, n, {r6('value', 'value')} FROM iso""")
def isotonic_blocks(spark, sf_dir):
    """#121: the calibration of every model's scores on train, block by block."""
    b = _train_calibration(spark, sf_dir)[1].blocks
    return b.select("model_id", "lo", "hi", F.col("w").alias("n"), (F.col("s") / F.col("w")).alias("value"))


@register("isotonic", _ISO_SQL + f"""
SELECT t.model_id, {r6('avg((t.prob - t.label) * (t.prob - t.label))', 'brier_raw')}, {r6(f'avg(({_CALIBRATED} - t.label) * ({_CALIBRATED} - t.label))', 'brier_calibrated')}
FROM (SELECT * FROM split_long WHERE split = 'test' AND prob IS NOT NULL) t ASOF LEFT JOIN iso b ON t.model_id = b.model_id AND t.prob >= b.lo
JOIN (SELECT model_id, any_value(least) AS least FROM iso GROUP BY model_id) f ON f.model_id = t.model_id GROUP BY t.model_id""")
def isotonic(spark, sf_dir):
    """#121: isotonic calibration of every model on train, applied to test; Brier score before and after."""
    sl, cal = _train_calibration(spark, sf_dir)
    test = CA.apply_isotonic(sl.where((F.col("split") == "test") & F.col("prob").isNotNull()), cal)
    sq = lambda c: F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label")))
    return test.groupBy("model_id").agg(sq("prob").alias("brier_raw"), sq("calibrated").alias("brier_calibrated"))


def _recalibration_sql() -> str:
    from scorewatch.plans.q_ensemble import _MON_SQL

    return _RECURSIVE("scored_long") + ",\n" + _MON_SQL + f""",
called AS (SELECT s.* FROM scored_long s JOIN mon USING (model_id, month_no) WHERE mon.brier_score > 0.15e0 AND s.prob IS NOT NULL),
fit AS (SELECT * FROM called WHERE (model_id, month_no) IN (SELECT (model_id, month_no) FROM called GROUP BY model_id, month_no HAVING count(*) >= {CA.MIN_ROWS})),
""" + isotonic_sql("fit", ["model_id", "month_no"], "iso") + f""",
cals AS (SELECT model_id, month_no AS cal_month, any_value(least) AS least FROM iso GROUP BY ALL),
t AS (SELECT s.model_id, s.month_no, s.prob, s.label, c.cal_month, c.least FROM (SELECT * FROM scored_long WHERE prob IS NOT NULL) s
  ASOF LEFT JOIN cals c ON s.model_id = c.model_id AND s.month_no > c.cal_month),
u AS (SELECT t.model_id, t.month_no, t.cal_month, t.prob, t.label,
    CASE WHEN t.cal_month IS NULL THEN t.prob ELSE {_CALIBRATED.replace('f.least', 't.least')} END AS calibrated
  FROM t ASOF LEFT JOIN iso b ON t.model_id = b.model_id AND t.cal_month = b.month_no AND t.prob >= b.lo)
SELECT model_id, month_no, cal_month, {r6('avg((prob - label) * (prob - label))', 'brier_raw')}, {r6('avg((calibrated - label) * (calibrated - label))', 'brier_calibrated')}
FROM u GROUP BY ALL"""


@register("recalibration", _recalibration_sql())
def recalibration(spark, sf_dir):
    """#121: wherever a model's monitor calls for it at the end of a month (rolling Brier above 0.15), a
    calibration is fitted on that month; every month is scored through the latest one before it.
    All calibrations are one fit; the latest ones (models times months) are broadcast, the scores are not shuffled for them."""
    from scorewatch.plans.q_ensemble import _monitored, written_scores

    scores = written_scores(spark, sf_dir)
    sl = scores.where("prob IS NOT NULL")
    calls = _monitored(spark, sf_dir, scores).where(F.col("brier_score") > EN.RECALIBRATION_THRESHOLD).select("model_id", "month_no")
    cal = CA.fit_isotonic(sl.join(calls, ["model_id", "month_no"]), by=["model_id", "month_no"])
    made = cal.blocks.select(F.col("model_id").alias("m"), F.col("month_no").alias("c")).distinct()
    months = sl.select("model_id", "month_no").distinct()
    latest = months.join(made, (F.col("model_id") == F.col("m")) & (F.col("c") < F.col("month_no")), "left").groupBy("model_id", "month_no").agg(F.max("c").alias("cal_month"))
    rows = sl.join(F.broadcast(latest), ["model_id", "month_no"]).select("model_id", F.col("month_no").alias("month"), F.col("cal_month").alias("month_no"), "prob", "label")
    out = CA.apply_isotonic(rows, cal)
    sq = lambda c: F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label")))
    return out.groupBy("model_id", "month", "month_no").agg(sq("prob").alias("brier_raw"), sq("calibrated").alias("brier_calibrated")).select(
        "model_id", F.col("month").alias("month_no"), F.col("month_no").alias("cal_month"), "brier_raw", "brier_calibrated")


@register("calibrated_cv", None)
def calibrated_cv(spark, sf_dir):
    """#122: base learners cross-fitted with isotonic calibration on train, metrics per learner on test."""
    d = _train_frame(spark, sf_dir)
    folds, cal = TR.calibrated_cv(d.where(F.col("split") == "train"), FEATS, "loan_id", "label")
    sl = TR.score_calibrated(folds, cal, d.where(F.col("split") == "test"), ["loan_id"], "label")
    return M.all_metrics(sl, ["model_id"]).select("model_id", "n", "auc_roc", "brier_score", "calibration_error")


#: alpha, min_weight, window, recalibration threshold of every trial
GRID = EN.search_points()


def _search_sql() -> str:
    rows = ", ".join(f"({i}, {a!r}e0, {f!r}e0, {n}, {t!r}e0)" for i, (a, f, n, t) in enumerate(GRID))
    roll = " UNION ALL ".join(
        f"""SELECT model_id, month_no, {n} AS win, rb FROM (SELECT model_id, month_no, row_number() OVER (PARTITION BY model_id, month_no ORDER BY loan_id DESC) AS r,
    CASE WHEN count(*) OVER w >= 100 THEN avg((prob - label) * (prob - label)) OVER w ELSE 0e0 END AS rb
  FROM hist WINDOW w AS (PARTITION BY model_id ORDER BY month_no, loan_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE r = 1"""
        for n in sorted({g[2] for g in GRID}))
    auc = auc_sql(ranked_sql("hist", ["model_id", "month_no"]), ["model_id", "month_no"])
    return "WITH RECURSIVE " + with_views("scored_long")[len("WITH "):].rstrip("\n") + f""",
hist AS (SELECT * FROM scored_long WHERE month_no < 55),
g(cand, alpha, floor, win, threshold) AS (VALUES {rows}),
mon AS (SELECT g.*, r.model_id, r.month_no, r.rb, 0.6e0 * coalesce(a.auc_roc, 0.5e0) + 0.4e0 / (r.rb + 1e-8) AS s, dense_rank() OVER (ORDER BY r.month_no) AS i
  FROM ({roll}) r JOIN ({auc}) a USING (model_id, month_no) JOIN g ON g.win = r.win),
t AS (SELECT CAST(0 AS BIGINT) AS i, cand, model_id, 1e0 / count(*) OVER (PARTITION BY cand) AS weight FROM (SELECT DISTINCT cand, model_id FROM mon)
  UNION ALL
  SELECT i, cand, model_id, w / sum(w) OVER (PARTITION BY cand) FROM (
    SELECT i, cand, model_id, greatest((1e0 - alpha) * weight + alpha * (e / sum(e) OVER (PARTITION BY cand)), floor) AS w FROM (
      SELECT m.i, t.cand, t.model_id, m.alpha, m.floor, t.weight, exp(m.s - max(m.s) OVER (PARTITION BY t.cand)) AS e
      FROM t JOIN mon m ON m.i = t.i + 1 AND m.model_id = t.model_id AND m.cand = t.cand))),
fin AS (SELECT cand, model_id, weight FROM t WHERE i = (SELECT max(i) FROM t)),
ens AS (SELECT f.cand, x.loan_id, x.label, least(sum(f.weight * x.prob), 1e0) AS prob FROM scored_long x JOIN fin f USING (model_id) WHERE x.month_no >= 55 GROUP BY ALL),
calls AS (SELECT cand, count_if(b > threshold) AS recalibrations FROM (SELECT cand, threshold, month_no, max(rb) AS b FROM mon GROUP BY ALL) GROUP BY cand)
SELECT g.cand, {r6('g.alpha', 'alpha')}, {r6('g.floor', 'min_weight')}, g.win AS window, {r6('g.threshold', 'threshold')}, {r6('z.auc_roc', 'auc_roc')}, calls.recalibrations
FROM ({auc_sql(ranked_sql('ens', ['cand']), ['cand'])}) z JOIN g USING (cand) JOIN calls USING (cand)"""


@register("search_weights", _search_sql())
def search_weights(spark, sf_dir):
    """#133: search over alpha, floor, monitor window and recalibration threshold by replayed trajectories; AUC on the test split."""
    from scorewatch.plans.q_ensemble import written_scores

    sl = written_scores(spark, sf_dir)
    ev = sl.where(F.col("month_no") >= 55).select("loan_id", "model_id", "label", "prob")
    return EN.search_weights(sl.where(F.col("month_no") < 55), ev, GRID, "month_no", ["month_no", "loan_id"])


@register("evaluate_split", None)
def evaluate_split(spark, sf_dir):
    """#134/#135: feature pipeline fit on train, models trained, test scored and evaluated; with the
    importance of the most important feature under the ensemble's weights."""
    ls = FX.loans_split(spark, sf_dir).drop("score_a", "score_b", "score_c", "customer_id")
    ls = cut_lineage(ls, "evaluate-rows")  # the fit, the training rows and the test rows read it
    pipe = FT.FeaturePipeline(label="TARGET", exclude=["loan_id", "split"])
    pipe.fit(ls.where(F.col("split") == "train"))
    tr = pipe.transform(ls.where(F.col("split") == "train"), keep=["loan_id", "TARGET"])
    feats = [c for c in tr.columns if c not in ("loan_id", "TARGET")]
    models = TR.train_base(tr, feats, "TARGET")
    w = EN.equal_weights(TR.importances(models, feats), [], "model_id")
    path = scratch_path(spark, "bundle")
    TR.Bundle(models, pipe, w).save(spark, path)
    loaded = TR.Bundle.load(spark, path)  # what is evaluated is what was saved
    sl = loaded.score(ls.where(F.col("split") == "test"), "loan_id", "TARGET")
    ens = EN.ensemble_score(sl, loaded.weights, ["loan_id", "label"])
    top = EN.weighted_importance(TR.importances(loaded.models, feats), w).orderBy(F.desc("importance"), "feature").first()
    m = M.all_metrics(ens, []).select("n", "auc_roc", "auc_pr", "brier_score", "calibration_error", "f1_score")
    return m.select("*", F.lit(top["feature"]).alias("top_feature"), F.lit(top["importance"]).alias("top_importance"))


@register("predictions_sink", with_views("loans") + f"""
SELECT TARGET AS actual, {r6('score_c', 'predicted_proba')}, CAST(score_c > 0.5e0 AS INTEGER) AS predicted_class FROM loans""")
def predictions_sink(spark, sf_dir):
    """#7: write actual / predicted_proba / predicted_class to parquet and read it back."""
    path = scratch_path(spark, "predictions")
    lo = FX.loans(spark, sf_dir).select(F.col("TARGET").alias("label"), F.col("score_c").alias("prob"))
    IO.write_predictions(lo, path)
    return spark.read.parquet(path)


@register("scored_sink", with_views("loans") + f"""
SELECT loan_id, {r6('score_c', 'predicted_proba')}, CAST(score_c > 0.5e0 AS INTEGER) AS predicted_class,
  CASE WHEN score_c > 0e0 AND score_c <= 0.3e0 THEN 'Low' WHEN score_c > 0.3e0 AND score_c <= 0.6e0 THEN 'Medium'
       WHEN score_c > 0.6e0 AND score_c <= 1e0 THEN 'High' END AS risk_band,
  CASE WHEN score_c < 0.5e0 THEN 'Approve' WHEN score_c IS NOT NULL THEN 'Reject' END AS recommendation
FROM loans""")
def scored_sink(spark, sf_dir):
    """#8: scored file with band and recommendation (parquet round trip)."""
    path = scratch_path(spark, "scored")
    IO.write_scored(FX.loans(spark, sf_dir), path, "score_c", ["loan_id"], fmt="parquet")
    return spark.read.parquet(path)


@register("json_sink", with_views("scored_long") + all_metrics_sql("scored_long", ["model_id"]))
def json_sink(spark, sf_dir):
    """#9: metric rows written as JSON lines and read back."""
    path = scratch_path(spark, "metrics-json")
    IO.write_json_rows(M.all_metrics(FX.scored_long(spark, sf_dir), ["model_id"]), path)
    return spark.read.json(path)


def _state_sql() -> str:
    from scorewatch.plans.q_ensemble import _MM_SQL

    return with_views("scored_long").rstrip("\n") + ",\n" + _MM_SQL + f"\nSELECT model_id, {r6('weight', 'weight')}, {len(FEATS)} AS n_columns FROM nw"


@register("state_roundtrip", _state_sql())
def state_roundtrip(spark, sf_dir):
    """#10: save weights + feature names + parameters, load them back."""
    from scorewatch.plans.q_ensemble import _updated

    _, w = _updated(spark, sf_dir)
    path = scratch_path(spark, "state")
    IO.save_state(spark, path, weights=w, columns=FEATS, params={"alpha": 0.1, "min_weight": 0.05})
    st = IO.load_state(spark, path)
    return st["weights"].withColumn("n_columns", F.lit(len(st["columns"])))
