"""Registered drift queries (#53, #54, #84, #88, #90-106)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.functions.columns import lin_edges
from scorewatch.operators import drift as D
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import (
    all_metrics_sql, auc_sql, chi2_sf_sql, dlit, edge_bin_sql, ks_p_sql, ks_sql, long_sql, r6, ranked_sql, with_views,
)
from scorewatch.sources import fixtures as FX

FEATURES = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "revol_util", "DAYS_BIRTH", "CNT_ITEMS", "score_b"]


def _ref_cur(spark, sf_dir):
    return D.split_frame(FX.loans_shift(spark, sf_dir), "is_current")


_LONG = long_sql("loans_shift", FEATURES, "is_current")
_W = with_views("loans_shift")


@register("ks_drift", _W + ks_sql(_LONG))
def ks_drift(spark, sf_dir):
    """#90/#91: KS per feature, months < 40 vs >= 40 with forced drift."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.ks_drift(ref, cur, FEATURES)


@register("ecdf", _W + f"""
SELECT feature, {r6("value", "value")},
  {r6("CAST(sum(c_ref) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(c_ref) OVER (PARTITION BY feature) AS DOUBLE)", "cdf_ref")},
  {r6("CAST(sum(c_cur) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(c_cur) OVER (PARTITION BY feature) AS DOUBLE)", "cdf_cur")},
  CAST(sum(c_ref) OVER (PARTITION BY feature) AS BIGINT) AS n_ref, CAST(sum(c_cur) OVER (PARTITION BY feature) AS BIGINT) AS n_cur
FROM (SELECT feature, value, count_if(NOT is_cur) AS c_ref, count_if(is_cur) AS c_cur FROM ({_LONG}) GROUP BY feature, value)
""")
def ecdf(spark, sf_dir):
    """#88: both empirical CDFs at every distinct value, per feature."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.ecdf(ref, cur, FEATURES)


def _bin_sql(x: str, lo: str, step: str, hi: str, nb: int) -> str:
    return edge_bin_sql(x, lo, step, hi, nb)


_JS_SQL = _W + f"""
, long AS ({_LONG}),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
binned AS (SELECT l.feature, l.is_cur, {_bin_sql('l.value', 'r.lo', '((r.hi - r.lo) / 49e0)', 'r.hi', 49)} AS bin
           FROM long l JOIN rng r ON l.feature = r.feature WHERE r.hi > r.lo),
counts AS (SELECT feature, bin, count_if(NOT is_cur) AS c_ref, count_if(is_cur) AS c_cur FROM binned GROUP BY feature, bin),
probs AS (SELECT feature, bin, c_ref / sum(c_ref) OVER (PARTITION BY feature) AS p, c_cur / sum(c_cur) OVER (PARTITION BY feature) AS q FROM counts),
js AS (SELECT feature, (sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2e0)) ELSE 0e0 END)
                      + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2e0)) ELSE 0e0 END)) / 2e0 AS div FROM probs GROUP BY feature)
SELECT r.feature, {r6('sqrt(js.div)', 'js_distance')}, {r6('js.div', 'js_divergence')},
  coalesce(sqrt(js.div) > 0.1e0, false) AS is_drift
FROM rng r LEFT JOIN js ON r.feature = js.feature
""".replace(_W + "\n, long", _W.rstrip("\n") + ",\nlong")


@register("js_drift", _JS_SQL)
def js_drift(spark, sf_dir):
    """#92: Jensen-Shannon distance per feature on 49 joint equal-width bins."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.js_drift(ref, cur, FEATURES)


def _refbin_sql(bins: int = 10) -> str:
    return f"""long AS ({_LONG}),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE NOT is_cur GROUP BY feature),
binned AS (SELECT l.feature, l.is_cur,
   least(greatest(CAST(ceil((l.value - r.lo) / ((r.hi - r.lo) / {float(bins)!r}e0)) AS INTEGER) - 1, 0), {bins - 1}) AS bin
   FROM long l JOIN rng r ON l.feature = r.feature WHERE r.hi > r.lo),
counts AS (SELECT feature, bin, count_if(NOT is_cur) AS c_ref, count_if(is_cur) AS c_cur FROM binned GROUP BY feature, bin)"""


_CHI2_SQL = _W.rstrip("\n") + ",\n" + _refbin_sql() + f""",
e AS (SELECT feature, bin, CAST(c_cur AS DOUBLE) AS o,
        c_ref / sum(c_ref) OVER (PARTITION BY feature) * sum(c_cur) OVER (PARTITION BY feature) AS e FROM counts),
s AS (SELECT feature, sum((o - e) * (o - e) / e) AS statistic, count(*) - 1 AS dof FROM e WHERE e > 0 GROUP BY feature)
SELECT feature, {r6('statistic', 'statistic')}, CAST(dof AS BIGINT) AS dof, {r6(chi2_sf_sql('statistic', 'dof'), 'p_value')},
  {chi2_sf_sql('statistic', 'dof')} < 0.05e0 AS is_drift FROM s
"""


@register("chi2_drift", _CHI2_SQL)
def chi2_drift(spark, sf_dir):
    """#93: chi-square on shared reference bins."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.chi2_drift(ref, cur, FEATURES)


_PSI_SQL = _W.rstrip("\n") + ",\n" + _refbin_sql() + f""",
t AS (SELECT feature,
   (greatest(c_cur / sum(c_cur) OVER (PARTITION BY feature), 1e-4) - greatest(c_ref / sum(c_ref) OVER (PARTITION BY feature), 1e-4))
   * ln(greatest(c_cur / sum(c_cur) OVER (PARTITION BY feature), 1e-4) / greatest(c_ref / sum(c_ref) OVER (PARTITION BY feature), 1e-4)) AS t
   FROM counts)
SELECT feature, {r6('sum(t)', 'psi')}, sum(t) > 0.25e0 AS is_drift FROM t GROUP BY feature
"""


@register("psi_drift", _PSI_SQL)
def psi_drift(spark, sf_dir):
    """#106: population stability index on 10 reference bins."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.psi_drift(ref, cur, FEATURES)


_PRED_LONG = "SELECT 'prob' AS feature, score_b AS value, is_current AS is_cur FROM loans_shift WHERE score_b IS NOT NULL"
_PRED_AUC = auc_sql(ranked_sql("(SELECT is_current, TARGET AS label, score_b AS prob FROM loans_shift)", ["is_current"]), ["is_current"])
_PRED_SQL = _W + f"""
SELECT {r6('k.statistic', 'prediction_ks_statistic')}, {r6('k.p_value', 'prediction_ks_p_value')},
  k.is_drift AS prediction_drift,
  {r6('m.mc - m.mr', 'mean_prediction_shift')},
  {r6('a.ra - a.ca', 'auc_degradation')}, coalesce(a.ra - a.ca > 0.05e0, false) AS significant_auc_drop
FROM ({ks_sql(_PRED_LONG)}) k
CROSS JOIN (SELECT avg(CASE WHEN NOT is_current THEN score_b END) AS mr, avg(CASE WHEN is_current THEN score_b END) AS mc FROM loans_shift) m
CROSS JOIN (SELECT max(CASE WHEN NOT is_current THEN auc_roc END) AS ra, max(CASE WHEN is_current THEN auc_roc END) AS ca FROM ({_PRED_AUC})) a
"""


def _pred_frames(spark, sf_dir):
    ref, cur = _ref_cur(spark, sf_dir)
    sel = [F.col("score_b").alias("prob"), F.col("TARGET").alias("label")]
    return ref.select(*sel), cur.select(*sel)


@register("prediction_drift", _PRED_SQL)
def prediction_drift(spark, sf_dir):
    """#94/#95/#96: prediction KS, mean shift and AUC degradation (score_b)."""
    r, c = _pred_frames(spark, sf_dir)
    return D.prediction_drift(r, c, "prob", "label")


@register("auc_degradation", _W + f"""
SELECT {r6('ra', 'auc_ref')}, {r6('ca', 'auc_cur')}, {r6('ra - ca', 'auc_degradation')}, coalesce(ra - ca > 0.05e0, false) AS significant_auc_drop
FROM (SELECT max(CASE WHEN NOT is_current THEN auc_roc END) AS ra, max(CASE WHEN is_current THEN auc_roc END) AS ca FROM ({_PRED_AUC}))
""")
def auc_degradation(spark, sf_dir):
    """#96: AUC of the reference minus AUC of the current sample, flag > 0.05."""
    from scorewatch.operators.rankstats import auc_roc

    lo = FX.loans_shift(spark, sf_dir).select(
        F.col("is_current"), F.col("TARGET").alias("label"), F.col("score_b").alias("prob"))
    a = auc_roc(lo, ["is_current"]).groupBy().agg(
        F.max(F.when(~F.col("is_current"), F.col("auc_roc"))).alias("auc_ref"),
        F.max(F.when(F.col("is_current"), F.col("auc_roc"))).alias("auc_cur"))
    deg = F.col("auc_ref") - F.col("auc_cur")
    return a.select("auc_ref", "auc_cur", deg.alias("auc_degradation"),
                    F.coalesce(deg > F.lit(0.05), F.lit(False)).alias("significant_auc_drop"))


def _pred_js_sql() -> str:
    e = lin_edges(0.0, 1.0, 21)
    nb = 20
    step = e[1] - e[0]
    b = _bin_sql("score_b", "0e0", dlit(step), "1e0", nb)
    aggs = ", ".join([f"count_if(NOT is_cur AND bin = {i}) AS r{i}" for i in range(nb)]
                     + [f"count_if(is_cur AND bin = {i}) AS c{i}" for i in range(nb)])
    inr = " + ".join(f"r{i}" for i in range(nb))
    inc = " + ".join(f"c{i}" for i in range(nb))
    w = [e[i + 1] - e[i] for i in range(nb)]
    dr = [f"(r{i} / (({inr}) * {dlit(w[i])}) + 1e-10)" for i in range(nb)]
    dc = [f"(c{i} / (({inc}) * {dlit(w[i])}) + 1e-10)" for i in range(nb)]
    sr, sc = " + ".join(dr), " + ".join(dc)
    terms = []
    for i in range(nb):
        p, q = f"({dr[i]} / ({sr}))", f"({dc[i]} / ({sc}))"
        m = f"(({p} + {q}) / 2e0)"
        terms.append(f"({p} * ln({p} / {m}) + {q} * ln({q} / {m}))")
    js = f"sqrt(({' + '.join(terms)}) / 2e0)"
    return _W + f"""
SELECT {r6(js, 'js_divergence')}, {js} > 0.1e0 AS drift_detected, {r6('mc - mr', 'prediction_shift')}
FROM (SELECT {aggs}, avg(CASE WHEN NOT is_cur THEN v END) AS mr, avg(CASE WHEN is_cur THEN v END) AS mc
      FROM (SELECT score_b AS v, is_current AS is_cur, {b} AS bin FROM loans_shift))
"""


@register("prediction_js", _pred_js_sql())
def prediction_js(spark, sf_dir):
    """#97: prediction JS distance on 20 fixed bins over [0, 1] with 1e-10 smoothing."""
    r, c = _pred_frames(spark, sf_dir)
    return D.prediction_js(r, c, "prob")


_SUMMARY_PARTS = f"""
ks AS ({ks_sql(_LONG)}),
js AS (SELECT * FROM ({_JS_SQL.split('SELECT r.feature', 1)[0].replace(_W.rstrip(chr(10)) + ',', 'WITH ', 1)}
   SELECT r.feature, sqrt(js.div) > 0.1e0 AS is_drift FROM rng r LEFT JOIN js ON r.feature = js.feature)),
summ AS (SELECT k.total_features, k.ks_drift_count, j.js_drift_count,
    coalesce(CAST(k.ks_drift_count AS DOUBLE) / nullif(CAST(k.total_features AS DOUBLE), 0), 0e0) AS ks_drift_ratio,
    coalesce(CAST(j.js_drift_count AS DOUBLE) / nullif(CAST(j.js_total AS DOUBLE), 0), 0e0) AS js_drift_ratio
  FROM (SELECT count(*) AS total_features, count_if(is_drift) AS ks_drift_count FROM ks) k
  CROSS JOIN (SELECT count(*) AS js_total, count_if(coalesce(is_drift, false)) AS js_drift_count FROM js) j)"""


@register("drift_summary", _W.rstrip("\n") + "," + _SUMMARY_PARTS + f"""
SELECT CAST(total_features AS BIGINT) AS total_features, CAST(ks_drift_count AS BIGINT) AS ks_drift_count,
  CAST(js_drift_count AS BIGINT) AS js_drift_count, {r6('ks_drift_ratio', 'ks_drift_ratio')}, {r6('js_drift_ratio', 'js_drift_ratio')}
FROM summ""")
def drift_summary(spark, sf_dir):
    """#100: feature drift counts and ratios for KS and JS."""
    ref, cur = _ref_cur(spark, sf_dir)
    return D.drift_summary(D.ks_drift(ref, cur, FEATURES), D.js_drift(ref, cur, FEATURES))


_SCORE = "0.7e0 * greatest(s.ks_drift_ratio, s.js_drift_ratio) + 0.3e0 * (CASE WHEN p.prediction_drift THEN 1e0 ELSE 0e0 END)"
_LEVEL = f"CASE WHEN {_SCORE} > 0.3e0 THEN 'High' WHEN {_SCORE} > 0.1e0 THEN 'Medium' ELSE 'Low' END"


def _recs_sql(score: str, ks_ratio: str, pred: str, auc_deg: str) -> str:
    arr = (f"list_filter([CASE WHEN {score} > 0.3e0 THEN '{D.REC_RETRAIN}' END, "
           f"CASE WHEN {ks_ratio} > 0.2e0 THEN '{D.REC_REVIEW}' END, "
           f"CASE WHEN {pred} THEN '{D.REC_RECALIBRATE}' END, "
           f"CASE WHEN coalesce({auc_deg}, 0e0) > 0.05e0 THEN '{D.REC_URGENT}' END], lambda x: x IS NOT NULL)")
    return f"CASE WHEN len({arr}) = 0 THEN ['{D.REC_CONTINUE}'] ELSE {arr} END"


_PRED_CTE = f"pred AS ({_PRED_SQL.replace(_W, '', 1)})"


@register("drift_score", _W.rstrip("\n") + "," + _SUMMARY_PARTS + ",\n" + _PRED_CTE.replace(
    "k.is_drift AS prediction_drift", "k.is_drift AS prediction_drift") + f"""
SELECT {r6(_SCORE, 'overall_drift_score')}, {_LEVEL} AS drift_level FROM summ s CROSS JOIN pred p""")
def drift_score(spark, sf_dir):
    """#101/#102: overall drift score 0.7 max(ks, js ratio) + 0.3 prediction drift, and level."""
    rep = _report(spark, sf_dir)
    return rep.select("overall_drift_score", "drift_level")


def _report(spark, sf_dir):
    ref, cur = _ref_cur(spark, sf_dir)
    return D.drift_report(ref.withColumn("prob", F.col("score_b")).withColumn("label", F.col("TARGET")),
                          cur.withColumn("prob", F.col("score_b")).withColumn("label", F.col("TARGET")),
                          FEATURES, "prob", "label")


@register("recommendations", _W.rstrip("\n") + "," + _SUMMARY_PARTS + ",\n" + _PRED_CTE + f"""
SELECT {_recs_sql(_SCORE, 's.ks_drift_ratio', 'p.prediction_drift', 'p.auc_degradation')} AS recommendations
FROM summ s CROSS JOIN pred p""")
def recommendations(spark, sf_dir):
    """#103: drift recommendations list."""
    return _report(spark, sf_dir).select("recommendations")


SCORE_SQL = _SCORE
REPORT_CTES = _SUMMARY_PARTS.strip() + ",\n" + _PRED_CTE


def _report_sql() -> str:
    m = all_metrics_sql("(SELECT is_current, TARGET AS label, score_b AS prob FROM loans_shift)", ["is_current"], rounded=False)
    gaps = ", ".join(r6(f"max(CASE WHEN NOT is_current THEN {c} END) - max(CASE WHEN is_current THEN {c} END)", f"{c}_degradation") for c in D.COMPARED)
    return _W.rstrip("\n") + "," + _SUMMARY_PARTS + ",\n" + _PRED_CTE + f""",
perf AS (SELECT {gaps} FROM ({m}))
SELECT CAST(s.total_features AS BIGINT) AS total_features, CAST(s.ks_drift_count AS BIGINT) AS ks_drift_count,
  CAST(s.js_drift_count AS BIGINT) AS js_drift_count, {r6('s.ks_drift_ratio', 'ks_drift_ratio')}, {r6('s.js_drift_ratio', 'js_drift_ratio')},
  p.prediction_ks_statistic, p.prediction_ks_p_value, p.prediction_drift, p.mean_prediction_shift,
  p.auc_degradation, p.significant_auc_drop, perf.*,
  {r6(_SCORE, 'overall_drift_score')}, {_LEVEL} AS drift_level,
  {_recs_sql(_SCORE, 's.ks_drift_ratio', 'p.prediction_drift', 'p.auc_degradation')} AS recommendations
FROM summ s CROSS JOIN pred p CROSS JOIN perf"""


@register("drift_report", _report_sql())
def drift_report(spark, sf_dir):
    """#104/#57: the full drift report row with the performance comparison."""
    return _report(spark, sf_dir)


#: Within each dataset every two splits, and the test splits of the two datasets.
PAIRS = [(f"{d}: {a} to {b}", f"{d}_{a}", f"{d}_{b}") for d in ("loans", "items") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
PAIRS.append(("loans to items: test", "loans_test", "items_test"))


def _reports_sql() -> str:
    pairs = ", ".join(f"('{n}', '{r}', '{c}')" for n, r, c in PAIRS)
    unpivoted = "(UNPIVOT (SELECT sample, amount, rate FROM smp) ON amount, rate INTO NAME feature VALUE value)"
    pick = lambda src: (f"SELECT pair || '|' || feature AS feature, value, sample = cur AS is_cur FROM {src} JOIN pr ON sample IN (ref, cur) "  # noqa: E731
                        "WHERE value IS NOT NULL AND NOT isnan(value)")
    long, preds = pick(unpivoted), pick("(SELECT sample, 'prediction' AS feature, prob AS value FROM smp)")
    js = _JS_SQL.split("SELECT r.feature", 1)[0].replace(_W.rstrip("\n") + ",", "WITH ", 1).replace(_LONG, long)
    m = all_metrics_sql("(SELECT sample, label, prob FROM smp)", ["sample"], rounded=False)
    gaps = ", ".join(r6(f"a.{c} - b.{c}", f"{c}_degradation") for c in D.COMPARED)
    return with_views("book").rstrip("\n") + f""",
smp AS (SELECT dataset || '_' || split AS sample, label, prob, amount, rate FROM book),
pr(pair, ref, cur) AS (VALUES {pairs}),
ks AS (SELECT split_part(feature, '|', 1) AS pair, count(*) AS total_features, count_if(is_drift) AS ks_drift_count FROM ({ks_sql(long)}) GROUP BY 1),
js AS (SELECT split_part(feature, '|', 1) AS pair, count(*) AS js_total, count_if(is_drift) AS js_drift_count FROM (
  {js} SELECT r.feature, coalesce(sqrt(js.div) > 0.1e0, false) AS is_drift FROM rng r LEFT JOIN js ON r.feature = js.feature) GROUP BY 1),
pk AS (SELECT split_part(feature, '|', 1) AS pair, * FROM ({ks_sql(preds)})),
mm AS (SELECT m.*, n.mean, CASE WHEN m.degenerate THEN NULL ELSE m.auc_roc END AS auc FROM ({m}) m JOIN (SELECT sample, avg(prob) AS mean FROM smp GROUP BY sample) n USING (sample)),
s AS (SELECT pair, total_features, ks_drift_count, js_drift_count, CAST(ks_drift_count AS DOUBLE) / total_features AS ks_drift_ratio, CAST(js_drift_count AS DOUBLE) / js_total AS js_drift_ratio
  FROM ks JOIN js USING (pair)),
p AS (SELECT pr.pair, pk.statistic AS prediction_ks_statistic, pk.p_value AS prediction_ks_p_value, pk.is_drift AS prediction_drift,
  {r6('b.mean - a.mean', 'mean_prediction_shift')}, {r6('a.auc - b.auc', 'auc_degradation')}, coalesce(a.auc - b.auc > 0.05e0, false) AS significant_auc_drop, {gaps}
  FROM pr JOIN pk USING (pair) JOIN mm a ON a.sample = pr.ref JOIN mm b ON b.sample = pr.cur)
SELECT pair, CAST(s.total_features AS BIGINT) AS total_features, CAST(s.ks_drift_count AS BIGINT) AS ks_drift_count, CAST(s.js_drift_count AS BIGINT) AS js_drift_count,
  {r6('s.ks_drift_ratio', 'ks_drift_ratio')}, {r6('s.js_drift_ratio', 'js_drift_ratio')}, p.* EXCLUDE (pair),
  {r6(_SCORE, 'overall_drift_score')}, {_LEVEL} AS drift_level, {_recs_sql(_SCORE, 's.ks_drift_ratio', 'p.prediction_drift', 'p.auc_degradation')} AS recommendations
FROM s JOIN p USING (pair)"""


@register("drift_reports", _reports_sql())
def drift_reports(spark, sf_dir):
    """#105: the full drift report for every pair of splits of both datasets, and between the datasets."""
    df = FX.book(spark, sf_dir).withColumn("sample", F.concat_ws("_", "dataset", "split"))
    return D.drift_reports(df, "sample", PAIRS, ["amount", "rate"])


_WIN_FEATS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "revol_util", "score_b"]


@register("window_drift", with_views("loans_shift") + f"""
, tail AS (SELECT * FROM loans_shift WHERE NOT is_current ORDER BY month_no DESC, loan_id DESC LIMIT 2000),
both_ AS (SELECT *, false AS is_cur2 FROM tail UNION ALL SELECT *, true FROM loans_shift WHERE is_current),
ks AS ({ks_sql(long_sql('both_', _WIN_FEATS, 'is_cur2'), rounded=False)}),
idx AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(_WIN_FEATS))}) t(feature, idx))
SELECT count_if(is_drift) > 0 AS drift_detected, {r6('CAST(count_if(is_drift) AS DOUBLE) / count(*)', 'drift_ratio')},
  coalesce(list_sort(list(idx) FILTER (WHERE is_drift)), []) AS drifted_features,
  {r6('avg(p_value)', 'mean_p_value')}, {r6('min(p_value)', 'min_p_value')}
FROM ks JOIN idx USING (feature)
""".replace(with_views("loans_shift") + "\n, tail", with_views("loans_shift").rstrip("\n") + ",\ntail"))
def window_drift(spark, sf_dir):
    """#84 + #98: the last 2000 reference rows (by month, loan) vs the current sample."""
    ref, cur = _ref_cur(spark, sf_dir)
    tail = D.reference_tail(ref, ["month_no", "loan_id"], 2000)
    return D.window_drift(tail, cur, _WIN_FEATS)


@register("reference_tail", with_views("loans") + """
SELECT loan_id, month_no, round(score_b * 1e6) / 1e6 AS score_b FROM loans ORDER BY month_no DESC, loan_id DESC LIMIT 1000""")
def reference_tail(spark, sf_dir):
    """#84: the newest 1000 rows by (month, loan id) - a top-k, not a full sort."""
    return D.reference_tail(FX.loans(spark, sf_dir).select("loan_id", "month_no", "score_b"),
                            ["month_no", "loan_id"], 1000)


_SOME = ["AMT_CREDIT", "revol_util", "score_b", "CNT_ITEMS"]


@register("common_features", _W.rstrip("\n") + f""",
l AS ({long_sql('loans_shift', _SOME, 'is_current')})
SELECT feature, count_if(NOT is_cur) AS n_ref, count_if(is_cur) AS n_cur FROM l GROUP BY feature""")
def common_features(spark, sf_dir):
    """#53: features present in both frames, with their values in each."""
    ref, cur = _ref_cur(spark, sf_dir)
    feats = D.common_features(ref.select(*FEATURES), cur.select("loan_id", *_SOME))
    return (D.tagged_long(ref, cur, feats).where(F.col("value").isNotNull()).groupBy("feature")
            .agg(F.count_if(~F.col("is_cur")).alias("n_ref"), F.count_if("is_cur").alias("n_cur")))


@register("bin_align", _W.rstrip("\n") + ",\n" + _refbin_sql().split("counts AS")[0].rstrip().rstrip(",") + """,
rh AS (SELECT feature, bin, count(*) AS c FROM binned WHERE NOT is_cur GROUP BY feature, bin),
ch AS (SELECT feature, bin, count(*) AS c FROM binned WHERE is_cur GROUP BY feature, bin)
SELECT coalesce(rh.feature, ch.feature) AS feature, coalesce(rh.bin, ch.bin) AS bin,
  CAST(coalesce(rh.c, 0) AS BIGINT) AS c_ref, CAST(coalesce(ch.c, 0) AS BIGINT) AS c_cur
FROM rh FULL OUTER JOIN ch ON rh.feature = ch.feature AND rh.bin = ch.bin""")
def bin_align(spark, sf_dir):
    """#54: outer alignment of two histograms over the reference's bins."""
    ref, cur = _ref_cur(spark, sf_dir)
    c = D._ref_binned(ref, cur, FEATURES, 10)
    rh = c.where(F.col("c_ref") > 0).select("feature", "bin", F.col("c_ref").alias("count"))
    ch = c.where(F.col("c_cur") > 0).select("feature", "bin", F.col("c_cur").alias("count"))
    return D.bin_align(rh, ch)


@register("period_drift", with_views("loans_shift") + f"""
, long AS (SELECT is_cur AS month_no, feature, value FROM ({long_sql('loans_shift', FEATURES, 'month_no')})),
ref AS (SELECT feature, value FROM long WHERE month_no < 12),
refc AS (SELECT feature, value, count(*) AS c FROM ref GROUP BY ALL),
curc AS (SELECT month_no, feature, value, count(*) AS c FROM long GROUP BY ALL),
vals AS (SELECT feature, value, sum(c) AS c FROM (SELECT feature, value, c FROM refc UNION ALL SELECT feature, value, 0 FROM curc) GROUP BY ALL),
rv AS (SELECT feature, value, sum(c) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS r_le,
         sum(c) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - c AS r_lt, sum(c) OVER (PARTITION BY feature) AS n_ref FROM vals),
g AS (SELECT month_no, feature, value, c, sum(c) OVER (PARTITION BY month_no, feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS g_le,
        sum(c) OVER (PARTITION BY month_no, feature) AS n_g FROM curc),
d AS (SELECT g.month_no, g.feature, max(greatest(abs(CAST(rv.r_le AS DOUBLE) / CAST(rv.n_ref AS DOUBLE) - CAST(g.g_le AS DOUBLE) / CAST(g.n_g AS DOUBLE)),
                                           abs(CAST(rv.r_lt AS DOUBLE) / CAST(rv.n_ref AS DOUBLE) - CAST(g.g_le - g.c AS DOUBLE) / CAST(g.n_g AS DOUBLE)))) AS d,
          max(rv.n_ref) AS n_ref, max(g.n_g) AS n_cur
      FROM g JOIN rv ON g.feature = rv.feature AND g.value = rv.value GROUP BY g.month_no, g.feature)
SELECT month_no, feature, {r6('d', 'statistic')}, {r6(ks_p_sql('d', 'n_ref', 'n_cur'), 'p_value')},
  {ks_p_sql('d', 'n_ref', 'n_cur')} < 0.05e0 AS is_drift, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur FROM d
""".replace(with_views("loans_shift") + "\n, long", with_views("loans_shift").rstrip("\n") + ",\nlong"))
def period_drift(spark, sf_dir):
    """#105: every period's KS against the first 12 months, in one job (reference never copied)."""
    lo = FX.loans_shift(spark, sf_dir)
    return D.ks_by_group(lo.where(F.col("month_no") < 12), lo, FEATURES, ["month_no"])


def _cmp_sql() -> str:
    m = all_metrics_sql("(SELECT month_no >= 40 AS is_current, TARGET AS label, score_c AS prob FROM loans)", ["is_current"], rounded=False)
    return with_views("loans").rstrip("\n") + f""",
l AS (SELECT is_current, metric, value FROM (UNPIVOT ({m}) ON {', '.join(D.COMPARED)} INTO NAME metric VALUE value))
SELECT r.metric, {r6('r.value', 'reference')}, {r6('c.value', 'current')}, {r6('r.value - c.value', 'degradation')}
FROM (SELECT * FROM l WHERE NOT is_current) r JOIN (SELECT * FROM l WHERE is_current) c ON r.metric = c.metric"""


@register("performance_comparison", _cmp_sql())
def performance_comparison(spark, sf_dir):
    """#57: all metrics of the mixed score, reference (months < 40) against current."""
    from scorewatch.operators import metrics as M

    lo = FX.loans(spark, sf_dir).select((F.col("month_no") >= 40).alias("is_current"), F.col("TARGET").alias("label"), F.col("score_c").alias("prob"))
    m = M.all_metrics(lo, ["is_current"])
    return D.performance_comparison(m.where(~F.col("is_current")), m.where("is_current"), D.COMPARED)


def _history_sql() -> str:
    parts = []
    for i in range(1, 4):
        src = f"(SELECT *, month_no >= 20 AS is_cur2 FROM loans WHERE month_no < 20 OR (month_no >= {20 * i} AND month_no < {20 * (i + 1)}))"
        parts.append(f"SELECT {i} AS check_no, * FROM ({ks_sql(long_sql(src, _WIN_FEATS, 'is_cur2'), rounded=False)})")
    return with_views("loans").rstrip("\n") + f""",
idx AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(_WIN_FEATS))}) t(feature, idx))
SELECT check_no, count_if(is_drift) > 0 AS drift_detected, {r6('CAST(count_if(is_drift) AS DOUBLE) / count(*)', 'drift_ratio')},
  coalesce(list_sort(list(idx) FILTER (WHERE is_drift)), []) AS drifted_features, {r6('avg(p_value)', 'mean_p_value')}, {r6('min(p_value)', 'min_p_value')}
FROM ({' UNION ALL '.join(parts)}) JOIN idx USING (feature) GROUP BY check_no"""


@register("drift_history", _history_sql())
def drift_history(spark, sf_dir):
    """#98/#99: window drift of each 20-month block vs the first block, appended per check."""
    from scorewatch.session import scratch_path

    lo = FX.loans(spark, sf_dir)
    ref = lo.where(F.col("month_no") < 20)
    checks = [(i, D.window_drift(ref, lo.where((F.col("month_no") >= 20 * i) & (F.col("month_no") < 20 * (i + 1))), _WIN_FEATS))
              for i in range(1, 4)]
    return D.drift_history(checks, scratch_path(spark, "drift-history"))
