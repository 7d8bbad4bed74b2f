"""Registered feature and fitted-transform queries (#23-50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.operators import features as FE
from scorewatch.operators import fitted as FT
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import dlit, r6, with_views
from scorewatch.sources import fixtures as FX

W = with_views("loans")
NUMS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "installment", "revol_util", "DAYS_BIRTH", "CNT_ITEMS"]


@register("temporal_trend", W + f"""
SELECT loan_id, CAST(floor(month_no / 3) + 1 AS BIGINT) AS month_no_quarter,
  {r6('CAST(month_no AS DOUBLE) / CAST(max(month_no) OVER () AS DOUBLE)', 'month_no_trend')},
  CAST(floor(month_no / 12) AS BIGINT) AS month_no_period FROM loans""")
def temporal_trend(spark, sf_dir):
    """#23-#26: quarter, trend t/max(t) with fitted max, lookback period."""
    lo = FX.loans(spark, sf_dir)
    mx = lo.agg(F.max("month_no")).first()[0]
    return FE.with_exprs(lo.select("loan_id", "month_no"), FE.temporal_exprs("month_no", mx)).drop("month_no")


_INTER = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "installment", "revol_util"]


@register("time_interactions", W + "SELECT loan_id, " + ", ".join(
    [r6(f"CAST({c} AS DOUBLE) * CAST(month_no AS DOUBLE)", f"{c}_time_weighted") for c in _INTER]
    + [r6(f"CAST({c} AS DOUBLE) / (CAST(month_no AS DOUBLE) + 1e-8)", f"{c}_time_ratio") for c in _INTER]) + " FROM loans")
def time_interactions(spark, sf_dir):
    """#27/#28: time-weighted interactions and time ratios of the first 5 numeric columns."""
    lo = FX.loans(spark, sf_dir).select("loan_id", "month_no", *_INTER)
    return FE.with_exprs(lo, FE.interaction_exprs("month_no", _INTER, True)).drop("month_no", *_INTER)


@register("risk_features", W + f"""
SELECT loan_id, CASE WHEN revol_util > 50e0 THEN 1 ELSE 0 END AS credit_utilization_risk,
  {r6('AMT_CREDIT / (AMT_INCOME_TOTAL + 1e-8)', 'debt_to_income_ratio')},
  CASE WHEN AMT_CREDIT / (AMT_INCOME_TOTAL + 1e-8) > 2e0 THEN 1 ELSE 0 END AS income_credit_ratio_risk,
  {r6('installment / (AMT_INCOME_TOTAL + 1e-8)', 'payment_to_income_ratio')},
  CASE WHEN installment / (AMT_INCOME_TOTAL + 1e-8) > 0.3e0 THEN 1 ELSE 0 END AS payment_burden_risk
FROM loans""")
def risk_features(spark, sf_dir):
    """#29/#31/#32/#35: utilisation flag, debt-to-income, DTI flag, payment ratio and burden."""
    lo = FX.loans(spark, sf_dir).select("loan_id", "AMT_CREDIT", "AMT_INCOME_TOTAL", "installment", "revol_util")
    ex = FE.risk_exprs([c for c in lo.columns if c != "loan_id"])  # the key is not a feature
    keep = ["credit_utilization_risk", "debt_to_income_ratio", "income_credit_ratio_risk",
            "payment_to_income_ratio", "payment_burden_risk"]
    return lo.select("loan_id", *[ex[k].alias(k) for k in keep])


def _util_sql() -> str:
    parts = []
    for i in range(10):
        lo = "e0 - (hi - lo) * 0.001e0" if i == 0 else f"e{i}"
        parts.append(f"WHEN revol_util > {lo} AND revol_util <= e{i + 1} THEN {i}")
    edges = ", ".join(f"{i} * ((hi - lo) / 10e0) + lo AS e{i}" for i in range(10)) + ", hi AS e10"
    return W.rstrip("\n") + f""",
r AS (SELECT min(revol_util) AS lo, max(revol_util) AS hi FROM loans),
e AS (SELECT lo, hi, {edges} FROM r)
SELECT loan_id, CASE {' '.join(parts)} END AS credit_util_binned FROM loans CROSS JOIN e"""


@register("util_bins", _util_sql())
def util_bins(spark, sf_dir):
    """#30: 10 right-closed equal-width utilisation bins over the fitted range (lowest edge lowered 0.1%)."""
    lo = FX.loans(spark, sf_dir).select("loan_id", "revol_util")
    r = lo.agg(F.min("revol_util"), F.max("revol_util")).first()
    return lo.select("loan_id", FE.util_bin_expr("revol_util", FE.util_bin_edges(r[0], r[1])).alias("credit_util_binned"))


def _stab_sql() -> str:
    cols = []
    for c in NUMS[:5]:
        cols.append(r6(f"abs(CAST({c} AS DOUBLE))", f"{c}_magnitude"))
        cols.append(r6(f"CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)", f"{c}_squared"))
    nums = NUMS[:10]
    for i, a in enumerate(nums[:5]):
        for b in nums[i + 1:i + 3]:
            cols.append(r6(f"CAST({a} AS DOUBLE) / (CAST({b} AS DOUBLE) + 1e-8)", f"{a}_{b}_ratio"))
    return W + f"SELECT loan_id, {', '.join(cols)} FROM loans"


@register("stability_features", _stab_sql())
def stability_features(spark, sf_dir):
    """#36/#37: pairwise ratios, magnitudes and squares of the first numeric columns."""
    lo = FX.loans(spark, sf_dir).select("loan_id", *NUMS)
    return FE.with_exprs(lo, FE.stability_exprs(NUMS)).drop(*NUMS)


@register("math_features", W + f"""
SELECT loan_id, {r6('AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY', 'AMT_CREDIT_AMT_INCOME_TOTAL_AMT_ANNUITY_sum')},
  {r6('AMT_CREDIT * AMT_INCOME_TOTAL * AMT_ANNUITY', 'AMT_CREDIT_AMT_INCOME_TOTAL_AMT_ANNUITY_prod')},
  {r6('(AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0', 'AMT_CREDIT_AMT_INCOME_TOTAL_AMT_ANNUITY_mean')},
  {r6('sqrt(((AMT_CREDIT - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0) * (AMT_CREDIT - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0) + (AMT_INCOME_TOTAL - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0) * (AMT_INCOME_TOTAL - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0) + (AMT_ANNUITY - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0) * (AMT_ANNUITY - (AMT_CREDIT + AMT_INCOME_TOTAL + AMT_ANNUITY) / 3e0)) / 2e0)', 'AMT_CREDIT_AMT_INCOME_TOTAL_AMT_ANNUITY_std')}
FROM loans""")
def math_features(spark, sf_dir):
    """#38: row-wise sum, product, mean and sample std of the first 3 numeric columns."""
    lo = FX.loans(spark, sf_dir).select("loan_id", "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY")
    return FE.with_exprs(lo, FE.math_exprs(["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY"])).drop(
        "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY")


@register("impute", W + f"""
SELECT loan_id, {r6('coalesce(AMT_ANNUITY, -999e0)', 'AMT_ANNUITY')}, {r6('coalesce(revol_util, -999e0)', 'revol_util')},
  coalesce(ORGANIZATION_TYPE, 'Missing') AS ORGANIZATION_TYPE,
  coalesce(CASE WHEN CNT_ITEMS = 0 THEN NULL ELSE CAST(CNT_ITEMS AS VARCHAR) END, 'Missing') AS items_cat
FROM loans""")
def impute(spark, sf_dir):
    """#40-42: numeric NULL -> -999, categorical NULL -> 'Missing'."""
    lo = FX.loans(spark, sf_dir).select(
        "loan_id", "AMT_ANNUITY", "revol_util", "ORGANIZATION_TYPE",
        F.when(F.col("CNT_ITEMS") != 0, F.col("CNT_ITEMS").cast("string")).alias("items_cat"))
    return FT.apply_impute(lo, ["AMT_ANNUITY", "revol_util"], ["ORGANIZATION_TYPE", "items_cat"])


@register("ordinal_encode", W + """
SELECT loan_id,
  CAST(dense_rank() OVER (ORDER BY ORGANIZATION_TYPE) - 1 AS INTEGER) AS ORGANIZATION_TYPE,
  CAST(dense_rank() OVER (ORDER BY CAST(CNT_ITEMS AS VARCHAR)) - 1 AS INTEGER) AS CNT_ITEMS
FROM loans""")
def ordinal_encode(spark, sf_dir):
    """#43: sorted-value ordinal codes (state table + inline map apply)."""
    lo = FX.loans(spark, sf_dir).select("loan_id", "ORGANIZATION_TYPE", F.col("CNT_ITEMS").cast("string").alias("CNT_ITEMS"))
    st = FT.fit_ordinal(lo, ["ORGANIZATION_TYPE", "CNT_ITEMS"])
    return FT.apply_ordinal(lo, st, ["ORGANIZATION_TYPE", "CNT_ITEMS"])


_CONST_COLS = ["ORGANIZATION_TYPE", "CNT_ITEMS", "TARGET", "has_lines", "month_no"]


@register("constant_columns", W.rstrip("\n") + f""",
x AS (SELECT ORGANIZATION_TYPE, CAST(CNT_ITEMS AS VARCHAR) AS CNT_ITEMS, CAST(TARGET AS VARCHAR) AS TARGET,
        CASE WHEN CNT_ITEMS >= 0 THEN 'true' ELSE 'false' END AS has_lines, CAST(month_no AS VARCHAR) AS month_no FROM loans),
l AS (SELECT col, value, count(*) AS n FROM (UNPIVOT x ON {', '.join(_CONST_COLS)} INTO NAME col VALUE value) GROUP BY ALL)
SELECT col AS "column", {r6('CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE)', 'top_share')},
  CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) >= 0.98e0 AS is_constant FROM l GROUP BY col""")
def constant_columns(spark, sf_dir):
    """#44: share of the top value per column; >= 0.98 is quasi-constant."""
    lo = FX.loans(spark, sf_dir).select("ORGANIZATION_TYPE", "CNT_ITEMS", "TARGET",
                                        (F.col("CNT_ITEMS") >= 0).alias("has_lines"), "month_no")
    return FT.constant_columns(lo, _CONST_COLS)


@register("duplicate_columns", W + """
SELECT 'score_a' AS kept, 'items_ratio' AS duplicate FROM loans
HAVING count_if(score_a IS DISTINCT FROM CNT_ITEMS / (CNT_ITEMS + 2e0)) = 0""")
def duplicate_columns(spark, sf_dir):
    """#45: duplicated columns by fingerprint + exact verification (items_ratio copies score_a)."""
    lo = FX.loans(spark, sf_dir).select(
        "score_a", "score_b", "AMT_CREDIT",
        (F.col("CNT_ITEMS") / (F.col("CNT_ITEMS") + F.lit(2.0))).alias("items_ratio"))
    return FT.duplicate_columns_frame(lo, lo.columns)


_SCALE = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "revol_util", "CNT_ITEMS"]


@register("standard_scale", W + "SELECT loan_id, " + ", ".join(
    r6(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1e0 ELSE stddev_pop({c}) OVER () END", c)
    for c in _SCALE) + " FROM loans")
def standard_scale(spark, sf_dir):
    """#46: (x - mean) / population std from one fitted aggregate."""
    lo = FX.loans(spark, sf_dir).select("loan_id", *_SCALE)
    return FT.apply_scale(lo, FT.fit_scale(lo, _SCALE))


@register("equal_freq_bins", W + f"""
SELECT col AS "column", CAST(q AS INTEGER) AS q, {r6('edge', 'edge')} FROM (
  SELECT col, unnest(range(1, 5)) AS q, unnest(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS edge
  FROM (UNPIVOT (SELECT CAST(AMT_CREDIT AS DOUBLE) AS AMT_CREDIT, CAST(AMT_INCOME_TOTAL AS DOUBLE) AS AMT_INCOME_TOTAL FROM loans)
        ON AMT_CREDIT, AMT_INCOME_TOTAL INTO NAME col VALUE value) GROUP BY col)""")
def equal_freq_bins(spark, sf_dir):
    """#47: exact equal-frequency (q=5) cut points per column."""
    lo = FX.loans(spark, sf_dir)
    e = FT.equal_freq_edges(lo, ["AMT_CREDIT", "AMT_INCOME_TOTAL"], 5)
    return e.select("column", F.posexplode("edges").alias("q", "edge")).select(
        "column", (F.col("q") + 1).cast("int").alias("q"), "edge")


@register("equal_freq_binned", W.rstrip("\n") + """,
l AS (SELECT col, value FROM (UNPIVOT (SELECT CAST(AMT_CREDIT AS DOUBLE) AS AMT_CREDIT, CAST(AMT_INCOME_TOTAL AS DOUBLE) AS AMT_INCOME_TOTAL FROM loans)
    ON AMT_CREDIT, AMT_INCOME_TOTAL INTO NAME col VALUE value)),
e AS (SELECT col, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS edges FROM l GROUP BY col)
SELECT col AS "column", CAST(len(list_filter(edges, lambda c: c < value)) AS INTEGER) AS bin, count(*) AS n FROM l JOIN e USING (col) GROUP BY ALL""")
def equal_freq_binned(spark, sf_dir):
    """#47: rows per equal-frequency bin, the fitted cut points applied to every row."""
    cols = ["AMT_CREDIT", "AMT_INCOME_TOTAL"]
    lo = FX.loans(spark, sf_dir).select(*cols)
    edges = {r["column"]: r["edges"] for r in FT.equal_freq_edges(lo, cols).collect()}  # q - 1 numbers a column
    binned = lo.select(*[FT.equal_freq_bin(F.col(c).cast("double"), F.array(*[F.lit(e) for e in edges[c]])).alias(c) for c in cols])
    long = binned.selectExpr(f"stack({len(cols)}, {', '.join(f"'{c}', {c}" for c in cols)}) AS (column, bin)")
    return long.groupBy("column", "bin").agg(F.count("*").alias("n"))


def _pipeline_sql() -> str:
    """The whole pipeline in SQL for the fixture's columns: fitted on train, summarised on test."""
    src = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "installment", "revol_util"]
    bins = " ".join(f"WHEN revol_util > {'lo - (hi - lo) * 0.001e0' if i == 0 else f'{i} * ((hi - lo) / 10e0) + lo'} AND revol_util <= "
                    f"{'hi' if i == 9 else f'{i + 1} * ((hi - lo) / 10e0) + lo'} THEN {i}" for i in range(10))
    numbers = {"month_no": "month_no", **{c: c for c in src}, "DAYS_BIRTH": "DAYS_BIRTH", "month_no_quarter": "floor(month_no / 3) + 1",
               "month_no_trend": "CAST(month_no AS DOUBLE) / mt", "month_no_period": "floor(month_no / 12)",
               **{f"{c}_time_weighted": f"{c} * CAST(month_no AS DOUBLE)" for c in src},
               **{f"{c}_time_ratio": f"{c} / (CAST(month_no AS DOUBLE) + 1e-8)" for c in src},
               "debt_to_income_ratio": "AMT_CREDIT / (AMT_INCOME_TOTAL + 1e-8)", "age_years": "abs(DAYS_BIRTH) / 365.25e0",
               "payment_to_income_ratio": "installment / (AMT_INCOME_TOTAL + 1e-8)"}
    years = "abs(DAYS_BIRTH) / 365.25e0"
    words = {"ORGANIZATION_TYPE": "ORGANIZATION_TYPE", "CNT_ITEMS": "CNT_ITEMS", "credit_utilization_risk": "CASE WHEN revol_util > 50e0 THEN 1 ELSE 0 END",
             "credit_util_binned": f"CASE {bins} END", "income_credit_ratio_risk": "CASE WHEN AMT_CREDIT / (AMT_INCOME_TOTAL + 1e-8) > 2e0 THEN 1 ELSE 0 END",
             "age_risk_category": f"CASE WHEN {years} >= 0 AND {years} <= 25 THEN 'age_group_0' WHEN {years} > 25 AND {years} <= 45 THEN 'age_group_1' "
                                  f"WHEN {years} > 45 AND {years} <= 65 THEN 'age_group_2' WHEN {years} > 65 AND {years} <= 100 THEN 'age_group_3' END",
             "payment_burden_risk": "CASE WHEN installment / (AMT_INCOME_TOTAL + 1e-8) > 0.3e0 THEN 1 ELSE 0 END"}
    num = ", ".join(f"coalesce(CAST({e} AS DOUBLE), -999e0) AS {c}" for c, e in numbers.items())
    cat = ", ".join(f"coalesce(CAST({e} AS VARCHAR), 'Missing') AS {c}" for c, e in words.items())
    return with_views("loans_split").rstrip("\n") + f""",
k AS (SELECT CAST(max(month_no) AS DOUBLE) AS mt, min(revol_util) AS lo, max(revol_util) AS hi FROM loans_split WHERE split = 'train'),
x AS (SELECT * FROM loans_split CROSS JOIN k WHERE split IN ('train', 'test')),
n AS (SELECT split, col, value FROM (UNPIVOT (SELECT split, {num} FROM x) ON {', '.join(numbers)} INTO NAME col VALUE value)),
c AS (SELECT split, col, value FROM (UNPIVOT (SELECT split, {cat} FROM x) ON {', '.join(words)} INTO NAME col VALUE value)),
codes AS (SELECT col, value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT col, value FROM c WHERE split = 'train')),
l AS (SELECT split, col, value FROM n UNION ALL SELECT c.split, c.col, codes.code FROM c LEFT JOIN codes ON c.col = codes.col AND c.value = codes.value),
f AS (SELECT col, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1e0 ELSE stddev_pop(value) END AS s FROM l WHERE split = 'train' GROUP BY col)
SELECT l.col AS "column", {r6('avg((value - m) / s)', 'mean')}, {r6('stddev_pop((value - m) / s)', 'std')}
FROM l JOIN f USING (col) WHERE split = 'test' GROUP BY l.col"""


@register("feature_pipeline", _pipeline_sql())
def feature_pipeline(spark, sf_dir):
    """#48-50: fit on the train split, transform the test split; per output column mean and std."""
    ls = FX.loans_split(spark, sf_dir).drop("score_a", "score_b", "score_c", "customer_id")
    pipe = FT.FeaturePipeline(label="TARGET", exclude=["loan_id", "split"])
    pipe.fit(ls.where(F.col("split") == "train"))
    out = pipe.transform(ls.where(F.col("split") == "test"), keep=["loan_id"])
    cols = [c for c in out.columns if c != "loan_id"]
    # long form: one narrow aggregate per column instead of one very wide row
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = out.selectExpr(f"stack({len(cols)}, {parts}) AS (column, value)")
    return long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
