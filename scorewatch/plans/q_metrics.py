"""Registered score-quality queries (#12, #18-22, #58-81, #107, #135)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.operators import metrics as M
from scorewatch.operators import rankstats as RS
from scorewatch.operators.splits import split_summary
from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import all_metrics_sql, auc_sql, ranked_sql, r6, with_views
from scorewatch.sources import fixtures as FX


def _split_long(spark, sf_dir):
    ls = FX.loans_split(spark, sf_dir)
    return ls.select(
        "loan_id", "month_no", "split", F.col("TARGET").alias("label"),
        F.expr("stack(3, 'a', score_a, 'b', score_b, 'c', score_c) AS (model_id, prob)"))


@register("metrics_by_split", with_views("split_long") + all_metrics_sql("split_long", ["split", "model_id"]))
def metrics_by_split(spark, sf_dir):
    """#135 / slice 1: the full metric row per (split, model)."""
    return M.all_metrics(_split_long(spark, sf_dir), ["split", "model_id"])


@register("metrics_by_dataset", with_views("book") + all_metrics_sql("book", ["dataset", "split"]))
def metrics_by_dataset(spark, sf_dir):
    """#135: the full metric row per (dataset, split)."""
    return M.all_metrics(FX.book(spark, sf_dir), ["dataset", "split"])


@register("metrics_by_period", with_views("scored_long") + all_metrics_sql("scored_long", ["month_no", "model_id"]))
def metrics_by_period(spark, sf_dir):
    """#107: full metric row per (period, model)."""
    return M.all_metrics(FX.scored_long(spark, sf_dir), ["month_no", "model_id"])


@register("all_metrics", with_views("scored_long") + all_metrics_sql("scored_long", ["model_id"]))
def all_metrics(spark, sf_dir):
    """#79: full metric row per model over the whole table."""
    return M.all_metrics(FX.scored_long(spark, sf_dir), ["model_id"])


@register("weighted_metrics", with_views("doc_quality") + all_metrics_sql("doc_quality", [], weight="weight"))
def weighted_metrics(spark, sf_dir):
    """#73: weighted metric row (weight = 1 + toxic) over labelled documents."""
    return M.all_metrics(FX.doc_quality(spark, sf_dir), [], weight="weight")


_AUC_SQL = with_views("scored_long") + f"""
SELECT model_id, {r6('auc_roc', 'auc_roc')}, n_pos, n_neg FROM ({auc_sql(ranked_sql('scored_long', ['model_id']), ['model_id'])})"""


@register("auc_roc", _AUC_SQL)
def auc_roc(spark, sf_dir):
    """#66: exact ROC AUC per model (ties count one half)."""
    return RS.auc_roc(FX.scored_long(spark, sf_dir), ["model_id"]).select("model_id", "auc_roc", "n_pos", "n_neg")


_AP_SQL = with_views("scored_long") + f"""
SELECT model_id, month_no >= 40 AS late, {r6('auc_pr', 'auc_pr')} FROM (
{auc_sql(ranked_sql("(SELECT *, month_no >= 40 AS late FROM scored_long)", ['model_id', 'late']), ['model_id', 'late'])})
""".replace("SELECT model_id, month_no >= 40 AS late,", "SELECT model_id, late,")


@register("auc_pr", _AP_SQL)
def auc_pr(spark, sf_dir):
    """#67: average precision (step sum) per (model, early/late half)."""
    df = FX.scored_long(spark, sf_dir).withColumn("late", F.col("month_no") >= 40)
    return RS.auc_roc(df, ["model_id", "late"]).select("model_id", "late", "auc_pr")
