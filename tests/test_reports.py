"""Drift reports of many pairs, statistics of the transformed frame, loader fallback, numbered copies."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from scorewatch.operators import drift as D
from scorewatch.operators import features as FE
from scorewatch.operators import fitted as FT
from scorewatch.operators import metrics as M
from scorewatch.sources import fixtures as FX
from scorewatch.sources.tables import LENDING_CLUB, LoanSpec, read_loans


def samples(spark):
    lo = FX.loans(spark, SF_SMALL).select("loan_id", "AMT_CREDIT", "revol_util", F.lit(3.0).alias("same"), F.col("TARGET").alias("label"), F.col("score_b").alias("prob"))
    return lo.withColumn("part", (F.col("loan_id") % 3).cast("int")).withColumn("AMT_CREDIT", F.col("AMT_CREDIT") * (1 + F.col("part") * 0.2))


def test_reports_of_pairs_are_those_of_each(spark):
    df, feats = samples(spark), ["AMT_CREDIT", "revol_util", "same"]
    pairs = [("ab", 0, 1), ("bc", 1, 2), ("self", 2, 2)]
    got = {r.pair: r.asDict() for r in D.drift_reports(df, "part", pairs, feats).collect()}
    assert got.keys() == {"ab", "bc", "self"}
    for name, a, b in pairs[:2]:
        ref, cur = df.where(F.col("part") == a), df.where(F.col("part") == b)
        ks, js = D.ks_drift(ref, cur, feats).collect(), D.js_drift(ref, cur, feats).collect()
        r = got[name]
        assert r["ks_drift_count"] == sum(x.is_drift for x in ks) and r["js_drift_count"] == sum(x.is_drift for x in js) and r["total_features"] == 3
        p = D.ks_drift(ref, cur, ["prob"]).first()
        assert r["prediction_ks_statistic"] == pytest.approx(p.statistic) and r["prediction_drift"] == p.is_drift
        m = [M.all_metrics(x).first() for x in (ref, cur)]
        for c in D.COMPARED:
            assert r[f"{c}_degradation"] == pytest.approx(m[0][c] - m[1][c], abs=1e-9)
        one = D.drift_report(ref, cur, feats).first().asDict()
        assert all(one[k] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v) for k, v in r.items() if k != "pair")
    assert got["self"]["ks_drift_count"] == 0 and got["self"]["auc_roc_degradation"] == 0


def test_report_without_labels(spark):
    df = samples(spark)
    r = D.drift_report(df.where("part = 0"), df.where("part = 2"), ["AMT_CREDIT"], label=None).first()
    assert "auc_degradation" not in r.asDict() and r.ks_drift_count == 1


def test_constant_and_absent_values(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 1), ("a", None, 0.25, 0), ("b", 1.0, 0.5, 1), ("b", float("nan"), 0.75, 0)], "s string, x double, prob double, label int")
    r = D.drift_reports(df, "s", [("p", "a", "b")], ["x"]).first()
    assert (r.total_features, r.ks_drift_count, r.js_drift_count) == (1, 0, 0) and r.mean_prediction_shift == pytest.approx(0.25)


def test_statistics_of_the_transformed_frame(spark):
    rows = [(i, float(i % 40), 10.0 * (i % 11), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, month_no double, revol_util double, amount double").withColumn("TARGET", F.col("id") % 2)
    late = df.where("month_no < 20").withColumn("revol_util", F.col("revol_util") / 4)
    for batch in (False, True):
        p = FT.FeaturePipeline(exclude=["id"], scale=False, drop_redundant=False, batch_stats=batch)
        p.fit(df)
        x = p.transform(late, keep=["id"])
        top = x.agg(F.max("month_no_trend")).first()[0]
        assert top == pytest.approx(1.0 if batch else 19 / 39)
        bins = {r[0] for r in x.select("credit_util_binned").distinct().collect()}
        assert len(bins) == (FE.UTIL_BINS if batch else 3)


def test_fallback_of_each_schema(spark, tmp_path):
    a = read_loans(spark, f"{tmp_path}/none", on_error="fallback")
    b = read_loans(spark, f"{tmp_path}/none", LENDING_CLUB, on_error="fallback")
    assert (a.count(), b.count()) == (50_000, 30_000) and "TARGET" in a.columns and "loan_status" in b.columns
    (tmp_path / "bad.csv").write_text("TARGET,x\n" + "1,2\n" * 50 + "1,no number\n")
    spec = LoanSpec(fmt="csv", schema="TARGET int, x int")
    assert read_loans(spark, str(tmp_path / "bad.csv"), spec, on_error="fallback", fallback_rows=70).count() == 70
    with pytest.raises(Exception, match="MALFORMED|number"):
        read_loans(spark, str(tmp_path / "bad.csv"), spec).collect()


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    one = li.limit(1)
    many = li.unionByName(one.crossJoin(spark.range(500)).select(*li.columns))
    want = sorted(map(tuple, FX.items_book(spark, SF_SMALL, many).collect()))
    monkeypatch.setattr(FX, "COPY_BLOCK", 7)
    out = FX.items_book(spark, SF_SMALL, many)
    assert sorted(map(tuple, out.collect())) == want and len(want) == many.count()
    assert out.select("row_hash", "dup_no").distinct().count() == len(want) and out.agg(F.max("dup_no")).first()[0] >= 501
