"""Hand-computed micro cases (expected values worked out by hand)."""

import math

import pytest
from pyspark.sql import functions as F

from scorewatch.functions.columns import age_group, classify, quarter, recommendation, risk_band
from scorewatch.operators import drift as D
from scorewatch.operators import ensemble as EN
from scorewatch.operators import fitted as FT
from scorewatch.operators import metrics as M
from scorewatch.operators import rankstats as RS
from scorewatch.operators import splits as SP
from scorewatch.operators import stability as ST


def scored(spark, ys, ps):
    return spark.createDataFrame([(i, int(y), float(p)) for i, (y, p) in enumerate(zip(ys, ps))], "id long, label int, prob double")


@pytest.mark.parametrize("bucketing,buckets", [("unit", 64), ("range", 4), ("quantile", 4), ("unit", 1)])
def test_auc_ties_and_perfect(spark, bucketing, buckets):
    r = RS.auc_terms(RS.ranked_scores(scored(spark, [0, 1, 0, 1], [0.5] * 4), [], "prob", "label", None, buckets, bucketing), [])
    assert r.first()["auc_roc"] == pytest.approx(0.5)
    r = RS.auc_terms(RS.ranked_scores(scored(spark, [0, 0, 1, 1], [0, 0.1, 0.9, 1]), [], "prob", "label", None, buckets, bucketing), [])
    row = r.first()
    assert row["auc_roc"] == pytest.approx(1.0) and row["auc_pr"] == pytest.approx(1.0)


def test_auc_matches_pairwise_count(spark):
    import random
    rnd = random.Random(7)
    ys = [rnd.randint(0, 1) for _ in range(300)]
    ps = [round(rnd.random(), 2) for _ in range(300)]
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    brute = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    got = RS.auc_roc(scored(spark, ys, ps).repartition(7)).first()["auc_roc"]
    assert got == pytest.approx(brute, abs=1e-12)


def test_ks_equal_and_disjoint(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    r = D.ks_drift(a, a, ["x"]).first()
    assert r["statistic"] == 0.0 and not r["is_drift"]
    b = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    c = spark.createDataFrame([(3.0,), (4.0,)], "x double")
    assert D.ks_drift(b, c, ["x"]).first()["statistic"] == pytest.approx(1.0)


def test_js_equal_and_disjoint(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert D.js_drift(a, a, ["x"]).first()["js_distance"] == pytest.approx(0.0, abs=1e-12)
    lo = spark.createDataFrame([(0.0,), (0.1,)], "x double")
    hi = spark.createDataFrame([(9.0,), (10.0,)], "x double")
    assert D.js_drift(lo, hi, ["x"]).first()["js_distance"] == pytest.approx(math.sqrt(math.log(2)))


def test_ece_with_zero_probability(spark):
    df = scored(spark, [0, 1], [0.0, 0.95])
    assert M.calibration_error(df, mode="standard").first()["calibration_error"] == pytest.approx(0.025)
    assert M.calibration_error(df, mode="compat").first()["calibration_error"] == pytest.approx(0.0)


def test_bands_classes_age_quarter(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,), (0.5,)], "p double")
    rows = df.select(risk_band("p").alias("b"), classify("p").alias("c"), recommendation("p").alias("r")).collect()
    assert [r["b"] for r in rows] == [None, "Low", "Medium", "High", "Medium"]
    assert (rows[4]["c"], rows[4]["r"]) == (0, "Reject")
    ages = spark.createDataFrame([(0.0,), (25.0,), (45.5,), (100.0,), (101.0,)], "a double")
    assert [r[0] for r in ages.select(age_group("a")).collect()] == [
        "age_group_0", "age_group_0", "age_group_2", "age_group_3", None]
    q = spark.createDataFrame([(0,), (2,), (3,), (23,)], "t int")
    assert [r[0] for r in q.select(quarter("t")).collect()] == [1, 1, 2, 8]


def test_split_bounds_and_errors(spark):
    df = spark.createDataFrame([(t, i) for t in range(24) for i in range(2)], "t int, i int")
    out = SP.temporal_split(df, "t", 12, 4, 8, keep_period=True)
    got = {r["split"]: (r["lo"], r["hi"]) for r in out.groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert got == {"train": (0, 11), "val": (12, 15), "test": (16, 23)}
    assert "t" not in SP.temporal_split(df, "t").columns
    one = spark.createDataFrame([(3,)], "t int")
    with pytest.raises(ValueError, match="Insufficient time periods"):
        SP.temporal_split(one, "t", 5, 2, 2)
    with pytest.raises(KeyError):
        SP.temporal_split(df, "missing")


def test_scale_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    st = FT.fit_scale(df, ["x"])
    assert st["x"][1] == pytest.approx(1.118034, abs=1e-6)
    first = FT.apply_scale(df, st).orderBy("x").first()["x"]
    assert first == pytest.approx(-1.341641, abs=1e-6)


def test_monitor_needs_min_buffer(spark):
    df = spark.createDataFrame([(0, i, 1, 0.9) for i in range(3)], "m int, t long, label int, prob double")
    r = EN.rolling_brier(df.withColumn("k", F.col("t")), ["m"], ["t"], 1000, 100)
    assert all(x["rolling_brier"] == 0.0 for x in r.collect())


def test_rolling_brier_matches_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(m, t, rnd.randint(0, 1), rnd.random()) for m in range(2) for t in range(400)]
    df = spark.createDataFrame(rows, "m int, t long, label int, prob double")
    r = {(x["m"], x["t"]): x["rolling_brier"] for x in EN.rolling_brier(df, ["m"], ["t"], 50, 10).collect()}
    for m in range(2):
        seq = [(y, p) for mm, t, y, p in rows if mm == m]
        for t in (5, 9, 10, 49, 50, 51, 399):
            win = seq[max(0, t - 49): t + 1]
            exp = sum((p - y) ** 2 for y, p in win) / len(win) if len(win) >= 10 else 0.0
            assert r[(m, t)] == pytest.approx(exp, abs=1e-9)


def test_calibration_trend(spark):
    h = spark.createDataFrame([(0, i, 0.10 + 0.01 * i) for i in range(10)], "m int, i int, brier double")
    last = EN.calibration_trend(h, ["m"], "i", "brier", 10).orderBy(F.col("i").desc()).first()
    assert last["calibration_trend"] == pytest.approx(-0.01)


def test_trend_score_short_history(spark):
    sc = scored(spark, [0, 1], [0.2, 0.8]).withColumn("m", F.lit(1))
    hist = spark.createDataFrame([(1, 0, 0.7)], "m int, period int, value double")
    r = ST.composite_stability(sc, hist, ["m"]).first()
    assert r["trend_score"] == 1.0


def test_weights_equal_auc_empty_buffer_stay_equal(spark):
    mm = spark.createDataFrame([(m, 0.7, 0.0) for m in "abc"], "model_id string, auc_roc double, brier_score double")
    w0 = EN.equal_weights(mm)
    w = {r["model_id"]: r["weight"] for r in EN.update_weights(mm, w0).collect()}
    assert all(v == pytest.approx(1 / 3) for v in w.values())
    assert sum(w.values()) == pytest.approx(1.0)


def test_stability_score_and_drift_score(spark):
    st = spark.createDataFrame([("auc_roc", 0.2), ("brier_score", 3.0)], "metric string, cv double")
    assert ST.stability_score(st).first()["overall_stability_score"] == pytest.approx(0.6)
    r = spark.range(1).select(D.overall_drift_score(F.lit(0.5), F.lit(0.2), F.lit(True)).alias("s"))
    from scorewatch.functions.columns import drift_level
    row = r.select("s", drift_level("s").alias("l")).first()
    assert row["s"] == pytest.approx(0.65) and row["l"] == "High"


def test_early_stop_sequences(spark):
    def run(vals, patience, mode):
        h = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(vals)], "k int, i int, v double")
        return EN.early_stop(h, ["k"], "i", "v", patience, 0.001, mode).first()
    assert run([0.5, 0.6, 0.65, 0.7], 5, "max")["stop_at"] is None
    assert run([0.5, 0.5, 0.5], 2, "max")["stop_at"] == 3
    assert run([1.0, 1.1, 1.2], 2, "min")["stop_at"] == 3
