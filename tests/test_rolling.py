"""Rolling sums across ranges against plain windows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators import ensemble as EN
from scorewatch.operators import rolling as RO


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_window_sums(n):
    x = np.random.default_rng(n).random(173)
    assert np.allclose(RO.window_sums(x, n), [x[max(0, i - n + 1):i + 1].sum() for i in range(len(x))], rtol=1e-14)
    assert len(RO.window_sums(x[:0], n)) == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_windows_reach_across_ranges(spark, ranges):
    rnd = random.Random(5)
    rows = [(k, i, rnd.choice([rnd.random(), None])) for k, size in (("a", 400), ("b", 3), (None, 90), ("c", 1), ("d", 200)) for i in range(size)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    out = RO.rolling_means(df, ["k"], ["i"], "v", [3, 60, 1], ranges).collect()
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((i, v) for kk, i, v in rows if kk == k and v is not None)
        for at, (i, _) in enumerate(own):
            want[k, i] = [x for n in (1, 3, 60) for x in (min(at + 1, n), np.mean([v for _, v in own[max(0, at - n + 1):at + 1]]))]
    assert len(out) == len(want)
    for r in out:
        assert np.allclose(list(r[2:]), want[r.k, r.i], rtol=1e-12)


def test_one_key_and_two_order_columns(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("m"), F.col("id").alias("i"), (F.col("id") * 1.5).alias("v"))
    out = RO.rolling_means(df, [], ["m", "i"], "v", [11], 6).orderBy("m", "i").collect()
    v = [1.5 * i for _, i in sorted((i % 7, i) for i in range(500))]
    assert np.allclose([r.mean_11 for r in out], [np.mean(v[max(0, j - 10):j + 1]) for j in range(500)])


def test_nothing_and_bad_windows(spark):
    df = spark.createDataFrame([], "k string, i int, v double")
    assert RO.rolling_means(df, ["k"], ["i"], "v", [5]).count() == 0
    for bad in ([], [0], [-1, 5]):
        with pytest.raises(ValueError):
            RO.rolling_means(df, ["k"], ["i"], "v", bad)


def test_ten_million_errors_of_very_unequal_size(spark):
    """Running sums would lose the small errors behind the large ones."""
    n, w = 10_000_000, 1000
    size = F.pow(F.lit(10.0), -(F.pmod(F.xxhash64("id"), F.lit(13))).cast("double"))
    df = spark.range(n).select("id", F.when(F.col("id") < n // 2, F.lit(1e9)).otherwise(size * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) * 1e-12).alias("v"))
    out = RO.rolling_means(df, [], ["id"], "v", [w], 24)
    asked = [n // 2 + 1500, n // 2 + 999_999, n - 1, n // 2 + w - 1]
    got = {r["id"]: r["mean_1000"] for r in out.where(F.col("id").isin(asked)).collect()}
    for i in asked:
        v = [r.v for r in df.where((F.col("id") > i - w) & (F.col("id") <= i)).collect()]
        assert got[i] == pytest.approx(math.fsum(v) / w, rel=1e-12)
    assert out.agg(F.count("*"), F.min("n_1000"), F.max("n_1000")).first() == (n, 1, w)


def test_monitors_of_several_windows_are_those_of_each(spark):
    rnd = random.Random(1)
    rows = [(m, b, i, int(rnd.random() < 0.3), rnd.random()) for m in "xy" for b in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "model_id string, b int, i int, label int, prob double")
    all_ = {tuple(r) for r in EN.monitor_windows(df, [], "b", ["b", "i"], [50, 120], min_n=20).collect()}
    each = {(r.model_id, r.b, n, r.brier_score, r.auc_roc) for n in (50, 120) for r in EN.monitor_metrics(df, [], "b", ["b", "i"], n=n, min_n=20).collect()}
    assert len(all_) == 16
    assert {(a, b, c, round(d, 12), e) for a, b, c, d, e in all_} == {(a, b, c, round(d, 12), e) for a, b, c, d, e in each}
