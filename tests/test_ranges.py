"""Balanced ranges, exact selection and distributed codes against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators import drift as D
from scorewatch.operators import fitted as FT
from scorewatch.operators import rankstats as RS
from scorewatch.operators import selection as SE


def outliers(spark, n=4000):
    rnd = random.Random(3)
    rows = [("f", rnd.random()) for _ in range(n)] + [("f", 1e18), ("f", -1e300)] + [("g", float(i % 5)) for i in range(50)] + [("one", 1.0)]
    return spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("c"))


@pytest.mark.parametrize("buckets", [4, 37, 200])
def test_an_outlier_leaves_ranges_balanced(spark, buckets):
    counts = outliers(spark)
    rows = RS.bucketed(counts, ["k"], "v", buckets, "quantile").collect()
    sizes = {}
    for r in rows:
        if r.k == "f":
            sizes[r["_bucket"]] = sizes.get(r["_bucket"], 0) + 1
    assert len(sizes) > 0.8 * buckets and max(sizes.values()) < 3 * 4002 / buckets + 20
    by_value = sorted((r.v, r["_bucket"]) for r in rows if r.k == "f")
    assert [b for _, b in by_value] == sorted(b for _, b in by_value)
    equal_width = RS.bucketed(counts.where("k = 'f'"), ["k"], "v", buckets, "range").groupBy("_bucket").count().count()
    assert equal_width <= 3  # what the outliers did to equal widths


@pytest.mark.parametrize("by", [["k"], []])
def test_prefix_sums_in_sketched_ranges(spark, by):
    counts = outliers(spark, 500) if by else outliers(spark, 500).where("k = 'f'").drop("k")
    out = RS.prefix_sums(counts, by, "v", ["c"], 7, "quantile").collect()
    groups = {}
    for r in out:
        groups.setdefault(r["k"] if by else None, []).append(r)
    for rows in groups.values():
        below = 0
        for r in sorted(rows, key=lambda r: r.v):
            assert (r.c_below, r.c_total) == (below, sum(x.c for x in rows))
            below += r.c


def test_ks_with_an_outlier(spark):
    rnd = random.Random(4)
    a = [(rnd.gauss(0, 1),) for _ in range(300)] + [(1e18,)]
    b = [(rnd.gauss(0.4, 1),) for _ in range(200)]
    r = D.ks_drift(spark.createDataFrame(a, "x double"), spark.createDataFrame(b, "x double"), ["x"], buckets=16).first()
    xs, ys = np.sort([v for v, in a]), np.sort([v for v, in b])
    every = np.concatenate([xs, ys])
    assert r.statistic == pytest.approx(np.abs(np.searchsorted(xs, every, "right") / 301 - np.searchsorted(ys, every, "right") / 200).max())


@pytest.mark.parametrize("gathered", [1, 30, 2000])
def test_exact_quantiles(spark, gathered):
    rnd = random.Random(9)
    rows = [(rnd.gauss(0, 1), float(rnd.randrange(3)), rnd.choice([None, float("nan"), 10.0 ** rnd.uniform(-300, 300)]), 7, None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int, e double").repartition(5)
    shares = [0.0, 0.2, 0.4, 0.5, 0.61803, 0.8, 1.0]
    got = SE.exact_quantiles(df, ["a", "b", "c", "d", "e"], shares, gathered)
    assert got["e"] is None and got["d"] == [7.0] * 7
    for i, c in enumerate("abc"):
        x = np.array([r[i] for r in rows if r[i] is not None and r[i] == r[i]])
        assert np.allclose(got[c], np.quantile(x, shares), rtol=1e-12, atol=0)


@pytest.mark.parametrize("gathered", [1, 2000])
def test_every_rank_of_finite_values(spark, gathered):
    x = [float("-inf")] * 5 + [1.0, 2.0, 3.0] * 10 + [-1e308, 1e308, 4.0, 5.0] + [float("inf")] * 3
    finite = sorted(v for v in x if abs(v) < float("inf"))
    found = SE.select_ranks(spark.createDataFrame([(v,) for v in x], "x double"), {"x": range(34)}, {"x": 34}, gathered)
    assert [found["x", i] for i in range(34)] == finite


def test_cut_points_need_no_percentile_of_all_values(spark):
    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).cast("double").alias("x"))
    e = FT.equal_freq_edges(df, ["x"], 5)
    assert np.allclose(e.first().edges, [9999.8, 19999.6, 29999.4, 39999.2])
    assert FT.equal_freq_edges(df.limit(0), ["x"], 5).count() == 0


def test_codes_of_a_million_values(spark):
    n = 1_000_000
    df = spark.range(n).select(F.format_string("v%07d", (F.col("id") * 7919) % n).alias("big"), (F.col("id") % 3).cast("string").alias("small"),
                               F.when(F.col("id") % 2 == 0, F.lit("é")).alias("half"))
    state = FT.fit_ordinal(df, ["big", "small", "half"], ranges=13)
    wrong = state.where((F.col("column") == "big") & (F.col("value") != F.format_string("v%07d", F.col("code"))))
    assert wrong.isEmpty() and state.where("column = 'big'").count() == n
    assert {(r.column, r.value, r.code) for r in state.where("column != 'big'").collect()} == {("small", "0", 0), ("small", "1", 1), ("small", "2", 2), ("half", "é", 0)}
    plan = state._jdf.queryExecution().toString()
    assert "dense_rank" not in plan


def test_profile_without_shuffled_values(spark):
    """What decides roles and constant columns is exact: distinct numbers near a limit, shares of common values."""
    from scorewatch.operators.descriptive import role_of

    rnd = random.Random(12)
    n = 2000
    rows = [(i, i % 50, i % 51, i % 100, i % 101, 7 if i % 50 else None, 7.0 if i % 100 else float("nan"), "same" if i >= 41 else f"v{i}", None, rnd.random(),
             "a" if rnd.random() < 0.6 else f"b{i}") for i in range(n)]
    names = ["id", "fifty", "fifty_one", "hundred", "hundred_one", "with_null", "with_nan", "mostly", "none", "real", "majority"]
    df = spark.createDataFrame(rows, "id int, fifty int, fifty_one int, hundred int, hundred_one int, with_null int, with_nan double, mostly string, none string, real double, majority string").repartition(4)
    got = FT.FeaturePipeline()._profile(df)
    for i, c in enumerate(names):
        x = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        top = max((x.count(v) for v in set(x[:100]) | set(x[-3:])), default=0) if c not in ("id", "real") else 1
        p, kind = got[c], c not in ("mostly", "none", "majority")
        assert p["rows"] == n and p["nulls"] == n - len(x)
        assert role_of(c, kind, p["distinct"], n) == role_of(c, kind, len(set(x)), n)
        assert p["distinct"] == len(set(x)) if len(set(x)) <= 101 else p["distinct"] > 1000 or c == "majority"
        assert (p["top_nn"] or 0) == top if top > n / 2 else (p["top_nn"] or 0) <= n / 2
        if kind and x:
            assert (p["lo"], p["hi"]) == (min(x), max(x))
