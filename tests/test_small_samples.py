"""Exact KS p-values and the points of the parameter search."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from scorewatch.functions.columns import ks_pvalue
from scorewatch.operators import ensemble as EN


def exact(d, n, m):
    """P(D >= d) by counting all lattice paths with whole numbers."""
    row = [1] + [0] * m
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                inside = abs(Fraction(i, n) - Fraction(j, m)) < d
                row[j] = ((row[j] if i else 0) + (row[j - 1] if j else 0)) if inside else 0
    return 1 - Fraction(row[m], comb(n + m, n)) if d > 0 else Fraction(1)


def test_exact_p_values(spark):
    cases = [(n, m, k) for n in (1, 2, 3, 5, 8, 17, 30) for m in (1, 4, 7, 12, 30) for k in range(0, n * m + 1, max(1, n * m // 6))]
    df = spark.createDataFrame([(n, m, k, k / (n * m)) for n, m, k in cases], "n int, m int, k int, d double")
    for r in df.select("*", ks_pvalue("d", "n", "m").alias("p")).collect():
        assert r.p == pytest.approx(float(exact(Fraction(r.k, r.n * r.m), r.n, r.m)), abs=1e-12), r


def test_known_p_values_and_the_switch(spark):
    # Tables: n = m = 4 with D = 1 has 2 / C(8, 4) paths; n = m = 5 with D = 4/5 has 20 / C(10, 5).
    df = spark.createDataFrame([(4, 4, 1.0), (5, 5, 0.8), (64, 64, 0.25), (65, 65, 0.25), (0, 5, 0.5)], "n int, m int, d double")
    p = [r.p for r in df.select(ks_pvalue("d", "n", "m").alias("p")).collect()]
    assert p[0] == pytest.approx(2 / 70) and p[1] == pytest.approx(20 / 252) and p[4] is None
    assert p[2] == pytest.approx(float(exact(Fraction(1, 4), 64, 64))) and abs(p[2] - p[3]) < 0.01


def test_search_points_cover_the_ranges():
    points = EN.search_points(30, 42)
    assert points == EN.search_points(30, 42) != EN.search_points(30, 43) and len(set(points)) == 30
    for i, (lo, hi) in ((0, EN.SEARCH_ALPHA), (1, EN.SEARCH_FLOOR), (3, EN.SEARCH_THRESHOLD)):
        values = sorted(p[i] for p in points)
        assert lo <= values[0] < lo + 0.2 * (hi - lo) and hi >= values[-1] > hi - 0.2 * (hi - lo)
        assert max(b - a for a, b in zip(values, values[1:], strict=False)) < 0.2 * (hi - lo)
    assert {p[2] for p in points} == set(EN.SEARCH_WINDOWS)


def test_all_windows_come_from_one_pass(spark, monkeypatch):
    calls, plain = [], EN.rolling_means
    monkeypatch.setattr(EN, "rolling_means", lambda *a, **k: calls.append(a[4]) or plain(*a, **k))
    df = spark.range(400).select((F.col("id") % 4).alias("b"), "id", F.lit("m").alias("model_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 400).alias("prob"))
    ev = df.select(F.col("id").alias("loan_id"), "model_id", "label", "prob")
    out = EN.search_weights(df, ev, EN.search_points(30), "b", ["b", "id"])
    assert out.count() == 30 and calls == [list(EN.SEARCH_WINDOWS)]
