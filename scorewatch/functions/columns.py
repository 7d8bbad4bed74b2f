"""Column-expression builders. All return `Column`s that stay inside codegen.

Fixed values that must equal the original's for equal results are listed
together below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the original's) -------------------------------
CLASS_THRESHOLD = 0.5
RISK_BAND_EDGES = (0.0, 0.3, 0.6, 1.0)          # right-closed, lowest edge excluded
RISK_BAND_LABELS = ("Low", "Medium", "High")
AGE_BINS = (0.0, 25.0, 45.0, 65.0, 100.0)       # first bin closed on both sides
AGE_LABELS = ("age_group_0", "age_group_1", "age_group_2", "age_group_3")
PROFIT_THRESHOLDS = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7000000000000001, 0.8, 0.9)
PROFIT_MARGIN = 0.15
DEFAULT_LOSS = 1.0
EPS_RATIO = 1e-8
LOG_LOSS_EPS = 2.220446049250313e-16
DRIFT_LEVELS = ((0.3, "High"), (0.1, "Medium"))   # else Low
STABILITY_LEVELS = ((0.1, "Good"), (0.2, "Moderate"))  # else Needs attention
# -----------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lin_edges(lo: float, hi: float, num: int) -> list[float]:
    """Evenly spaced edges with numpy.linspace's rounding: lo + i*step, last = hi."""
    step = (hi - lo) / (num - 1)
    edges = [i * step + lo for i in range(num)]
    edges[-1] = hi
    return edges


def classify(p, threshold: float = CLASS_THRESHOLD) -> Column:
    """#18: 1 if p > threshold (strict)."""
    return (col(p) > F.lit(threshold)).cast("int")


def risk_band(p) -> Column:
    """#19: (0,0.3] Low, (0.3,0.6] Medium, (0.6,1] High; outside (incl. p=0) NULL."""
    e = RISK_BAND_EDGES
    x = col(p)
    out = F.lit(None).cast("string")
    for i in range(len(e) - 2, -1, -1):
        out = F.when((x > F.lit(e[i])) & (x <= F.lit(e[i + 1])), F.lit(RISK_BAND_LABELS[i])).otherwise(out)
    return out


def recommendation(p) -> Column:
    """#20: Approve if p < 0.5 else Reject (p = 0.5 is Reject)."""
    return F.when(col(p) < F.lit(0.5), F.lit("Approve")).when(col(p).isNotNull(), F.lit("Reject"))


def right_closed_bin(x, edges: Sequence[float], include_lowest: bool = True) -> Column:
    """Index of the right-closed bin (e_i, e_{i+1}] holding x; NULL outside.

    With include_lowest the first bin is [e_0, e_1]. Comparisons against the
    edge literals (not division) so edge values land exactly where the
    interval rule says.
    """
    x = col(x)
    n = len(edges) - 1
    out = F.lit(None).cast("int")
    for i in range(n - 1, -1, -1):
        lo_ok = (x >= F.lit(edges[i])) if (i == 0 and include_lowest) else (x > F.lit(edges[i]))
        out = F.when(lo_ok & (x <= F.lit(edges[i + 1])), F.lit(i)).otherwise(out)
    return out


def edge_bin(x, lo, step, nbins: int, hi) -> Column:
    """Histogram bin of x for edges e_i = lo + i*step (i = 0..nbins, e_nbins = hi):
    bins [e_i, e_{i+1}) with the last one closed, as the count of interior edges
    <= x. This is searchsorted on the edge values, so values on an edge land
    exactly as in a numpy histogram. x outside [lo, hi] -> NULL.
    lo/step/hi may be Columns or floats.
    """
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    step = step if isinstance(step, Column) else F.lit(float(step))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    cnt = F.lit(0)
    for i in range(1, nbins):
        cnt = cnt + F.when(x >= lo + F.lit(i) * step, F.lit(1)).otherwise(F.lit(0))
    return F.when((x >= lo) & (x <= hi), cnt)


def with_edge_bin(df, x: str, lo, step, nbins: int, hi, out: str = "bin"):
    """DataFrame form of `edge_bin` with constant work per row: a first guess
    floor((x - lo) / step) in its own column, then one correction step against the
    edge values lo + k*step (last edge = hi). Same bins as counting edges."""
    xc = F.col(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    step = step if isinstance(step, Column) else F.lit(float(step))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    last = nbins - 1
    g = F.least(F.greatest(F.floor((xc - lo) / step), F.lit(0)), F.lit(last)).cast("int")
    d = df.withColumn("_g", g)
    k = F.col("_g")
    edge = lambda i: F.when(i == F.lit(nbins), hi).otherwise(lo + i * step)
    b = (F.when(xc < edge(k), k - 1)
         .when((k < F.lit(last)) & (xc >= edge(k + 1)), k + 1)
         .otherwise(k))
    return d.withColumn(out, F.when((xc >= lo) & (xc <= hi), b)).drop("_g")


def quarter(t) -> Column:
    """#23: floor(t/3)+1, absolute (no modulo)."""
    return (F.floor(col(t) / F.lit(3)) + 1).cast("bigint")


def age_group(years) -> Column:
    """#34: [0,25] (25,45] (45,65] (65,100] -> age_group_0..3; outside NULL."""
    idx = right_closed_bin(years, AGE_BINS, include_lowest=True)
    out = F.lit(None).cast("string")
    for i in range(len(AGE_LABELS) - 1, -1, -1):
        out = F.when(idx == F.lit(i), F.lit(AGE_LABELS[i])).otherwise(out)
    return out


def safe_ratio(a, b, eps: float = EPS_RATIO) -> Column:
    """a / (b + eps) without ANSI divide-by-zero errors (NULL when the divisor is 0)."""
    return F.try_divide(col(a), col(b) + F.lit(eps))


def div0(a, b) -> Column:
    """a / b with 0 for an empty (zero) denominator, like the original's guards."""
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(0.0))


def level(x, levels: Sequence[tuple[float, str]], default: str, strict_greater: bool = True) -> Column:
    """Threshold label chain: first (threshold, label) with x > threshold (or x < threshold)."""
    x = col(x)
    out = F.lit(default)
    for thr, lab in reversed(list(levels)):
        cond = (x > F.lit(thr)) if strict_greater else (x < F.lit(thr))
        out = F.when(cond, F.lit(lab)).otherwise(out)
    return out


def drift_level(score) -> Column:
    """#102: High > 0.3, Medium > 0.1, else Low."""
    return level(score, DRIFT_LEVELS, "Low")


def stability_level(score) -> Column:
    """#110: < 0.1 Good, < 0.2 Moderate, else Needs attention."""
    return level(score, STABILITY_LEVELS, "Needs attention", strict_greater=False)


#: Largest samples whose KS p-value is exact.
KS_EXACT = 64


def ks_exact(d, n, m) -> Column:
    """P(D >= d) for samples of n and m values without ties: one less the share of the lattice paths
    from (0, 0) to (n, m) that stay where |i / n - j / m| < d, counted row by row in an array fold."""
    d, n, m = col(d), col(n).cast("long"), col(m).cast("long")
    h = F.round(d * n * m).cast("long")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k)
    first = F.transform(upto(m), lambda j: F.when(j * n < h, F.lit(1.0)).otherwise(F.lit(0.0)))

    def row(before, i):
        def cell(out, j):
            left = F.coalesce(F.get(out, (j - 1).cast("int")), F.lit(0.0))
            return F.concat(out, F.array(F.when(F.abs(i * m - j * n) < h, F.get(before, j.cast("int")) + left).otherwise(F.lit(0.0))))
        return F.aggregate(upto(m), F.array().cast("array<double>"), cell)

    inside = F.element_at(F.aggregate(F.sequence(F.lit(1).cast("long"), n), first, row), -1)
    paths = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(1.0), lambda acc, k: acc * (m + k).cast("double") / k.cast("double"))
    return F.least(F.greatest(F.lit(1.0) - inside / paths, F.lit(0.0)), F.lit(1.0))


def ks_pvalue(d, n, m, terms: int = 100) -> Column:
    """#91: two-sample KS p-value: exact where both samples hold at most KS_EXACT values, else asymptotic
    (Stephens' effective-n correction).

    en = round(n*m/(n+m)); lam = (sqrt(en) + 0.12 + 0.11/sqrt(en)) * D;
    p = 2 * sum_{k=1..terms} (-1)^(k-1) exp(-2 k^2 lam^2), clipped to [0, 1];
    p = 1 when lam < 0.2. The asymptotic form approximates the exact distribution, so a flag can
    differ near the threshold for samples not much larger than KS_EXACT.
    """
    d, n, m = col(d), col(n).cast("double"), col(m).cast("double")
    en = F.round(n * m / (n + m))
    se = F.sqrt(en)
    lam = (se + F.lit(0.12) + F.lit(0.11) / se) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * (k * k).cast("double") * lam * lam),
    )
    p = F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0))
    return F.when((n <= 0) | (m <= 0), F.lit(None).cast("double")).when(
        (n <= KS_EXACT) & (m <= KS_EXACT), ks_exact(d, n, m)).when(lam < F.lit(0.2), F.lit(1.0)).otherwise(p)


def chi2_sf(stat, dof, terms: int = 2000) -> Column:
    """Chi-square survival function Q(dof/2, stat/2) by the lower-gamma series in log space.

    P(a, x) = sum_n exp(a ln x - x - lnGamma(a+n+1) + n ln x); lnGamma(a+n+1) is
    accumulated as lnGamma(a+1) + sum_k ln(a+k), and lnGamma(a+1) for a = dof/2
    (integer or half-integer) as a product. Far in the tail (x - a above
    50*sqrt(a) + 50) Q is below double precision and returns 0.
    """
    x = col(stat).cast("double") / F.lit(2.0)
    a = col(dof).cast("double") / F.lit(2.0)
    # lnGamma(a+1): a integer -> sum ln(1..a); half-integer -> ln(sqrt(pi)) + sum ln(k - 1/2), k=1..a+1/2
    is_int = F.floor(a) == a
    lg_int = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(a).cast("int"), F.lit(1))), F.lit(0.0),
                         lambda acc, k: acc + F.when(k.cast("double") <= a, F.ln(k.cast("double"))).otherwise(F.lit(0.0)))
    lg_half = F.lit(0.5723649429247001) + F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(a + F.lit(0.5)).cast("int"), F.lit(1))), F.lit(0.0),
        lambda acc, k: acc + F.ln(k.cast("double") - F.lit(0.5)))
    lg = F.when(is_int, lg_int).otherwise(lg_half)
    lnx = F.ln(x)
    acc0 = F.struct(F.lit(0.0).alias("s"), lg.alias("lg"))
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(terms - 1)), acc0,
        lambda acc, n: F.struct(
            (acc["s"] + F.exp(a * lnx - x - F.when(n == 0, acc["lg"]).otherwise(acc["lg"] + F.ln(a + n.cast("double")))
                              + n.cast("double") * lnx)).alias("s"),
            F.when(n == 0, acc["lg"]).otherwise(acc["lg"] + F.ln(a + n.cast("double"))).alias("lg")),
        lambda acc: acc["s"])
    q = F.least(F.greatest(F.lit(1.0) - series, F.lit(0.0)), F.lit(1.0))
    return (F.when(col(dof) <= 0, F.lit(None).cast("double"))
            .when(x <= 0, F.lit(1.0))
            .when(x - a > F.lit(50.0) * F.sqrt(a) + F.lit(50.0), F.lit(0.0))
            .otherwise(q))
