"""Exact quantiles by distributed selection (#47).

Only finite numbers count. The rank of every wanted quantile is bracketed by two approximate quantiles, counted exactly, and
bracketed again inside its bracket, until few enough values lie between the ends to name the one
that holds the rank. Each pass is one aggregate for all columns and ranks together; its memory
does not depend on the number of rows, and at most `GATHERED` values a rank reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative width of a bracket, and most values between its ends that are looked at themselves.
SLACK, ACCURACY, GATHERED = 0.002, 1_000, 2_000


@dataclass
class _Rank:
    """A 0-based rank of a column; its value lies in [lo, hi], with `below` values less than lo."""

    column: str
    rank: int
    lo: float = -math.inf
    hi: float = math.inf
    value: float | None = None

    def at(self):
        x = _value(self.column)
        return x, F.lit(self.lo), F.lit(self.hi)


def _value(column: str):
    x = F.col(f"`{column}`").cast("double")
    return F.when(F.abs(x) < math.inf, x)


def _narrow(df: DataFrame, open_: list[_Rank], inside: dict[int, tuple[int, int]]) -> None:
    """New brackets from approximate quantiles of the values strictly inside the old ones. `inside`:
    for each rank how many values lie there, and how many of all lie below them."""
    aggs = []
    for i, r in enumerate(open_):
        n, below = inside[i]
        x, lo, hi = r.at()
        shares = [max(0.0, (r.rank - below) / n - SLACK), min(1.0, (r.rank - below + 1) / n + SLACK)]
        aggs.append(F.percentile_approx(F.when((x > lo) & (x < hi), x), F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias(f"q{i}"))
    got = df.agg(*aggs).first()
    for i, r in enumerate(open_):
        r.lo, r.hi = got[f"q{i}"]


def select_ranks(df: DataFrame, ranks: dict[str, Sequence[int]], counts: dict[str, int], gathered: int = GATHERED) -> dict[tuple[str, int], float]:
    """{(column, rank): value}: the value at each 0-based rank among a column's numbers. `counts`: how
    many numbers each column has."""
    all_ = [_Rank(c, r) for c, rs in ranks.items() for r in sorted(set(rs))]
    open_ = [r for r in all_ if counts[r.column] > r.rank >= 0]
    inside = {i: (counts[r.column], 0) for i, r in enumerate(open_)}
    few: list[_Rank] = []
    below_few: dict[int, int] = {}
    while open_:
        ends = [(r.lo, r.hi) for r in open_]
        _narrow(df, open_, inside)
        aggs = []
        for i, r in enumerate(open_):
            x, lo, hi = r.at()
            aggs += [F.count_if(x < lo).alias(f"a{i}"), F.count_if(x == lo).alias(f"b{i}"), F.count_if((x > lo) & (x < hi)).alias(f"c{i}"), F.count_if(x == hi).alias(f"d{i}")]
        got = df.agg(*aggs).first()
        rest, left = [], {}
        for i, r in enumerate(open_):
            a, b, c, d = (got[f"{k}{i}"] for k in "abcd")
            if r.lo == r.hi:
                d = 0
            if r.rank < a:  # the approximation was off: what lies below the bracket is left
                r.lo, r.hi = ends[i][0], r.lo
                n, below = a - inside[i][1], inside[i][1]
            elif r.rank < a + b:
                r.value = r.lo
                continue
            elif r.rank < a + b + c:
                n, below = c, a + b
            elif r.rank < a + b + c + d:
                r.value = r.hi
                continue
            else:
                below = a + b + c + d
                n = inside[i][0] + inside[i][1] - below
                r.lo, r.hi = r.hi, ends[i][1]
            if n <= gathered:
                few.append(r)
                below_few[id(r)] = below
            else:
                left[len(rest)] = (n, below)
                rest.append(r)
        open_, inside = rest, left
    if few:
        named = []
        for i, r in enumerate(few):
            x, lo, hi = r.at()
            named.append(F.when((x > lo) & (x < hi), F.struct(F.lit(i).alias("i"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*named))).alias("v")).groupBy("v.i", "v.x").count().collect()
        for i, r in enumerate(few):
            at = below_few[id(r)]
            for x, n in sorted((row["x"], row["count"]) for row in rows if row["i"] == i):
                at += n
                if r.rank < at:
                    r.value = x
                    break
    return {(r.column, r.rank): r.value for r in all_}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], gathered: int = GATHERED) -> dict[str, list[float] | None]:
    """{column: values at `shares`}, interpolated between neighbouring ranks; NULL, NaN and infinite
    values do not count. None for a column without a number."""
    df = df.select(*dict.fromkeys(columns))
    n = df.agg(*[F.count(_value(c)).alias(c) for c in dict.fromkeys(columns)]).first().asDict()
    at = {c: [s * (n[c] - 1) for s in shares] for c in columns if n[c]}
    ranks = {c: [r for p in ps for r in (math.floor(p), min(math.floor(p) + 1, n[c] - 1))] for c, ps in at.items()}
    found = select_ranks(df, ranks, n, gathered) if ranks else {}

    def between(c: str, p: float) -> float:
        lo, hi = found[c, math.floor(p)], found[c, min(math.floor(p) + 1, n[c] - 1)]
        return lo + (hi - lo) * (p - math.floor(p))

    return {c: [between(c, p) for p in at[c]] if c in at else None for c in columns}
