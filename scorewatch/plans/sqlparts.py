"""DuckDB SQL twins of the fixture views and of the grouped metric plans.

Only used to build the oracle strings of the query modules (the driver runs them in
DuckDB against the same parquet tables). Nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from scorewatch.functions.columns import (
    LOG_LOSS_EPS, PROFIT_MARGIN, PROFIT_THRESHOLDS, lin_edges,
)

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, deps: tuple[str, ...] = ()):
    def deco(sql: str):
        VIEWS[name] = (sql, deps)
        return sql
    return deco


view("loans")("""
SELECT o.o_orderkey AS loan_id, o.o_custkey AS customer_id,
  CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS INTEGER) AS month_no,
  o.o_orderpriority AS ORGANIZATION_TYPE,
  o.o_totalprice AS AMT_CREDIT,
  c.c_acctbal AS AMT_INCOME_TOTAL,
  li.ext AS AMT_ANNUITY,
  li.ext / 12e0 AS installment,
  li.disc_sum / li.n * 1000e0 AS revol_util,
  CAST(-(6570 + (o.o_custkey * 37) % 21900) AS BIGINT) AS DAYS_BIRTH,
  CAST(coalesce(li.n, 0) AS BIGINT) AS CNT_ITEMS,
  CAST(coalesce(li.bad, 0) AS INTEGER) AS TARGET,
  coalesce(li.n, 0) / (coalesce(li.n, 0) + 2e0) AS score_a,
  o.o_totalprice / 500000e0 AS score_b,
  (coalesce(li.n, 0) / (coalesce(li.n, 0) + 2e0) + o.o_totalprice / 500000e0) / 2e0 AS score_c
FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS n,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ext,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc_sum,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad
  FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
""")

view("scored_long", ("loans",))("""
SELECT loan_id, month_no, model_id, TARGET AS label, prob FROM (
  SELECT loan_id, month_no, TARGET, 'a' AS model_id, score_a AS prob FROM loans
  UNION ALL SELECT loan_id, month_no, TARGET, 'b', score_b FROM loans
  UNION ALL SELECT loan_id, month_no, TARGET, 'c', score_c FROM loans)
""")

view("loans_split", ("loans",))("""
SELECT *, CASE WHEN month_no < 40 THEN 'train' WHEN month_no < 55 THEN 'val' ELSE 'test' END AS split
FROM loans WHERE month_no IS NOT NULL
""")

view("split_long", ("loans_split",))("""
SELECT loan_id, month_no, split, model_id, TARGET AS label, prob FROM (
  SELECT loan_id, month_no, split, TARGET, 'a' AS model_id, score_a AS prob FROM loans_split
  UNION ALL SELECT loan_id, month_no, split, TARGET, 'b', score_b FROM loans_split
  UNION ALL SELECT loan_id, month_no, split, TARGET, 'c', score_c FROM loans_split)
""")

view("loans_shift", ("loans",))("""
SELECT * REPLACE (
  CASE WHEN month_no >= 40 THEN AMT_CREDIT * 1.3e0 ELSE AMT_CREDIT END AS AMT_CREDIT,
  CASE WHEN month_no >= 40 THEN score_b * 0.8e0 ELSE score_b END AS score_b),
  month_no >= 40 AS is_current
FROM loans
""")

view("book", ("loans",))("""
SELECT dataset, CASE WHEN month_no < 40 THEN 'train' WHEN month_no < 55 THEN 'val' ELSE 'test' END AS split, label, prob, amount, rate FROM (
  SELECT 'loans' AS dataset, month_no, TARGET AS label, score_c AS prob, AMT_ANNUITY / nullif(CNT_ITEMS, 0) AS amount, revol_util / 10e0 AS rate FROM loans
  UNION ALL SELECT 'items', CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER), CAST(l_returnflag = 'R' AS INTEGER),
    l_quantity / 50e0, l_extendedprice, l_discount * 100e0 FROM lineitem) WHERE month_no IS NOT NULL
""")

view("doc_quality")("""
SELECT l.doc_id, CAST(l.quality AS INTEGER) AS label,
  least(greatest(d.n_chars / 20000e0, 0e0), 1e0) AS prob,
  CAST(1 + l.toxic AS DOUBLE) AS weight
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")

view("event_scores")("""
SELECT event_id, ts, user_id, event_type,
  CAST(event_type = 'error' AS INTEGER) AS label,
  least(value / 100e0, 1e0) AS prob
FROM events
""")


def with_views(*names: str) -> str:
    """WITH clause holding the named views and their dependencies, in order."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in order) + "\n"


def dlit(x: float) -> str:
    """Exact double literal for DuckDB (scientific notation parses as DOUBLE, not DECIMAL)."""
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def r6(expr: str, alias: str) -> str:
    """round(x * 1e6) / 1e6: identical IEEE steps in Spark and DuckDB (see catalog.rnd)."""
    return f"round(CAST({expr} AS DOUBLE) * 1e6) / 1e6 AS {alias}"


_r6 = r6


def edge_bin_sql(x: str, lo: str, step: str, hi: str, nb: int) -> str:
    """Histogram bin as the count of interior edges lo + i*step <= x (last bin closed)."""
    terms = " + ".join(f"(CASE WHEN {x} >= {lo} + {i} * {step} THEN 1 ELSE 0 END)" for i in range(1, nb))
    return f"CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN {terms or '0'} END"


def div0(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0e0)"


def _gb(by: Sequence[str]) -> str:
    return ("GROUP BY " + ", ".join(by)) if by else ""


def _sel(by: Sequence[str]) -> str:
    return "".join(f"{b}, " for b in by)


def ranked_sql(src: str, by: Sequence[str], score: str = "prob", label: str = "label",
               weight: str | None = None) -> str:
    """Score-count table with pos/neg prefix sums (plain windows; the oracle need not scale)."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    if weight:
        pos = f"sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0e0 END)"
        neg = f"sum(CASE WHEN {label} = 1 THEN 0e0 ELSE {weight} END)"
    else:
        pos = f"CAST(count_if({label} = 1) AS BIGINT)"
        neg = f"CAST(count_if({label} <> 1) AS BIGINT)"
    return f"""SELECT {_sel(by)}{score}, pos, neg,
  coalesce(sum(pos) OVER ({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
  coalesce(sum(neg) OVER ({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  sum(pos) OVER ({part}) AS pos_total, sum(neg) OVER ({part}) AS neg_total
FROM (SELECT {_sel(by)}{score}, {pos} AS pos, {neg} AS neg FROM {src} WHERE {score} IS NOT NULL
      {_gb(list(by) + [score])})"""


def auc_sql(ranked: str, by: Sequence[str], weighted: bool = False) -> str:
    if weighted:
        num = "sum(pos * (2e0 * neg_below + neg))"
    else:
        num = "CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_below + neg)) AS DOUBLE)"
    return f"""SELECT {_sel(by)}
  {num} / nullif(2e0 * max(pos_total) * max(neg_total), 0) AS auc_roc,
  sum(CAST(pos AS DOUBLE) * (CAST(pos_total - pos_below AS DOUBLE)
      / nullif(CAST(pos_total - pos_below + neg_total - neg_below AS DOUBLE), 0)))
    / nullif(CAST(max(pos_total) AS DOUBLE), 0) AS auc_pr,
  max(pos_total) AS n_pos, max(neg_total) AS n_neg
FROM ({ranked}) {_gb(by)}"""


def _wsum(cond: str, weight: str | None) -> str:
    if weight:
        return f"sum(CASE WHEN {cond} THEN {weight} ELSE 0e0 END)"
    return f"CAST(count_if({cond}) AS BIGINT)"


def ece_parts(prob: str = "prob", label: str = "label", bins: int = 10) -> tuple[list[str], str, str]:
    """(aggregate list, standard ECE expression, compat ECE expression)."""
    e = lin_edges(0.0, 1.0, bins + 1)
    aggs = []
    for b in range(bins):
        inb = f"{prob} > {dlit(e[b])} AND {prob} <= {dlit(e[b + 1])}"
        aggs.append(f"sum(CASE WHEN {inb} THEN {prob} - {label} ELSE 0e0 END) AS _s{b}")
        cnt = f"({inb}) OR {prob} = 0" if b == 0 else inb
        aggs.append(f"count_if({cnt}) AS _c{b}")
    aggs.append(f"sum(CASE WHEN {prob} = 0 THEN {prob} - {label} ELSE 0e0 END) AS _z")
    aggs.append("count(*) AS _n")
    std = "(abs(_s0 + _z)" + "".join(f" + abs(_s{b})" for b in range(1, bins)) + ") / nullif(CAST(_n AS DOUBLE), 0)"
    k = "(" + " + ".join(f"(CASE WHEN _c{b} > 0 THEN 1 ELSE 0 END)" for b in range(bins)) + ")"
    compat = "(" + " + ".join(f"(CASE WHEN {b} < {k} THEN abs(_s{b}) ELSE 0e0 END)" for b in range(bins)) \
        + ") / nullif(CAST(_n AS DOUBLE), 0)"
    return aggs, std, compat


def profit_parts(prob: str = "prob", label: str = "label",
                 thresholds: Sequence[float] = PROFIT_THRESHOLDS) -> tuple[list[str], list[str]]:
    aggs, profits = [], []
    for i, t in enumerate(thresholds):
        aggs.append(f"count_if({prob} <= {dlit(t)} AND {label} <> 1) AS _tn{i}")
        aggs.append(f"count_if({prob} <= {dlit(t)} AND {label} = 1) AS _fn{i}")
        profits.append(f"(CAST(_tn{i} AS DOUBLE) * {dlit(PROFIT_MARGIN)} - CAST(_fn{i} AS DOUBLE) * 1e0)")
    return aggs, profits


def best_parts(profits: list[str], thresholds: Sequence[float] = PROFIT_THRESHOLDS) -> dict[str, str]:
    best = "greatest(" + ", ".join(profits) + ")"
    bt = "CASE " + " ".join(f"WHEN {p} = {best} THEN {dlit(t)}" for p, t in zip(profits, thresholds)) + " END"
    return {"optimal_threshold": bt, "max_profit": best, "profit_at_05_threshold": profits[4],
            "approval_rate_optimal": f"(1e0 - {bt})"}


def all_metrics_sql(src: str, by: Sequence[str], label: str = "label", prob: str = "prob",
                    weight: str | None = None, threshold: float = 0.5, ece_mode: str = "standard", rounded: bool = True) -> str:
    """SQL twin of `operators.metrics.all_metrics`, doubles rounded to 6 digits (or as they are)."""
    r6 = _r6 if rounded else lambda expr, alias: f"CAST({expr} AS DOUBLE) AS {alias}"
    t = dlit(threshold)
    pred, y1 = f"{prob} > {t}", f"{label} = 1"
    ece_aggs, ece_std, ece_compat = ece_parts(prob, label)
    p_aggs, profits = profit_parts(prob, label)
    if weight:
        brier = f"sum({weight} * ({prob} - {label}) * ({prob} - {label})) / nullif(sum({weight}), 0)"
    else:
        brier = f"avg(({prob} - {label}) * ({prob} - {label}))"
    pc = f"least(greatest({prob}, {LOG_LOSS_EPS!r}), {1.0 - LOG_LOSS_EPS!r})"
    term = f"-({label} * ln({pc}) + (1 - {label}) * ln(1 - {pc}))"
    ll = f"sum({weight} * {term}) / nullif(sum({weight}), 0)" if weight else f"avg({term})"
    a = f"""SELECT {_sel(by)}count(*) AS n, count_if({y1}) AS n_pos_rows, avg(CAST({label} AS DOUBLE)) AS default_rate,
  {_wsum(f'{pred} AND {y1}', weight)} AS tp, {_wsum(f'{pred} AND NOT ({y1})', weight)} AS fp,
  {_wsum(f'NOT ({pred}) AND NOT ({y1})', weight)} AS tn, {_wsum(f'NOT ({pred}) AND {y1}', weight)} AS fn,
  {brier} AS brier_score, {ll} AS log_loss,
  {', '.join(ece_aggs)}, {', '.join(p_aggs)}
FROM {src} {_gb(by)}"""
    prec = div0("tp", "tp + fp")
    rec = div0("tp", "tp + fn")
    bp = best_parts(profits)
    cols = {
        "n": "n", "default_rate": "default_rate", "brier_score": "brier_score", "log_loss": "log_loss",
        "precision": prec, "recall": rec,
        "f1_score": f"CASE WHEN {prec} + {rec} > 0 THEN 2e0 * {prec} * {rec} / ({prec} + {rec}) ELSE 0e0 END",
        "accuracy": div0("tp + tn", "tp + fp + tn + fn"),
        "specificity": div0("tn", "tn + fp"), "sensitivity": div0("tp", "tp + fn"),
        "false_positive_rate": div0("fp", "fp + tn"),
        "calibration_error": ece_std if ece_mode == "standard" else ece_compat,
        **bp,
        "default_rate_if_all_approved": "default_rate",
        "degenerate": "(n_pos_rows = 0 OR n_pos_rows = n)",
    }
    r = auc_sql(ranked_sql(src, by, prob, label, weight), by, weighted=bool(weight))
    sel = []
    for k, v in cols.items():
        if k in ("n", "degenerate"):
            sel.append(f"{v} AS {k}")
        else:
            sel.append(r6(v, k))
    sel.append(r6("CASE WHEN (n_pos_rows = 0 OR n_pos_rows = n) THEN 0.5e0 ELSE auc_roc END", "auc_roc"))
    sel.append(r6("auc_pr", "auc_pr"))
    join = f"JOIN ({r}) r USING ({', '.join(by)})" if by else f"CROSS JOIN ({r}) r"
    return f"SELECT {_sel(by)}{', '.join(sel)} FROM ({a}) a {join}"


def long_sql(src: str, features: Sequence[str], flag: str = "is_cur") -> str:
    """(feature, value, is_cur) unpivot of `src` with every feature cast to double."""
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)
    return (f"SELECT feature, value, {flag} AS is_cur FROM "
            f"(UNPIVOT (SELECT {flag}, {casts} FROM {src}) ON {', '.join(features)} INTO NAME feature VALUE value) "
            f"WHERE value IS NOT NULL AND NOT isnan(value)")


def ks_p_sql(d: str, n: str, m: str) -> str:
    en = f"round(CAST({n} AS DOUBLE) * {m} / ({n} + {m}))"
    lam = f"((sqrt({en}) + 0.12e0 + 0.11e0 / sqrt({en})) * {d})"
    series = (f"list_reduce(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END)"
              f" * exp(-2e0 * CAST(k * k AS DOUBLE) * {lam} * {lam})), lambda x, y: x + y, 0e0)")
    return (f"CASE WHEN {n} <= 0 OR {m} <= 0 THEN NULL WHEN {lam} < 0.2e0 THEN 1e0 "
            f"ELSE least(greatest(2e0 * {series}, 0e0), 1e0) END")


def ks_sql(long: str, alpha: float = 0.05, rounded: bool = True) -> str:
    r6 = _r6 if rounded else lambda expr, alias: f"CAST({expr} AS DOUBLE) AS {alias}"
    return f"""SELECT feature, {r6('d', 'statistic')}, {r6(ks_p_sql('d', 'n_ref', 'n_cur'), 'p_value')},
  {ks_p_sql('d', 'n_ref', 'n_cur')} < {dlit(alpha)} AS is_drift, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur
FROM (SELECT feature, max(abs(cdf_ref - cdf_cur)) AS d, max(n_ref) AS n_ref, max(n_cur) AS n_cur FROM (
  SELECT feature,
    CAST(sum(c_ref) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
      / CAST(sum(c_ref) OVER (PARTITION BY feature) AS DOUBLE) AS cdf_ref,
    CAST(sum(c_cur) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
      / CAST(sum(c_cur) OVER (PARTITION BY feature) AS DOUBLE) AS cdf_cur,
    sum(c_ref) OVER (PARTITION BY feature) AS n_ref, sum(c_cur) OVER (PARTITION BY feature) AS n_cur
  FROM (SELECT feature, value, count_if(NOT is_cur) AS c_ref, count_if(is_cur) AS c_cur FROM ({long}) GROUP BY feature, value))
  GROUP BY feature)"""


def chi2_sf_sql(stat: str, dof: str) -> str:
    x = f"(CAST({stat} AS DOUBLE) / 2e0)"
    a = f"(CAST({dof} AS DOUBLE) / 2e0)"
    series = (f"list_reduce(list_transform(range(0, 2000), lambda n: exp({a} * ln({x}) - {x} - lgamma({a} + n + 1e0)"
              f" + n * ln({x}))), lambda p, q: p + q, 0e0)")
    return (f"CASE WHEN {dof} <= 0 THEN NULL WHEN {x} <= 0 THEN 1e0 "
            f"WHEN {x} - {a} > 50e0 * sqrt({a}) + 50e0 THEN 0e0 "
            f"ELSE least(greatest(1e0 - {series}, 0e0), 1e0) END")
