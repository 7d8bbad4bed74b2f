"""Ensemble scoring, weighting and calibration monitoring (#82, #83, #87, #89, #114-128).

Every operator takes `by` keys (portfolio, region, run) so many ensembles are
updated in one job. Per-model state is small (models x keys rows); the
row-level work (rolling Brier over scored rows) streams sorted ranges that
exchange halos, never one window over a whole model.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.operators.rolling import rolling_means
from scorewatch.session import cut_lineage

# fixed values (must equal the original's)
SCORE_AUC_WEIGHT = 0.6
SCORE_BRIER_WEIGHT = 0.4
EPS = 1e-8
ALPHA = 0.1
MIN_WEIGHT = 0.05
RECALIBRATION_THRESHOLD = 0.15
WINDOW = 1000
MIN_BUFFER = 100
TREND_WINDOW = 10


def equal_weights(models: DataFrame, by: Sequence[str] = (), model: str = "model_id") -> DataFrame:
    """#115: 1 / number of models per key."""
    w = Window.partitionBy(*by)
    return models.select(*by, model).distinct().withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(w))


def ensemble_score(long_scores: DataFrame, weights: DataFrame, key: Sequence[str], by: Sequence[str] = (),
                   model: str = "model_id", prob: str = "prob") -> DataFrame:
    """#52/#114: sum_i w_i p_i per row key: join on (by, model) with the weight table, then one
    grouped sum (partial aggregation map-side). Whether the weights are broadcast is decided
    from their size at run time."""
    j = long_scores.join(weights, [*by, model])
    return j.groupBy(*by, *key).agg(F.sum(F.col("weight") * F.col(prob)).alias("prob"))


def stability(auc: str = "auc_roc", brier: str = "brier_score"):
    """0.6 * auc + 0.4 / (brier + 1e-8); the AUC of a batch with one class is 0.5. NULL without a Brier score."""
    return (F.lit(SCORE_AUC_WEIGHT) * F.coalesce(F.nanvl(F.col(auc).cast("double"), F.lit(None).cast("double")), F.lit(0.5))
            + F.lit(SCORE_BRIER_WEIGHT) / (F.col(brier) + F.lit(EPS)))


def check_weight_params(alpha: float, min_weight: float) -> None:
    if not 0 <= alpha <= 1:
        raise ValueError("stability_alpha must be in [0, 1]")
    if not 0 <= min_weight < 1:
        raise ValueError("min_weight must be in [0, 1)")


def update_weights(model_metrics: DataFrame, weights: DataFrame, by: Sequence[str] = (),
                   model: str = "model_id", alpha: float = ALPHA, min_weight: float = MIN_WEIGHT,
                   auc: str = "auc_roc", brier: str = "brier_score") -> DataFrame:
    """#89/#116: s = `stability`; w <- (1-a) w + a softmax(s); floor at min_weight; renormalise.
    Softmax subtracts the max first. A model without metrics keeps its weight until the floor
    and the normalisation."""
    check_weight_params(alpha, min_weight)
    w = Window.partitionBy(*by)
    x = weights.join(model_metrics, [*by, model], "left").withColumn("_s", stability(auc, brier))
    x = x.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    x = x.withColumn("_soft", F.col("_e") / F.sum("_e").over(w))
    new = F.coalesce(F.lit(1.0 - alpha) * F.col("weight") + F.lit(alpha) * F.col("_soft"), F.col("weight"))
    x = x.withColumn("_w", F.greatest(new, F.lit(min_weight)))
    return x.select(*by, model, (F.col("_w") / F.sum("_w").over(w)).alias("weight"))


def monitor_metrics(scored: DataFrame, by: Sequence[str], batch: str, order: Sequence[str], model: str = "model_id",
                    n: int = WINDOW, min_n: int = MIN_BUFFER, label: str = "label", prob: str = "prob") -> DataFrame:
    """#116/#123: what an update of each batch reads: (by..., model, batch, brier_score, auc_roc),
    the model's rolling Brier score over its last n pairs at the end of the batch, and the
    batch's AUC (0.5 with one class). `order` begins with `batch`."""
    return monitor_windows(scored, by, batch, order, [n], model, min_n, label, prob).drop("window")


def monitor_windows(scored: DataFrame, by: Sequence[str], batch: str, order: Sequence[str], windows: Sequence[int], model: str = "model_id",
                    min_n: int = MIN_BUFFER, label: str = "label", prob: str = "prob") -> DataFrame:
    """`monitor_metrics` for several windows from one pass over the rows, with the column `window`."""
    from scorewatch.operators.rankstats import auc_roc

    keys, windows = [*by, model], sorted({int(n) for n in windows})
    names = list(dict.fromkeys([*keys, batch, *order]))
    rolling = rolling_means(squared_errors(scored, names, label, prob), keys, list(dict.fromkeys([batch, *order])), "_sq", windows)
    last = batch_ends(rolling, [*keys, batch], order).groupBy(*keys, batch).agg(
        F.max_by(F.struct(*[_reported(n, min_n).alias(f"b{n}") for n in windows]), F.struct(*order)).alias("r"))
    parts = ", ".join(f"{n}, r.b{n}" for n in windows)
    last = last.selectExpr(*[f"`{c}`" for c in [*keys, batch]], f"stack({len(windows)}, {parts}) AS (window, brier_score)")
    auc = auc_roc(scored, [*keys, batch], label, prob).select(*keys, batch, F.coalesce("auc_roc", F.lit(0.5)).alias("auc_roc"))
    return last.join(auc, [*keys, batch]).select(*keys, batch, "window", "brier_score", "auc_roc")


def batch_ends(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last rows by `order` of every group of `keys` (several where they tie). The ends are a hashed maximum, one
    row a group (models times batches), broadcast to the rows: these are neither sorted nor shuffled."""
    for c in [c for c in order if c not in set(keys)]:
        ends = rows.groupBy(*keys).agg(F.max(c).alias("_end")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_end")
        same = F.col(c).eqNullSafe(F.col("_end"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(F.broadcast(ends), same, "left_semi")
    return rows


def weight_stats(weights: DataFrame, model_metrics: DataFrame, by: Sequence[str] = (), model: str = "model_id",
                 auc: str = "auc_roc", brier: str = "brier_score",
                 threshold: float = RECALIBRATION_THRESHOLD) -> DataFrame:
    """#117/#118: max Brier, mean AUC, entropy, dominant model (first on ties),
    recalibration flag, effective number of models and diversity level."""
    j = weights.join(model_metrics, [*by, model])
    ent = -F.sum(F.col("weight") * F.ln(F.col("weight") + F.lit(EPS)))
    a = j.groupBy(*by).agg(
        F.max(brier).alias("max_brier_score"), F.avg(auc).alias("mean_auc"), ent.alias("weight_entropy"),
        F.min_by(model, F.struct(-F.col("weight"), F.col(model))).alias("dominant_model"),
        F.max("weight").alias("max_weight"))
    return a.select(
        *by, "max_brier_score", "mean_auc", "weight_entropy", "dominant_model", "max_weight",
        (F.col("max_brier_score") > F.lit(threshold)).alias("needs_recalibration"),
        F.exp("weight_entropy").alias("effective_models"),
        F.when(F.col("weight_entropy") > 1.0, F.lit("High")).when(F.col("weight_entropy") > 0.5, F.lit("Medium"))
        .otherwise(F.lit("Low")).alias("diversity_level"))


def rolling_brier(scored: DataFrame, by: Sequence[str], order: Sequence[str], n: int = WINDOW,
                  min_n: int = MIN_BUFFER, label: str = "label", prob: str = "prob") -> DataFrame:
    """#82: Brier score over the last n (prob, label) pairs at every row; 0.0 until min_n pairs.
    Output: by..., order..., n_window, rolling_brier."""
    if n <= 0:
        raise ValueError("calibration_window must be positive")
    names = list(dict.fromkeys([*by, *order]))
    r = rolling_means(squared_errors(scored, names, label, prob), by, order, "_sq", [n])
    return r.select(*names, F.col(f"n_{n}").alias("n_window"), _reported(n, min_n).alias("rolling_brier"))


def squared_errors(scored: DataFrame, keep: Sequence[str], label: str, prob: str) -> DataFrame:
    y = F.col(label).cast("double")
    return scored.select(*keep, ((F.col(prob) - y) * (F.col(prob) - y)).alias("_sq"))


def _reported(n: int, min_n: int):
    return F.when(F.col(f"n_{n}") >= F.lit(min_n), F.col(f"mean_{n}")).otherwise(F.lit(0.0))


def batch_reports(rolling: DataFrame, by: Sequence[str], batch: str, order: Sequence[str]) -> DataFrame:
    """One report per batch = the rolling value at the last row of the batch."""
    return rolling.groupBy(*by, batch).agg(
        F.max_by(F.struct("n_window", "rolling_brier"), F.struct(*order)).alias("r")).select(
        *by, batch, "r.n_window", "r.rolling_brier")


def calibration_trend(history: DataFrame, by: Sequence[str], order: str, value: str = "brier",
                      n: int = TREND_WINDOW) -> DataFrame:
    """#83: -slope of the last n history values over their index; 0 with fewer than n.
    History tables hold one row per batch, so a window per key is small."""
    w = Window.partitionBy(*by).orderBy(order)
    h = history.withColumn("_i", F.row_number().over(w).cast("double"))
    wf = w.rowsBetween(-(n - 1), 0)
    return h.select(*by, order, value,
                    F.when(F.count(F.lit(1)).over(wf) >= n, -F.regr_slope(F.col(value), F.col("_i")).over(wf))
                    .otherwise(F.lit(0.0)).alias("calibration_trend"))


def early_stop(history: DataFrame, by: Sequence[str], order: str, metric: str, patience: int = 5,
               min_delta: float = 0.001, mode: str = "max") -> DataFrame:
    """#120: scan each key's metric sequence in order: improved = score > best + delta
    (max) or < best - delta (min); stop when misses reach patience.
    Output: by..., stop_at (1-based step or NULL), best_score, steps."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    seq = history.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(metric).cast("double").alias("v")))).alias("s"))
    init = F.struct(F.lit(float("-inf") if mode == "max" else float("inf")).alias("best"), F.lit(0).alias("cnt"),
                    F.lit(None).cast("int").alias("stop"), F.lit(0).alias("i"))

    def step(acc, x):
        improved = (x["v"] > acc["best"] + F.lit(min_delta)) if mode == "max" else (x["v"] < acc["best"] - F.lit(min_delta))
        cnt = F.when(improved, F.lit(0)).otherwise(acc["cnt"] + 1)
        i = acc["i"] + 1
        stop = F.when(acc["stop"].isNotNull(), acc["stop"]).when(cnt >= F.lit(patience), i)
        return F.struct(F.when(improved, x["v"]).otherwise(acc["best"]).alias("best"), cnt.alias("cnt"),
                        stop.alias("stop"), i.alias("i"))
    r = seq.select(*by, F.aggregate("s", init, step).alias("r"), F.size("s").alias("steps"))
    return r.select(*by, F.col("r.stop").alias("stop_at"), F.col("r.best").alias("best_score"), "steps")


def weight_trajectory(batch_metrics: DataFrame, by: Sequence[str], batch: str, model: str = "model_id",
                      alpha: float | str = ALPHA, min_weight: float | str = MIN_WEIGHT,
                      auc: str = "auc_roc", brier: str = "brier_score") -> DataFrame:
    """#119: weights after every batch, from equal weights: (by..., batch, model, weight).

    One ordered fold per key over its batches, each batch one array of (model, stability)
    structs; a key's history is batches x models small rows. `alpha` and `min_weight` may name
    columns that are constant within a key (parameter search)."""
    by = list(by)
    for v, check in ((alpha, lambda x: check_weight_params(x, 0)), (min_weight, lambda x: check_weight_params(0, x))):
        if not isinstance(v, str):
            check(v)
    a, floor = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (alpha, min_weight))
    per = (batch_metrics.select(*by, batch, F.col(model).alias("_m"), stability(auc, brier).alias("_s"), a.alias("_a"), floor.alias("_f"))
           .groupBy(*by, batch).agg(F.sort_array(F.collect_list(F.struct("_m", "_s"))).alias("_scores"), F.max("_a").alias("_a"), F.max("_f").alias("_f")))
    seq = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(batch).alias("_b"), "_scores"))).alias("_seq"),
                               F.max("_a").alias("_a"), F.max("_f").alias("_f"))
    seq = seq.withColumn("_models", F.array_sort(F.array_distinct(F.flatten(F.transform("_seq", lambda x: F.transform(x["_scores"], lambda y: y["_m"]))))))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))

    def step(acc, x):
        s = F.transform("_models", lambda m: F.get(F.filter(x["_scores"], lambda y: y["_m"] == m), F.lit(0))["_s"])
        top = F.array_max(F.filter(s, lambda v: v.isNotNull()))
        e = F.transform(s, lambda v: F.exp(v - top))
        new = F.zip_with(acc["w"], e, lambda w, v: F.greatest(
            F.coalesce((F.lit(1.0) - F.col("_a")) * w + F.col("_a") * v / add(e), w), F.col("_f")))
        w = F.transform(new, lambda v: v / add(new))
        return F.struct(w.alias("w"), F.concat(acc["out"], F.array(F.struct(x["_b"].alias("b"), w.alias("w")))).alias("out"))

    kind = dict(seq.selectExpr("_seq[0]._b AS b").dtypes)["b"]
    init = F.struct(F.transform("_models", lambda _: F.lit(1.0) / F.size("_models")).alias("w"),
                    F.array().cast(f"array<struct<b:{kind},w:array<double>>>").alias("out"))
    out = seq.select(*by, "_models", F.explode(F.aggregate("_seq", init, step, lambda acc: acc["out"])).alias("_o"))
    out = out.select(*by, F.col("_o.b").alias(batch), F.explode(F.arrays_zip("_models", F.col("_o.w").alias("weight"))).alias("_x"))
    return out.select(*by, batch, F.col("_x._models").alias(model), F.col("_x.weight").alias("weight"))


def repeated_monitors(scored: DataFrame, order: Sequence[str], updates: int, model: str = "model_id", n: int = WINDOW,
                      min_n: int = MIN_BUFFER, label: str = "label", prob: str = "prob") -> DataFrame:
    """(update, model, brier_score, auc_roc) for `updates` updates that each pass the same rows through the
    monitors again: after t of them a monitor holds the last min(n, t * rows) pairs of the repeated
    rows, some whole rounds and the last rows of one."""
    from scorewatch.operators.rankstats import auc_roc

    base = cut_lineage(squared_errors(scored, list(dict.fromkeys([model, *order])), label, prob).where("_sq IS NOT NULL"), "update-errors")
    whole = base.groupBy(model).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_sq").alias("_all"))
    place = F.row_number().over(Window.partitionBy(model).orderBy(*[F.col(c).desc() for c in order]))
    last = base.withColumn("_place", place).where(F.col("_place") <= n).join(whole, model)
    last = last.where(F.col("_place") <= F.lit(n) % F.col("_rows")).groupBy(model).agg(F.sum("_sq").alias("_last"))
    each = whole.join(last, model, "left").join(auc_roc(scored, [model], label, prob).select(model, F.coalesce("auc_roc", F.lit(0.5)).alias("auc_roc")), model)
    each = each.withColumn("update", F.explode(F.sequence(F.lit(1), F.lit(updates))))
    held = F.least(F.lit(n).cast("long"), F.col("update") * F.col("_rows"))
    total = F.floor(held / F.col("_rows")) * F.col("_all") + F.when(held % F.col("_rows") > 0, F.coalesce("_last", F.lit(0.0))).otherwise(0.0)
    return each.select("update", model, F.when(held >= min_n, total / held).otherwise(F.lit(0.0)).alias("brier_score"), "auc_roc")


def early_stopped_updates(scored: DataFrame, order: Sequence[str], key: str, max_updates: int = 20, patience: int = 5, min_delta: float = 0.001,
                          model: str = "model_id", alpha: float = ALPHA, min_weight: float = MIN_WEIGHT, n: int = WINDOW) -> DataFrame:
    """#119/#120: weights are updated on validation scores again and again, from equal weights, until the
    ensemble's AUC has not improved by more than `min_delta` for `patience` evaluations.
    (update, model, weight, auc_roc, stopped) for every evaluated update, update 0 being equal weights.

    The weights of all updates are one fold over a small table; the ensembles of `patience` updates at a
    time are scored in one job, and no later ones once the AUC has stopped rising."""
    from scorewatch.operators.rankstats import auc_roc

    metrics = repeated_monitors(scored, order, max_updates - 1, model, n) if max_updates > 1 else None
    start = equal_weights(scored, [], model).select(F.lit(0).alias("update"), model, "weight")
    path = start if metrics is None else start.unionByName(weight_trajectory(metrics, [], "update", model, alpha, min_weight))
    path = cut_lineage(path, "update-weights")
    aucs: list[float] = []
    best, misses = float("-inf"), 0
    while len(aucs) < max_updates and misses < patience:
        some = path.where(F.col("update").between(len(aucs), min(max_updates, len(aucs) + patience) - 1))
        ens = scored.join(some, model).groupBy("update", key, "label").agg(F.least(F.sum(F.col("weight") * F.col("prob")), F.lit(1.0)).alias("prob"))
        for r in sorted(auc_roc(ens, ["update"]).collect(), key=lambda r: r["update"]):  # `patience` rows
            if misses < patience:
                a = 0.5 if r["auc_roc"] is None else r["auc_roc"]
                aucs.append(a)
                best, misses = (a, 0) if a > best + min_delta else (best, misses + 1)
    table = scored.sparkSession.createDataFrame([(i, a, i == len(aucs) - 1 and misses >= patience) for i, a in enumerate(aucs)], "update int, auc_roc double, stopped boolean")
    return path.join(table, "update").select("update", model, "weight", "auc_roc", "stopped")


def weighted_importance(importances: DataFrame, weights: DataFrame, by: Sequence[str] = (),
                        model: str = "model_id", feature: str = "feature", imp: str = "importance") -> DataFrame:
    """#128: sum_models w * importance per feature, normalised to sum to 1 per key."""
    j = importances.join(weights, [*by, model])
    s = j.groupBy(*by, feature).agg(F.sum(F.col("weight") * F.col(imp)).alias("_s"))
    w = Window.partitionBy(*by)  # one row per feature
    return s.select(*by, feature, F.try_divide(F.col("_s"), F.sum("_s").over(w)).alias("importance"))


# fixed values (must equal the original's search ranges): alpha, floor, recalibration threshold, windows
SEARCH_ALPHA, SEARCH_FLOOR, SEARCH_THRESHOLD = (0.01, 0.3), (0.01, 0.2), (0.1, 0.25)
SEARCH_WINDOWS = range(500, 2001, 250)
SEARCH_TRIALS = 30
#: Ensemble scores that one task makes and counts, candidates times rows.
ENSEMBLES_PER_TASK = 2_000_000


def radical_inverse(i: int, base: int) -> float:
    """Digits of i mirrored at the point: evenly spread over [0, 1) for i = 1, 2, ..."""
    out, step = 0.0, 1.0 / base
    while i:
        i, digit = divmod(i, base)
        out, step = out + digit * step, step / base
    return out


def search_points(trials: int = SEARCH_TRIALS, seed: int = 42) -> list[tuple[float, float, int, float]]:
    """#133: (alpha, min_weight, window, recalibration_threshold) candidates: a Halton sequence over the
    whole ranges, turned by a seeded offset in each dimension."""
    turn = [random.Random(seed * 31 + d).random() for d in range(4)]
    out = []
    for i in range(1, trials + 1):
        u = [(radical_inverse(i, base) + t) % 1.0 for base, t in zip((2, 3, 5, 7), turn, strict=True)]
        (a, f, t), windows = (lo + x * (hi - lo) for x, (lo, hi) in zip((u[0], u[1], u[3]), (SEARCH_ALPHA, SEARCH_FLOOR, SEARCH_THRESHOLD), strict=True)), SEARCH_WINDOWS
        out.append((round(a, 6), round(f, 6), windows[int(u[2] * len(windows))], round(t, 6)))
    return out


def search_weights(scored: DataFrame, scored_eval: DataFrame, grid: Sequence[tuple[float, float, int, float]],
                   batch: str, order: Sequence[str], model: str = "model_id", key: str = "loan_id",
                   min_n: int = MIN_BUFFER) -> DataFrame:
    """#133: evaluate (alpha, min_weight, window, recalibration_threshold) candidates: replay the
    weights over the batches of `scored` with the monitors' rolling window, then score the final
    ensemble on `scored_eval`. Output: the candidate, how many batches called for recalibration,
    and the AUC.

    Candidates are attached by `explode` of a literal array; one fold per candidate. Held-out scores
    become one row a key, written once; each candidate's ensemble is a sum over that row, and rows are
    dealt out so that a task makes about `ENSEMBLES_PER_TASK` of them."""
    from scorewatch.operators.rankstats import auc_terms, prefix_sums, score_counts

    batches = cut_lineage(monitor_windows(scored, [], batch, order, [g[2] for g in grid], model, min_n), "monitor-windows")
    cands = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(float(a)).alias("alpha"), F.lit(float(f)).alias("min_weight"),
                               F.lit(int(n)).alias("w"), F.lit(float(t)).alias("threshold")) for i, (a, f, n, t) in enumerate(grid)])
    each = batches.withColumn("_g", F.explode(cands)).where(F.col("_g.w") == F.col("window")).select("*", "_g.cand", "_g.alpha", "_g.min_weight", "_g.threshold").drop("_g")
    keys = ["cand", "alpha", "min_weight", "window", "threshold"]
    path = weight_trajectory(each, keys, batch, model, "alpha", "min_weight")
    final = path.groupBy(*keys, model).agg(F.max_by("weight", F.col(batch)).alias("weight"))
    calls = (each.groupBy(*keys, batch).agg(F.max("brier_score").alias("_worst")).groupBy(*keys)
             .agg(F.count_if(F.col("_worst") > F.col("threshold")).alias("recalibrations")))
    found = {(r["cand"], r[model]): float(r["weight"]) for r in final.select("cand", model, "weight").collect()}  # candidates x models
    names = sorted({m for _, m in found}, key=str)
    if not names:
        return final.select(*keys, F.lit(None).cast("double").alias("auc_roc")).join(calls, keys)
    # One row per key first: its candidates' ensembles are then sums over the columns, and no rows times candidates are shuffled by key.
    wide = scored_eval.where(F.col(model).isin(*names)).groupBy(key, "label").agg(*[F.sum(F.when(F.col(model) == F.lit(m), F.col("prob"))).alias(f"_p{j}") for j, m in enumerate(names)])
    wide = cut_lineage(wide, "eval-scores")
    tasks = max(scored.sparkSession.sparkContext.defaultParallelism, 1 + wide.count() * len(grid) // ENSEMBLES_PER_TASK)

    def ensemble(cand: int):
        terms = [F.lit(found[cand, m]) * F.coalesce(F.col(f"_p{j}"), F.lit(0.0)) for j, m in enumerate(names) if (cand, m) in found]
        scored_by = F.coalesce(*[F.col(f"_p{j}") for j, m in enumerate(names) if (cand, m) in found])
        # Weights add up to 1 but for rounding.
        return F.when(scored_by.isNotNull(), F.least(sum(terms[1:], terms[0]), F.lit(1.0)))

    each_cand = F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), ensemble(i).alias("prob")) for i in sorted({i for i, _ in found})]))
    ens = wide.repartition(tasks).select("label", each_cand.alias("_c")).select("_c.cand", "label", "_c.prob")
    counts = cut_lineage(score_counts(ens, ["cand"], "prob", "label"), "ensemble-counts")
    auc = auc_terms(prefix_sums(counts, ["cand"], "prob", ["pos", "neg"], None, "unit"), ["cand"])
    return auc.select("cand", "auc_roc").join(calls, "cand").select(*keys, "auc_roc", "recalibrations")
