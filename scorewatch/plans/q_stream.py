"""Registered streaming queries (#138-143): run with availableNow, read back the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.plans.catalog import register
from scorewatch.plans.sqlparts import auc_sql, ks_sql, r6, ranked_sql, with_views
from scorewatch.session import scratch_path
from scorewatch.sources import fixtures as FX
from scorewatch.streaming import monitor as SM

W = with_views("event_scores")
_Q = f"count(*) AS n, {r6('avg((prob - label) * (prob - label))', 'brier_score')}, {r6('avg(prob)', 'mean_prob')}, {r6('avg(label)', 'default_rate')}"


@register("stream_window_brier", W + f"""
SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day AS window_end,
  event_type, {_Q} FROM event_scores GROUP BY ALL""")
def stream_window_brier(spark, sf_dir):
    """#138: tumbling 1-day windows per event type with watermark (stream, availableNow)."""
    return SM.run_window_quality(SM.event_score_stream(spark, sf_dir), ["event_type"], "1 day")


@register("stream_sliding_brier", W + f"""
SELECT window_start, window_start + INTERVAL 7 day AS window_end, {_Q} FROM (
  SELECT *, time_bucket(INTERVAL 1 day, ts) - to_days(k) AS window_start FROM event_scores, range(0, 7) t(k))
GROUP BY ALL""")
def stream_sliding_brier(spark, sf_dir):
    """#139: 7-day windows sliding by 1 day (whole stream)."""
    return SM.run_window_quality(SM.event_score_stream(spark, sf_dir), [], "7 days", "1 day")


#: Where the events are cut into the micro-batches of the queries below.
CUTS = ("2024-01-11", "2024-01-21")
_UPTO = [f"ts < TIMESTAMP '{c}'" for c in CUTS] + ["true"]
_IN = [_UPTO[0], f"NOT ({_UPTO[0]}) AND {_UPTO[1]}", f"NOT ({_UPTO[1]})"]


def parts_of(df, ts="ts"):
    """`df` in three parts by time."""
    t = F.col(ts).cast("timestamp_ntz")
    a, b = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    return [df.where(t < a), df.where((t >= a) & (t < b)), df.where(t >= b)]


def _scores(spark, sf_dir):
    return FX.event_scores(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


_MONITOR_SQL = " UNION ALL ".join(f"""
SELECT CAST({k} AS BIGINT) AS batch_id, event_type, count(*) AS n_window,
  {r6('CASE WHEN count(*) >= 100 THEN avg((prob - label) * (prob - label)) ELSE 0e0 END', 'rolling_brier')}, max(total) AS rows_seen
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY event_type) AS total FROM event_scores WHERE {c}) WHERE rn <= 1000 GROUP BY event_type"""
                                  for k, c in enumerate(_UPTO))


@register("stream_monitor", W + _MONITOR_SQL)
def stream_monitor(spark, sf_dir):
    """#140: keyed last-1000 calibration monitor (transformWithState) after each of three micro-batches."""
    out, got = scratch_path(spark, "last-n-monitor"), None
    for stream in SM.replay(parts_of(_scores(spark, sf_dir))):
        got = SM.run_last_n_monitor(stream, "event_type", 1000, 100, out)
    return got.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _drift_sql(k: int) -> str:
    long = ("SELECT 'prob' AS feature, prob AS value, false AS is_cur FROM event_scores WHERE ts < TIMESTAMP '2024-01-08' "
            f"UNION ALL SELECT 'prob', prob, true FROM event_scores WHERE {_IN[k]}")
    return f"SELECT CAST({k} AS BIGINT) AS batch_id, * FROM ({ks_sql(long)})"


@register("stream_drift", W + " UNION ALL ".join(_drift_sql(k) for k in range(3)))
def stream_drift(spark, sf_dir):
    """#141: KS drift of prob in three micro-batches against the first week, counted once and stored."""
    ref = SM.StoredReference(FX.event_scores(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")), ["prob"])
    out, got = scratch_path(spark, "stream-drift"), None
    for stream in SM.replay(parts_of(_scores(spark, sf_dir))):
        got = SM.run_stream_drift(stream, ref, out)
    return got.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _weights_sql() -> str:
    auc = auc_sql(ranked_sql("l{k}", ["model_id"]), ["model_id"])
    steps = ["l AS (SELECT ts, event_id, 'a' AS model_id, label, prob FROM event_scores UNION ALL SELECT ts, event_id, 'b', label, least(prob * 0.5e0 + 0.25e0, 1e0) FROM event_scores)",
             "w0 AS (SELECT DISTINCT model_id, 0.5e0 AS weight FROM l)"]
    for k in range(3):
        steps.append(f"""l{k} AS (SELECT * FROM l WHERE {_IN[k]}),
s{k} AS (SELECT a.model_id, 0.6e0 * coalesce(a.auc_roc, 0.5e0) + 0.4e0 / (b.rolling + 1e-8) AS s FROM ({auc.format(k=k)}) a JOIN (
  SELECT model_id, CASE WHEN count(*) >= 100 THEN avg((prob - label) * (prob - label)) ELSE 0e0 END AS rolling FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS rn FROM l WHERE {_UPTO[k]}) WHERE rn <= 1000 GROUP BY model_id) b USING (model_id)),
e{k} AS (SELECT model_id, exp(s - max(s) OVER ()) AS e FROM s{k}),
f{k} AS (SELECT model_id, greatest(0.9e0 * weight + 0.1e0 * (e / sum(e) OVER ()), 0.05e0) AS w FROM e{k} JOIN w{k} USING (model_id)),
w{k + 1} AS (SELECT model_id, w / sum(w) OVER () AS weight FROM f{k})""")
    return W.rstrip("\n") + ",\n" + ",\n".join(steps) + "\n" + " UNION ALL ".join(
        f"SELECT model_id, {r6('weight', 'weight')}, CAST({k} AS BIGINT) AS batch_id FROM w{k + 1}" for k in range(3))


@register("stream_weights", _weights_sql())
def stream_weights(spark, sf_dir):
    """#142: ensemble weights after each of three micro-batches, from the monitors' rolling Brier score and the
    batch's AUC (idempotent by batch id)."""
    sc = _scores(spark, sf_dir).select("ts", "event_id", "label", F.col("prob").alias("a"), F.least(F.col("prob") * F.lit(0.5) + F.lit(0.25), F.lit(1.0)).alias("b"))
    out, got = scratch_path(spark, "stream-weights"), None
    for stream in SM.replay(parts_of(sc)):
        got = SM.run_stream_weights(stream, ["a", "b"], out=out)
    return got.withColumn("batch_id", F.col("batch_id").cast("bigint"))


@register("stream_label_join", W.rstrip("\n") + f""",
p AS (SELECT *, CASE WHEN {_UPTO[0]} THEN 0 WHEN {_UPTO[1]} THEN 1 ELSE 2 END AS part, event_id % 10 AS kind, ts + INTERVAL 1 hour AS label_ts FROM event_scores),
m AS (SELECT k, date_trunc('milliseconds', least((SELECT max(ts) FROM p WHERE part <= k),
    (SELECT max(label_ts) FROM p WHERE kind >= 2 AND part <= k OR kind = 1 AND part < k))) - INTERVAL 1 hour AS mark FROM range(0, 3) t(k)),
q AS (SELECT p.*, kind = 1 AND part < 2 AND label_ts < m.mark AS late, kind >= 2 OR kind = 1 AND part < 2 AND label_ts >= m.mark AS labelled FROM p JOIN m ON m.k = p.part)
SELECT event_type, count_if(labelled) AS n_labelled, count_if(NOT labelled AND ts + INTERVAL 2 hour < (SELECT mark FROM m WHERE k = 2)) AS n_expired,
  count_if(late) AS n_late, {r6('avg(CASE WHEN labelled THEN (prob - label) * (prob - label) END)', 'brier_score')}
FROM q GROUP BY event_type""")
def stream_label_join(spark, sf_dir):
    """#143: predictions of three micro-batches joined with their labels: most come in time, every tenth never,
    and every tenth one micro-batch later, behind the watermark unless it is of the last hours."""
    sc = _scores(spark, sf_dir)
    kind, label_ts = F.col("event_id") % 10, (F.col("ts") + F.expr("INTERVAL 1 hour")).alias("label_ts")
    in_time = [p.select("event_id", label_ts, "label") for p in parts_of(sc.where(kind >= 2))]
    later = [p.select("event_id", label_ts, "label") for p in parts_of(sc.where(kind == 1))]
    labels = [in_time[0], in_time[1].unionByName(later[0]), in_time[2].unionByName(later[1])]
    out = scratch_path(spark, "label-join")
    for preds, labs in zip(SM.replay(parts_of(sc.select("event_id", "ts", "event_type", "prob"))), SM.replay(labels), strict=True):
        joined, late = SM.run_label_join(preds, labs, out)
    y = F.col("label").cast("double")
    j = joined.groupBy("event_type").agg(F.count_if("labelled").alias("n_labelled"), F.count_if(~F.col("labelled")).alias("n_expired"),
                                         F.avg(F.when(F.col("labelled"), (F.col("prob") - y) * (F.col("prob") - y))).alias("brier_score"))
    n = late.join(sc.select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_late"))
    return j.join(n, "event_type", "left").select("event_type", "n_labelled", "n_expired", F.coalesce("n_late", F.lit(0)).cast("bigint").alias("n_late"), "brier_score")
