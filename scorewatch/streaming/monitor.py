"""Structured Streaming monitors (#138-143).

Sources are file streams over parquet; results go to parquet under the shared
checkpoint folder (`spark.checkpoint.dir`), written per micro-batch into a
`batch_id=<n>` folder with overwrite, so a retried batch replaces its own
output (idempotent). `read_latest` folds the per-batch updates into the
current value per key. `replay` feeds tables to a stream part by part; the same query goes on
from its checkpoint with each, so state and stored results carry over micro-batches. Tests
run them with `trigger(availableNow=True)` and compare with the batch operators on the same rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.session import cut_lineage, scratch_path
from scorewatch.streaming.lastn import ROCKSDB, last_n_monitor

WATERMARK = "1 hour"
#: Quantiles of a reference sketch that drift is measured at.
POINTS = 200


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """readStream over a driver table (a directory of parquet files, or one file via a glob)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.isdir(path):
        return r.parquet(path)
    return r.parquet(os.path.join(sf_dir, f"{name[:-1]}[{name[-1]}].parquet"))


def event_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scored stream; event time cast to TIMESTAMP for watermarks."""
    from scorewatch.sources.fixtures import event_scores

    ev = stream_table(spark, sf_dir, "events")
    return event_scores(spark, sf_dir, ev).withColumn("ts", F.col("ts").cast("timestamp"))


def replay(parts: Sequence[DataFrame], name: str = "replay") -> Iterator[DataFrame]:
    """A stream over a folder that gets `parts` one after another: each turn writes the next part and
    gives the stream; a query that goes on from its checkpoint sees that part as new files."""
    folder = scratch_path(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(folder)
        yield part.sparkSession.readStream.schema(part.schema).parquet(folder)


def _write_batches(df: DataFrame, name: str, mode: str = "update", fn=None, out: str | None = None) -> str:
    """Run `df` on all that is new and write every micro-batch (or `fn` of it) into a folder of its own.
    `out`: where an earlier run of the same query has left its checkpoint and results."""
    out = out or scratch_path(df.sparkSession, name)

    def sink(batch: DataFrame, batch_id: int):
        res = fn(batch, batch_id) if fn else batch
        res.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{out}/data/batch_id={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/data"


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Latest value per key across per-batch update folders."""
    d = spark.read.parquet(path)
    vals = [c for c in d.columns if c not in set(keys) and c != "batch_id"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("batch_id")).alias("_v")).select(*keys, "_v.*")


def window_quality(stream: DataFrame, by: Sequence[str], window: str, slide: str | None = None,
                   ts: str = "ts", label: str = "label", prob: str = "prob",
                   watermark: str = WATERMARK) -> DataFrame:
    """#138/#139: count, Brier, mean p and default rate per event-time window (tumbling or sliding)."""
    y = F.col(label).cast("double")
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, watermark).groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier_score"),
        F.avg(prob).alias("mean_prob"), F.avg(y).alias("default_rate"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by,
                "n", "brier_score", "mean_prob", "default_rate"))


def run_window_quality(stream: DataFrame, by: Sequence[str], window: str, slide: str | None = None) -> DataFrame:
    """Run #138/#139 to completion (availableNow) and read the final window values."""
    agg = window_quality(stream, by, window, slide)
    path = _write_batches(agg, "window-quality", "update")
    return read_latest(stream.sparkSession, path, ["window_start", "window_end", *by])


def run_last_n_monitor(stream: DataFrame, key: str, n: int = 1000, min_n: int = 100, out: str | None = None) -> DataFrame:
    """#140: every micro-batch's monitor values so far, with `batch_id`. The state store is RocksDB's for this
    query alone."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        path = _write_batches(last_n_monitor(stream, key, n=n, min_n=min_n), "last-n-monitor", "update", out=out)
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(path)


class StoredReference:
    """#141: what drift checks read of a reference sample. The sample is counted once, into a table
    (feature, value, how many are at or below) in ranges whose bounds are kept as numbers, or into
    one quantile sketch a feature; later batches do not touch the sample."""

    def __init__(self, reference: DataFrame, features: Sequence[str], buckets: int = 32, sketch_k: int = 800):
        from scorewatch.operators.drift import unpivot
        from scorewatch.operators.rankstats import bucketed, prefix_sums

        self.features, self.k = list(features), sketch_k
        long = unpivot(reference.select(*features), features).where(F.col("value").isNotNull())
        counts = cut_lineage(bucketed(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")), ["feature"], "value", buckets, "quantile"), "reference-counts")
        ranked = prefix_sums(counts, ["feature"], "value", ["c"], buckets, "given")
        self.table = cut_lineage(ranked.select("feature", "value", F.col("_bucket").alias("part"), (F.col("c_below") + F.col("c")).alias("r_le"), F.col("c_total").alias("n_ref")), "reference-cdf")
        ends = self.table.groupBy("feature", "part").agg(F.max("value").alias("hi"), F.max("r_le").alias("r_le"), F.max("n_ref").alias("n")).orderBy("feature", "part").collect()
        self.ends = {f: [(r["hi"], r["r_le"]) for r in ends if r["feature"] == f] for f in self.features}  # at most `buckets` rows a feature
        self.n = {f: next((r["n"] for r in ends if r["feature"] == f), 0) for f in self.features}
        self.sketches = cut_lineage(long.groupBy("feature").agg(F.kll_sketch_agg_double("value", F.lit(sketch_k)).alias("ref")), "reference-sketch")

    def _of_feature(self, make):
        out = F.lit(None)
        for f in self.features:
            out = F.when(F.col("feature") == f, make(f)).otherwise(out)
        return out

    def ks(self, batch: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Exact KS of a batch against the reference: (feature, statistic, p_value, is_drift, n_ref, n_cur)."""
        from scorewatch.functions.columns import ks_pvalue
        from scorewatch.operators.drift import unpivot
        from scorewatch.operators.rankstats import prefix_sums

        cur = unpivot(batch.select(*self.features), self.features).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
        highs = self._of_feature(lambda f: F.array(*[F.lit(float(h)) for h, _ in self.ends[f][:-1]]).cast("array<double>"))
        cur = cur.withColumn("_bucket", F.size(F.filter(highs, lambda h: h < F.col("value"))).cast("int"))
        # Ranges are numbered by their rank among those that hold values.
        at = self._of_feature(lambda f: F.array(*[F.lit(float(h)) for h, _ in self.ends[f][:-1]]).cast("array<double>"))
        ref = self.table.select("feature", "value", F.size(F.filter(at, lambda h: h < F.col("value"))).cast("int").alias("_bucket"), F.lit(0).cast("bigint").alias("c"), "r_le")
        both = cut_lineage(cur.withColumn("r_le", F.lit(None).cast("bigint")).unionByName(ref)
                           .groupBy("feature", "_bucket", "value").agg(F.sum("c").alias("c"), F.max("r_le").alias("r_le")), "batch-union")
        g = prefix_sums(both, ["feature"], "value", ["c"], 2, "given")
        before = self._of_feature(lambda f: F.get(F.array(*[F.lit(int(r)) for r in [0, *(r for _, r in self.ends[f])]]).cast("array<bigint>"), F.col("_bucket")))
        w = Window.partitionBy("feature", "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        below = F.coalesce(F.last("r_le", ignorenulls=True).over(w), before).cast("double")
        n = self._of_feature(lambda f: F.lit(int(self.n[f])).cast("bigint"))
        gap = g.select("feature", F.abs(F.try_divide(below, n) - (F.col("c_below") + F.col("c")) / F.col("c_total")).alias("gap"), F.col("c_total").alias("n_cur"), n.alias("n_ref"))
        d = gap.groupBy("feature").agg(F.max("gap").alias("statistic"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
        p = ks_pvalue("statistic", "n_ref", "n_cur")
        return d.select("feature", "statistic", p.alias("p_value"), (p < F.lit(alpha)).alias("is_drift"), "n_ref", "n_cur")

    def sketch_of(self, batch: DataFrame) -> DataFrame:
        """(feature, cur): the batch's own quantile sketches; sketches of several batches merge."""
        from scorewatch.operators.drift import unpivot

        return unpivot(batch.select(*self.features), self.features).where(F.col("value").isNotNull()).groupBy("feature").agg(F.kll_sketch_agg_double("value", F.lit(self.k)).alias("cur"))

    def sketch_error(self) -> float:
        """Bound of the error of `sketched_ks` (99 % sure): the rank errors of two sketches at k, at two ends each, and
        the step of the points that they are compared at."""
        return 2 * 2.446 / self.k ** 0.9433 + 1 / POINTS

    def points(self) -> dict[str, list[float]]:
        """The reference's quantiles, each with its next smaller number: values at and below every jump."""
        shares = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
        rows = self.sketches.select("feature", F.kll_sketch_get_quantile_double("ref", shares).alias("q")).collect()
        return {r["feature"]: sorted({x for q in r["q"] for x in (q, math.nextafter(q, -math.inf))}) for r in rows}

    def sketched_ks(self, sketches: DataFrame) -> DataFrame:
        """(feature, statistic, error) of sketches (feature, cur) against the reference's, at POINTS quantiles of the
        reference: between two of them its CDF rises by one step at most."""
        at = {f: F.array(*[F.lit(x) for x in xs]) for f, xs in self.points().items()}
        j = sketches.join(self.sketches, "feature")
        gap = F.lit(None).cast("double")
        for f, xs in at.items():
            both = F.zip_with(F.kll_sketch_get_rank_double("ref", xs), F.kll_sketch_get_rank_double("cur", xs), lambda a, b: F.abs(a - b))
            gap = F.when(F.col("feature") == f, F.array_max(both)).otherwise(gap)
        return j.select("feature", gap.alias("statistic"), F.lit(self.sketch_error()).alias("error"))


def run_stream_drift(stream: DataFrame, reference: StoredReference, out: str | None = None) -> DataFrame:
    """#141: per micro-batch KS drift of the batch against a stored reference; rows appended per batch."""
    path = _write_batches(stream.select(*reference.features), "stream-drift", "append", lambda batch, _: reference.ks(batch), out)
    return stream.sparkSession.read.parquet(path)


def run_stream_sketches(stream: DataFrame, reference: StoredReference, out: str | None = None) -> DataFrame:
    """#141: (feature, statistic, error) of all batches so far together: one sketch a batch is kept, and merged."""
    path = _write_batches(stream.select(*reference.features), "stream-sketches", "append", lambda batch, _: reference.sketch_of(batch), out)
    return reference.sketched_ks(stream.sparkSession.read.parquet(path).groupBy("feature").agg(F.kll_merge_agg_double("cur").alias("cur")))


def run_stream_weights(stream: DataFrame, models: Sequence[str], order: Sequence[str] = ("ts", "event_id"), label: str = "label", alpha: float = 0.1,
                       min_weight: float = 0.05, n: int = 1000, min_n: int = 100, out: str | None = None) -> DataFrame:
    """#142: weights after every micro-batch, from the rolling Brier score of each model's monitor (its last n
    pairs by `order`, 0 below min_n) and the batch's AUC (0.5 with one class). A batch reads the weights
    and monitors of the batch before from that batch's folder alone and writes its own, so
    re-running it changes nothing; a model without scores in a batch keeps its weight."""
    from scorewatch.operators import ensemble as EN
    from scorewatch.operators.rankstats import auc_roc

    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-weights")
    parts = ", ".join(f"'{m}', `{m}`" for m in models)
    newest = Window.partitionBy("model_id").orderBy(*[F.col(c).desc() for c in order])

    def sink(batch: DataFrame, batch_id: int):
        long = batch.selectExpr(*[f"`{c}`" for c in order], f"`{label}` AS label", f"stack({len(models)}, {parts}) AS (model_id, prob)").where(F.col("prob").isNotNull())
        long = cut_lineage(long, "weights-batch")
        held = long
        if batch_id:
            prev = spark.read.parquet(f"{out}/data/batch_id={batch_id - 1}").select("model_id", "weight")
            held = held.unionByName(spark.read.parquet(f"{out}/monitors/batch_id={batch_id - 1}"))
        else:
            prev = EN.equal_weights(spark.createDataFrame([(m,) for m in models], "model_id string"), [], "model_id")
        held.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n").write.mode("overwrite").parquet(f"{out}/monitors/batch_id={batch_id}")
        sq = (F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))
        rolling = spark.read.parquet(f"{out}/monitors/batch_id={batch_id}").groupBy("model_id").agg(
            F.when(F.count(F.lit(1)) >= min_n, F.avg(sq)).otherwise(F.lit(0.0)).alias("brier_score"))
        mm = auc_roc(long, ["model_id"]).select("model_id", "auc_roc").join(rolling, "model_id")
        w = EN.update_weights(mm, prev, [], "model_id", alpha, min_weight)
        w.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def label_join(predictions: DataFrame, labels: DataFrame, key: str = "event_id", pred_ts: str = "ts",
               label_ts: str = "label_ts", max_delay: str = "2 hours", watermark: str = WATERMARK, how: str = "left_outer") -> DataFrame:
    """#143: stream-stream join of predictions with labels that arrive later:
    same key, label time within [prediction time, prediction time + max_delay]. Watermarks on both
    sides bound the join state: a prediction whose label has not come when they pass its time
    leaves with `labelled` false, and a label behind the watermark finds nothing any more."""
    p = predictions.withWatermark(pred_ts, watermark)
    lab = labels.withColumnRenamed(key, "_l_key").withWatermark(label_ts, watermark)
    cond = ((F.col(key) == F.col("_l_key"))
            & (F.col(label_ts) >= F.col(pred_ts))
            & (F.col(label_ts) <= F.col(pred_ts) + F.expr(f"INTERVAL {max_delay}")))
    return p.join(lab, cond, how).withColumn("labelled", F.col("_l_key").isNotNull()).drop("_l_key")


def run_label_join(predictions: DataFrame, labels: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """One turn of the join on all that is new: (joined and expired predictions so far, labels so far that came
    behind the watermark). The watermark that a turn ends with is stored for the next; the labels
    pass by it in a query of their own, as the join drops late ones silently."""
    spark = predictions.sparkSession
    try:
        mark = spark.read.parquet(f"{out}/watermark").first()["watermark"]
    except Exception:  # noqa: BLE001 - the first turn
        mark = None
    behind = F.lit(False) if mark is None else F.col("label_ts") < F.lit(mark).cast("timestamp")
    late = _write_batches(labels, "late-labels", "append", lambda batch, _: batch.where(behind), f"{out}/late")
    joined = label_join(predictions, labels)
    q = (joined.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/joined/data/batch_id={i}"))
         .option("checkpointLocation", f"{out}/joined/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    marks = [p["eventTime"].get("watermark") for p in q.recentProgress if p["eventTime"].get("watermark")]
    if marks:
        spark.createDataFrame([(max(marks),)], "watermark string").coalesce(1).write.mode("overwrite").parquet(f"{out}/watermark")
    return spark.read.parquet(f"{out}/joined/data").drop("batch_id"), spark.read.parquet(late).drop("batch_id")
