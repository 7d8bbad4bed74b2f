"""Monitors over several micro-batches against the same rows in one piece."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators import drift as D
from scorewatch.session import scratch_path
from scorewatch.streaming import lastn as LN
from scorewatch.streaming import monitor as SM


def scored(n=6000, keys=("hot", "b", "c", None)):
    """Rows of which `hot` holds two thirds, some with an old time, some without a score."""
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.66 else rnd.choice(keys)
        t = i if rnd.random() < 0.9 else rnd.randrange(i + 1)  # late rows
        rows.append((k, t, i, int(rnd.random() < 0.3), None if rnd.random() < 0.02 else rnd.random()))
    return rows


@pytest.mark.parametrize("n", [1, 150, 1000])
def test_last_n_over_four_batches(spark, n):
    rows = scored()
    cuts = [0, 100, 2500, 2600, len(rows)]
    parts = [spark.createDataFrame(rows[a:b], "event_type string, ts int, event_id int, label int, prob double").repartition(3) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = scratch_path(spark, "test-last-n")
    for stream in SM.replay(parts):
        got = SM.run_last_n_monitor(stream, "event_type", n, 100, out)
    got = {(r.batch_id, r.event_type): (r.n_window, r.rolling_brier, r.rows_seen) for r in got.collect()}
    want = {}
    for k, b in enumerate(cuts[1:]):
        seen = [r for r in rows[:b] if r[4] is not None]
        for key in {r[0] for r in rows[cuts[k]:b] if r[4] is not None}:
            own = sorted((r[1], r[2], (r[4] - r[3]) ** 2) for r in seen if r[0] == key)
            last = [x for *_, x in own[-n:]]
            want[k, key] = (len(last), np.mean(last) if len(last) >= 100 else 0.0, len(own))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][2] == v[2] and got[k][1] == pytest.approx(v[1], rel=1e-12)


def test_tasks_forward_the_last_rows_only():
    import pandas as pd

    frames = [pd.DataFrame({"k": [i % 2 for i in range(500)], "order_1": list(range(b, b + 500)), "order_2": [0] * 500, "sq_error": [0.5] * 500, "rows_held": [1] * 500}) for b in (0, 500)]
    out = list(LN.last_rows("k", 7)(iter(frames)))
    assert len(out) == 1 and len(out[0]) == 14 and out[0].rows_held.sum() == 1000
    assert sorted(out[0].order_1) == list(range(986, 1000))
    assert list(LN.last_rows("k", 7)(iter([]))) == []


def drift_parts(spark):
    rnd = random.Random(2)
    return [spark.createDataFrame([(rnd.gauss(m, s), float(rnd.randrange(9)), None) for _ in range(400)], "x double, y double, z double") for m, s in ((0, 1), (0.4, 1), (50, 90))]


def test_drift_reads_the_reference_once(spark):
    rnd = random.Random(1)
    counted = spark.sparkContext.accumulator(0)

    def watch(frames):
        for f in frames:
            counted.add(len(f))
            yield f

    plain = spark.createDataFrame([(rnd.gauss(0, 1), float(rnd.randrange(8)), None) for _ in range(700)] + [(1e18, 3.0, None)], "x double, y double, z double")
    ref = SM.StoredReference(plain.mapInPandas(watch, plain.schema), ["x", "y", "z"], buckets=8)
    read, parts, out = counted.value, drift_parts(spark), scratch_path(spark, "test-drift")
    for stream in SM.replay(parts):
        got = SM.run_stream_drift(stream, ref, out)
    rows = {(r.batch_id, r.feature): r for r in got.collect()}
    assert counted.value == read and len(rows) == 6
    for k, part in enumerate(parts):
        for w in D.ks_drift(plain, part, ["x", "y"]).collect():
            r = rows[k, w.feature]
            assert r.statistic == pytest.approx(w.statistic) and r.p_value == pytest.approx(w.p_value) and (r.n_ref, r.n_cur) == (w.n_ref, w.n_cur)


def test_sketched_drift_stays_within_its_error(spark):
    rnd = random.Random(1)
    plain = spark.createDataFrame([(rnd.gauss(0, 1), float(rnd.randrange(8)), None) for _ in range(5000)], "x double, y double, z double")
    ref = SM.StoredReference(plain, ["x", "y", "z"])
    parts, out, so_far = drift_parts(spark), scratch_path(spark, "test-sketch"), None
    for part, stream in zip(parts, SM.replay(parts), strict=True):
        got = {r.feature: r for r in SM.run_stream_sketches(stream, ref, out).collect()}
        so_far = part if so_far is None else so_far.unionByName(part)
        for w in D.ks_drift(plain, so_far, ["x", "y"]).collect():
            assert abs(got[w.feature].statistic - w.statistic) <= got[w.feature].error < 0.02


def test_a_repeated_batch_leaves_the_weights_as_they_are(spark):
    rnd = random.Random(3)
    rows = [(i, i, int(rnd.random() < 0.4), rnd.random(), rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "ts int, event_id int, label int, a double, b double")
    out = scratch_path(spark, "test-weights")
    for stream in SM.replay([df.where("ts < 300"), df.where("ts between 300 and 599"), df.where("ts >= 600")]):
        got = SM.run_stream_weights(stream, ["a", "b"], n=200, out=out)
    once = sorted(map(tuple, got.collect()))
    assert len(once) == 6
    held = spark.read.parquet(f"{out}/monitors").groupBy("batch_id", "model_id").agg(F.count("*"), F.min("ts")).collect()
    assert {tuple(r) for r in held} == {(k, m, 200, 300 * k + 100) for k in range(3) for m in "ab"}


def test_join_state_expires_and_late_labels_are_kept_aside(spark):
    at = lambda h: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {h} hours")
    preds = lambda rows: spark.createDataFrame(rows, "event_id int, h int").select("event_id", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)").alias("ts"))
    labs = lambda rows: preds(rows).select("event_id", F.col("ts").alias("label_ts"), F.lit(1).alias("label"))
    p = [preds([(1, 0), (2, 0), (3, 9)]), preds([(4, 30), (5, 31)])]
    y = [labs([(1, 1), (9, 10)]), labs([(2, 1), (3, 11), (4, 31), (8, 32)])]
    out = scratch_path(spark, "test-join")
    for a, b in zip(SM.replay(p), SM.replay(y), strict=True):
        joined, late = SM.run_label_join(a, b, out)
    assert {(r.event_id, r.labelled) for r in joined.collect()} == {(1, True), (2, False), (3, True), (4, True)}  # 5 may still get a label
    assert [r.event_id for r in late.collect()] == [2] and at(1) is not None
