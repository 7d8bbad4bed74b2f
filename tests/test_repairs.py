"""Cases that earlier versions got wrong."""

import math

import pytest
from pyspark.sql import functions as F

from scorewatch import session
from scorewatch.operators import descriptive as DS
from scorewatch.operators import ensemble as EN
from scorewatch.operators import fitted as FT
from scorewatch.operators import rankstats as RS
from scorewatch.operators import splits as SP
from scorewatch.sources import fixtures as FX
from scorewatch.session import scratch_path
from scorewatch.streaming import monitor as SM

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def loans(spark):
    return FX.loans_split(spark, SF).drop("score_a", "score_b", "score_c", "customer_id")


def test_pipeline_keeps_its_choice_of_columns(spark, loans):
    pipe = FT.FeaturePipeline(label="TARGET", exclude=["loan_id", "split"])
    train = loans.where("split = 'train'")
    state = pipe.fit(train)
    assert state.risk["debt"] == "AMT_CREDIT"
    out = pipe.transform(train, keep=["loan_id"])
    assert out.columns[0] == "loan_id" and out.count() == train.count()
    scaled = [c for c in state.scale if state.scale[c][1]]
    assert "debt_to_income_ratio" in scaled
    row = out.agg(*[x for c in scaled for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    for c in scaled:
        assert abs(row[f"m_{c}"]) < 1e-6 and abs(row[f"s_{c}"] - 1) < 1e-6, c


def test_pipeline_with_two_numeric_columns(spark):
    df = spark.createDataFrame([(i % 12, float(i * 7 % 90), float(40 + i % 60), i % 2) for i in range(120)],
                               "month_no int, AMT_CREDIT double, AMT_INCOME_TOTAL double, TARGET int")
    pipe = FT.FeaturePipeline()
    pipe.fit(df)
    assert "debt_to_income_ratio" in pipe.transform(df).columns


def test_pipeline_state_is_saved_and_loaded(spark, loans, tmp_path):
    pipe = FT.FeaturePipeline(label="TARGET", exclude=["loan_id", "split"])
    train, test = loans.where("split = 'train'"), loans.where("split = 'test'")
    pipe.fit(train).save(spark, str(tmp_path))
    again = FT.State.load(spark, str(tmp_path))
    a, b = pipe.transform(test, keep=["loan_id"]), pipe.transform(test, again, keep=["loan_id"])
    assert a.columns == b.columns and a.exceptAll(b).count() == 0


def test_duplicate_columns_do_not_hide_behind_a_collision(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (3, 3, 3)], "a int, b int, c int")
    assert FT.duplicate_columns(df, ["a", "b", "c"]) == [("b", "c")]
    assert FT.equal_pairs(df, {"a": 1, "b": 1, "c": 1}) == [("b", "c")]
    assert FT.duplicate_columns_frame(df.where("a > 9"), ["a"]).count() == 0


def test_encoder_keeps_the_order_of_columns(spark):
    df = spark.createDataFrame([("x", 1, "u"), (None, 2, "v"), ("new", 3, "u")], "c1 string, n int, c2 string")
    state = FT.fit_ordinal(df.where("n < 3"), ["c1", "c2"])
    out = FT.apply_ordinal(df, state, ["c1", "c2"]).orderBy("n")
    assert out.columns == ["c1", "n", "c2"] and [tuple(r) for r in out.collect()] == [(0, 1, 0), (None, 2, 1), (None, 3, 0)]


@pytest.mark.parametrize("label, prob", [(None, 0.5), (2, 0.5), (1, math.nan), (1, 1.5), (0, -0.1)])
def test_bad_labels_and_scores_are_errors(spark, label, prob):
    df = spark.createDataFrame([(1, 0.7), (0, 0.2), (label, prob)], "label int, prob double")
    with pytest.raises(Exception, match="must"):
        RS.auc_roc(df).collect()


def test_null_scores_are_not_scored(spark):
    df = spark.createDataFrame([(1, 0.7), (0, 0.2), (1, None)], "label int, prob double")
    r = RS.auc_roc(df).first()
    assert (r.auc_roc, r.n_pos, r.n_neg) == (1.0, 1, 1)


def test_keys_of_any_width_are_mixed(spark):
    df = spark.range(300).select((F.col("id") * 30_000_000_000_000_007 + 9_000_000_000_000_000).alias("k"), F.concat(F.lit("key"), "id").alias("s"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"))
    for key in ("k", "s"):
        assert DS.sample_exact(df, 40, key).count() == 40
        folds = SP.stratified_folds(df, key, "y", 5).groupBy("y", "fold").count().collect()
        for y in (0, 1):
            sizes = [r["count"] for r in folds if r.y == y]
            assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    small = spark.range(100).select(F.col("id").alias("k"), SP.mix_key("id").alias("m")).collect()
    assert all(r.m == (r.k * 48271 + 42) % 2147483647 for r in small)


def plain_update(weights, metrics, alpha=0.1, floor=0.05):
    s = {m: 0.6 * (0.5 if a is None else a) + 0.4 / (b + 1e-8) for m, (a, b) in metrics.items()}
    top = max(s.values())
    z = sum(math.exp(v - top) for v in s.values())
    new = {m: max((1 - alpha) * w + alpha * math.exp(s[m] - top) / z if m in s else w, floor) for m, w in weights.items()}
    return {m: v / sum(new.values()) for m, v in new.items()}


BATCHES = [{"a": (0.7, 0.2), "b": (0.6, 0.25)}, {"a": (None, 0.1), "b": (None, 0.3)}, {"b": (0.9, 0.05)}, {"a": (0.5, 0.2), "b": (0.4, 0.4)}]


def test_weights_survive_single_class_batches_and_absent_models(spark):
    rows = [(i, m, a, b) for i, x in enumerate(BATCHES) for m, (a, b) in x.items()]
    df = spark.createDataFrame(rows, "batch int, model_id string, auc_roc double, brier_score double")
    got = {(r.batch, r.model_id): r.weight for r in EN.weight_trajectory(df, [], "batch").collect()}
    w = {"a": 0.5, "b": 0.5}
    for i, x in enumerate(BATCHES):
        one = EN.update_weights(df.where(F.col("batch") == i), spark.createDataFrame(list(w.items()), "model_id string, weight double"))
        w = plain_update(w, x)
        assert {m: round(v, 12) for m, v in w.items()} == {r.model_id: round(r.weight, 12) for r in one.collect()}
        assert all(abs(got[i, m] - v) < 1e-12 for m, v in w.items())


def test_trajectories_per_key_and_candidate(spark):
    rows = [(k, i, m, a, b, 0.1 * k, 0.02 * k) for k in (1, 2) for i, x in enumerate(BATCHES) for m, (a, b) in x.items()]
    df = spark.createDataFrame(rows, "k int, batch int, model_id string, auc_roc double, brier_score double, al double, fl double")
    got = {(r.k, r.batch, r.model_id): r.weight for r in EN.weight_trajectory(df, ["k"], "batch", alpha="al", min_weight="fl").collect()}
    for k in (1, 2):
        w = {"a": 0.5, "b": 0.5}
        for i, x in enumerate(BATCHES):
            w = plain_update(w, x, 0.1 * k, 0.02 * k)
            assert all(abs(got[k, i, m] - v) < 1e-12 for m, v in w.items())


def test_stream_batch_of_one_class_keeps_weights_apart(spark):
    """The AUC of a batch with one class is 0.5; a model without scores keeps its weight."""
    rows = [(1, 1, 0, 0.2, 0.5), (2, 2, 0, 0.1, 0.6), (3, 3, 0, 0.3, None)]
    df = spark.createDataFrame(rows, "ts int, event_id int, label int, a double, b double")
    got, out = None, scratch_path(spark, "test-weights")
    for stream in SM.replay([df.where("ts < 3"), df.where("ts = 3")]):
        got = SM.run_stream_weights(stream, ["a", "b"], min_n=1, out=out)
    got = {(r.batch_id, r.model_id): r.weight for r in got.collect()}
    one = plain_update({"a": 0.5, "b": 0.5}, {"a": (None, 0.025), "b": (None, 0.305)})
    two = plain_update(one, {"a": (None, (0.04 + 0.01 + 0.09) / 3)})
    assert {m: got[0, m] for m in "ab"} == pytest.approx(one) and {m: got[1, m] for m in "ab"} == pytest.approx(two)


def test_no_local_folder_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.work_dir(Session())
