"""Work that must not be repeated, and parts that must not follow the rows."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from scorewatch.operators import drift as D
from scorewatch.operators import ensemble as EN
from scorewatch.operators import training as TR
from scorewatch.plans import q_train as Q
from scorewatch.sources import fixtures as FX


def test_training_partitions_follow_the_cores():
    assert TR.training_parts(40_000, 12) == 1 and TR.training_parts(400_000, 12) == 9
    assert TR.training_parts(4_500_000, 12) == 12
    assert TR.training_parts(28_000_000, 12) == 60  # whole waves of at most 500,000 rows a task
    assert all(TR.training_parts(n, 12) >= n // TR.MOST_ROWS_PER_TASK for n in range(0, 60_000_000, 777_777))


def test_codes_of_few_values_need_no_join(spark, monkeypatch):
    from scorewatch.operators import fitted as FT

    df = spark.range(400).selectExpr("id", "case when id % 9 = 0 then null else concat('v', id % 5) end AS few", "cast(id % 100 as string) AS many")
    state = FT.fit_ordinal(df.where("id % 5 <> 3 and id % 100 < 95"), ["few", "many"])
    out = FT.apply_ordinal(df, state, ["few", "many"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # `many` has more than INLINE_CODES values
    got = sorted(map(tuple, out.collect()), key=str)
    monkeypatch.setattr(FT, "INLINE_CODES", 0)
    joined = FT.apply_ordinal(df, state, ["few", "many"])
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert got == sorted(map(tuple, joined.collect()), key=str) and joined.dtypes == out.dtypes
    assert any(r[1] is None for r in got) and {r[1] for r in got} >= {0, 1, 2, 3}


def test_candidates_do_not_multiply_rows_in_a_shuffle_by_key(spark, monkeypatch):
    sl = FX.scored_long(spark, SF_SMALL)
    args = sl.where("month_no < 55"), sl.where("month_no >= 55").select("loan_id", "model_id", "label", "prob"), EN.search_points(3), "month_no", ["month_no", "loan_id"]
    want = {r.cand: r.auc_roc for r in EN.search_weights(*args).collect()}
    written = {}
    monkeypatch.setattr(EN, "ENSEMBLES_PER_TASK", 50)
    plain = EN.cut_lineage
    monkeypatch.setattr(EN, "cut_lineage", lambda df, name="stage": written.setdefault(name, plain(df, name)))
    got = {r.cand: r.auc_roc for r in EN.search_weights(*args).collect()}
    assert got == pytest.approx(want) and len(got) == 3
    assert written["eval-scores"].count() == args[1].select("loan_id").distinct().count()


def test_batch_ends_are_those_of_a_sort(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", None, 3), (None, 1, 2), (None, 1, None), ("b", 2, None), ("a", 1, 7)], "m string, b int, i int")
    got = sorted(map(str, EN.batch_ends(rows, ["m", "b"], ["b", "i"]).collect()))
    assert got == sorted(map(str, [*rows.where("i in (7, 3, 2)").collect(), *rows.where("m = 'b'").collect()]))


def test_item_rows_are_read_without_a_shuffle(spark):
    rows = FX.items_rows(spark, SF_SMALL)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    book = FX.items_book(spark, SF_SMALL).drop("row_hash", "dup_no")
    assert rows.exceptAll(book).isEmpty() and book.exceptAll(rows).isEmpty()


def test_report_counts_are_one_row_a_value(spark):
    rows = [("x", 1.0, 0.5, 1), ("x", 1.0, 0.5, 0), ("y", 1.0, 0.25, 1), ("z", 1.0, 0.5, 1), ("y", None, None, 0), (None, 2.0, 0.5, 1)]
    df = spark.createDataFrame(rows, "s string, f double, prob double, label int")
    got = {(r.feature, r.value): (r.n0, r.pos0, r.n1, r.pos1) for r in D.sample_columns(df, "s", ["x", "y"], ["f"], "prob", "label").collect()}
    assert got == {("f", 1.0): (2, 1, 1, 1), (D.PREDICTION, 0.5): (2, 1, 0, 0), (D.PREDICTION, 0.25): (0, 0, 1, 1)}


def test_scores_are_made_once_for_a_recalibration(spark, monkeypatch):
    seen, plain = [], FX.loans
    monkeypatch.setattr(FX, "loans", lambda *a, **k: seen.append(1) or plain(*a, **k))
    out = Q.recalibration(spark, SF_SMALL)
    assert len(seen) == 1
    assert not [f for f in out.inputFiles() if "lineitem" in f or "orders" in f]


@pytest.mark.parametrize("label", ["label", None])
def test_prediction_drift_reads_the_samples_once(spark, tmp_path, label):
    spark.range(300).select((F.col("id") % 97 / 97).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("label")).write.parquet(f"{tmp_path}/ref-rows")
    ref = spark.read.parquet(f"{tmp_path}/ref-rows")
    cur = ref.select((F.col("prob") / 2).alias("prob"), "label")
    out = D.prediction_drift(ref, cur, "prob", label)
    assert not [f for f in out.inputFiles() if "ref-rows" in f]
    r, mean = out.first(), ref.agg(F.avg("prob")).first()[0]
    assert r.mean_prediction_shift == pytest.approx(-mean / 2) and r.prediction_drift
    assert label is None or r.auc_degradation == pytest.approx(0.0)
