"""Derived scored-record views over the driver tables.

These are the inputs every operator is exercised with. Each view has a DuckDB
twin in `scorewatch.plans.sqlparts` so results can be checked value by value.

Scale notes
-----------
* `loans`: lineitem is aggregated by `l_orderkey` first (partial aggregation
  map-side), so the join with orders is order-to-order; both sides end up
  hash-partitioned on the order key and the join reuses that partitioning.
  The customer side is a normal equi-join: AQE broadcasts it only when its
  runtime size is under the threshold, otherwise it stays sort-merge.
* Nothing here collects or broadcasts unbounded data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.sources.tables import read_table

MODELS = ("a", "b", "c")


def loans(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per order; label TARGET, period month_no, three score columns."""
    orders = (read_table(spark, sf_dir, "orders") if orders is None else orders).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    items = (
        read_table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            # exact 2-decimal sums as integer cents (long sums stay in the fast
            # hash aggregate; a decimal(28,2) buffer does not)
            (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)).alias("ext"),
            (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.lit(100.0)).alias("disc_sum"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("bad"),
        )
    )
    j = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(items, orders.o_orderkey == items.l_orderkey, "left")
    )
    n0 = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    score_a = n0 / (n0 + F.lit(2.0))
    score_b = F.col("o_totalprice") / F.lit(500000.0)
    return j.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int").alias("month_no"),
        F.col("o_orderpriority").alias("ORGANIZATION_TYPE"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        F.col("ext").alias("AMT_ANNUITY"),
        (F.col("ext") / F.lit(12.0)).alias("installment"),
        (F.col("disc_sum") / F.col("n") * F.lit(1000.0)).alias("revol_util"),
        (-(F.lit(6570) + (F.col("o_custkey") * 37) % 21900)).cast("bigint").alias("DAYS_BIRTH"),
        n0.alias("CNT_ITEMS"),
        F.coalesce(F.col("bad"), F.lit(0)).cast("int").alias("TARGET"),
        score_a.alias("score_a"),
        score_b.alias("score_b"),
        ((score_a + score_b) / F.lit(2.0)).alias("score_c"),
    )


def scored_long(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """(loan_id, month_no, model_id, label, prob): one row per loan and model."""
    lo = base if base is not None else loans(spark, sf_dir)
    return lo.select(
        "loan_id", "month_no", F.col("TARGET").alias("label"),
        F.expr("stack(3, 'a', score_a, 'b', score_b, 'c', score_c) AS (model_id, prob)"),
    ).select("loan_id", "month_no", "model_id", "label", "prob")


def loans_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`loans` with split: train 40 / val 15 / test 25 months.

    `loans` has exactly one row per order with the order's month, so the split
    bounds (distinct months, validation) are computed from `orders` alone -
    the joins of the view are not evaluated just to validate the split.
    """
    from scorewatch.operators.splits import drop_null_period, split_bounds, split_expr

    months = read_table(spark, sf_dir, "orders").select(
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int").alias("month_no"))
    base, train_end, val_end = split_bounds(months, "month_no", 40, 15, 25)
    return drop_null_period(loans(spark, sf_dir), "month_no").withColumn(
        "split", split_expr("month_no", base, train_end, val_end))


def loans_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`loans` with forced drift from month 40: credit x1.3, score_b x0.8; `is_current` flag."""
    lo = loans(spark, sf_dir)
    late = F.col("month_no") >= 40
    return lo.withColumns({
        "AMT_CREDIT": F.when(late, F.col("AMT_CREDIT") * F.lit(1.3)).otherwise(F.col("AMT_CREDIT")),
        "score_b": F.when(late, F.col("score_b") * F.lit(0.8)).otherwise(F.col("score_b")),
        "is_current": late,
    })


#: Copies of one row that are numbered at a time.
COPY_BLOCK = 65_536


def items_book(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Second schema from lineitem: label loan_status, period ISSUE_MONTH, key (row_hash, dup_no).

    lineitem has no unique key; the key is the full-row hash plus the copy number among
    identical rows. Equal rows are counted first, so copies that are a third of the table are
    one row of the shuffle, and their numbers are dealt out again in blocks.
    """
    li = read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    h = F.xxhash64(*[F.col(c) for c in li.columns])
    d = li.groupBy(*li.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("row_hash", h)
    d = d.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPY_BLOCK))))
    first = F.col("_block") * COPY_BLOCK + 1
    return (
        d.withColumn("dup_no", F.explode(F.sequence(first, F.least(first + COPY_BLOCK - 1, "_n"))))
        .select("row_hash", F.col("dup_no").cast("int").alias("dup_no"), *_item_columns())
    )


def _item_columns() -> list:
    return [
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("ISSUE_MONTH"),
        F.col("l_quantity").alias("loan_amnt"),
        F.col("l_extendedprice").alias("term_price"),
        (F.col("l_discount") * F.lit(100.0)).alias("dti"),
        (F.col("l_returnflag") == "R").cast("int").alias("loan_status"),
    ]


def items_rows(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The rows of `items_book` without their key: nothing is shuffled to number copies."""
    li = read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return li.select(*_item_columns())


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both datasets under common names: (dataset, split, label, prob, amount, rate)."""
    lo = loans(spark, sf_dir).select(F.lit("loans").alias("dataset"), "month_no", F.col("TARGET").alias("label"), F.col("score_c").alias("prob"),
                                     (F.col("AMT_ANNUITY") / F.col("CNT_ITEMS")).alias("amount"), (F.col("revol_util") / F.lit(10.0)).alias("rate"))
    it = items_rows(spark, sf_dir).select(F.lit("items").alias("dataset"), F.col("ISSUE_MONTH").alias("month_no"), F.col("loan_status").alias("label"),
                                          (F.col("loan_amnt") / F.lit(50.0)).alias("prob"), F.col("term_price").alias("amount"), F.col("dti").alias("rate"))
    split = F.when(F.col("month_no") < 40, "train").when(F.col("month_no") < 55, "val").otherwise("test")
    return lo.unionByName(it).where(F.col("month_no").isNotNull()).select("dataset", split.alias("split"), "label", "prob", "amount", "rate")


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels join documents: label quality, prob n_chars/20000 clipped, weight 1+toxic."""
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("label"),
        F.least(F.greatest(F.col("n_chars") / F.lit(20000.0), F.lit(0.0)), F.lit(1.0)).alias("prob"),
        (F.lit(1) + F.col("toxic")).cast("double").alias("weight"),
    )


def event_scores(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    """events as a scored stream: key event_id, time ts, label error, prob value/100 capped."""
    ev = df if df is not None else read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("prob"),
    )


def vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 64 numeric feature columns f0..f63 with label = (label >= 5)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)],
        (F.col("label") >= 5).cast("int").alias("label"),
    )
