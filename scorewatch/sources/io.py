"""Sinks and fitted-state storage (#7, #8, #9, #10).

Everything is written as tables (parquet/CSV/JSON) through the DataFrame
writer; fitted state is small and stored as parquet next to the data so a
load on another cluster reads the same values.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.operators.descriptive import score_output


def write_predictions(scored: DataFrame, path: str, prob: str = "prob", label: str = "label",
                      fmt: str = "parquet") -> None:
    """#7: actual, predicted_proba, predicted_class."""
    out = scored.select(F.col(label).alias("actual"), F.col(prob).alias("predicted_proba"),
                        (F.col(prob) > F.lit(0.5)).cast("int").alias("predicted_class"))
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_scored(df: DataFrame, path: str, prob: str, keep=(), fmt: str = "csv") -> None:
    """#8: scored rows with risk band and recommendation."""
    score_output(df, prob, keep).write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """#9: result rows as JSON lines (numbers stay numbers)."""
    df.write.mode("overwrite").json(path)


def to_json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """#9: one JSON string per row (for result documents)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def save_state(spark: SparkSession, path: str, weights: DataFrame | None = None,
               columns: list[str] | None = None, params: dict | None = None,
               monitors: DataFrame | None = None) -> None:
    """#10: weights, monitor buffers, feature names and parameters as parquet tables."""
    if weights is not None:
        weights.write.mode("overwrite").parquet(f"{path}/weights")
    if monitors is not None:
        monitors.write.mode("overwrite").parquet(f"{path}/monitors")
    meta = spark.createDataFrame([(json.dumps(columns or []), json.dumps(params or {}))], "columns string, params string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_state(spark: SparkSession, path: str) -> dict:
    """#10: read back what save_state wrote."""
    out: dict = {}
    for part in ("weights", "monitors"):
        try:
            out[part] = spark.read.parquet(f"{path}/{part}")
        except Exception:  # noqa: BLE001 - optional part
            out[part] = None
    meta = spark.read.parquet(f"{path}/meta").first()
    out["columns"] = json.loads(meta["columns"])
    out["params"] = json.loads(meta["params"])
    return out
