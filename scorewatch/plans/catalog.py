"""Query catalogue: every registered operator as (spark, sf_dir) -> DataFrame,
with its DuckDB oracle SQL where one exists.

Registered queries read the driver tables (or views Spark derives from them)
in full. Doubles are rounded to 6 digits in both the Spark result and the SQL
so the order of floating-point sums cannot change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, round_doubles: bool = True):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if round_doubles:
            def wrapped(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
                return rnd(_fn(spark, sf_dir))
            wrapped.__name__ = fn.__name__
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        else:
            QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column to `digits` as round(x * 10^d) / 10^d.

    Rounding the scaled value to an integer is the same operation in Spark and
    DuckDB (half away from zero on an exactly representable double), whereas
    rounding at a decimal scale differs between them on decimal ties.
    """
    k = float(10 ** digits)
    return df.select(*[
        (F.round(F.col(f.name).cast("double") * F.lit(k), 0) / F.lit(k)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
