"""Filters of hashed keys: a fixed number of bits tells tasks which rows may matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_of(keys: DataFrame, size: int) -> np.ndarray:
    """A filter of `size` bits of the one column of `keys`, whatever their number."""
    place = F.pmod(F.col(keys.columns[0]), F.lit(size))
    maps = (keys.select((place + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("map")).collect())
    bits = np.zeros(size // 8, np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * 4096  # buckets of 32,768 positions are numbered from 1, as positions are
        bits[at:at + 4096] |= np.frombuffer(bytes(r["map"]), np.uint8)
    return bits


def passed(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
