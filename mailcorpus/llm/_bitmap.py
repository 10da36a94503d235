"""A bitmap of fixed size that tells tasks which rows may matter.

A false yes costs work, never a result, so it may fill up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_BUCKET = 1 << 15


def place(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BITS))


def bitmap(places: DataFrame) -> np.ndarray:
    """The bytes (8 MB whatever comes) of a bitmap with the bits of one long column set; tasks build its parts."""
    at = F.col(places.columns[0]) + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((BITS // _BUCKET, _BUCKET // 8), np.uint8)
    for row in parts.collect():  # at most BITS / _BUCKET rows
        out[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit at each place is set."""
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 != 0
