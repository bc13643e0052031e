"""A bit array of fixed size over hashed keys: lets a scan leave rows out before a shuffle.

The array has the same size for any input, so it may be sent to every task. A key that was put in is
always found; a key that was not may be found by chance, and the join behind the filter drops it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26
_PAGE = 32768


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter over the 64-bit column ``key``, as bytes; Spark builds its pages."""
    at = F.pmod(F.col(key), F.lit(bits))
    rows = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.floor(at / _PAGE).cast("int").alias("page"))
        .agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_PAGE))).alias("bitmap"))
        .collect()  # at most bits / 32768 rows of 4 KB
    )
    out = np.zeros((bits // _PAGE, _PAGE // 8), np.uint8)
    for r in rows:
        out[r.page] = np.frombuffer(r.bitmap, np.uint8)
    return out.reshape(-1)


def found(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may have been put in."""
    at = np.mod(keys.astype(np.int64), np.int64(len(bitmap) * 8))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def id_key(column: str) -> Column:
    """A 64-bit key of an id of any type."""
    return F.xxhash64(F.col(column).cast("string"))


def repeated_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter over the values of ``key`` that occur twice or more; only counts are shuffled."""
    twice = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return key_filter(twice, key, bits)
