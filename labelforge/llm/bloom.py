"""A Bloom filter of bounded size over 64-bit hashes, built by Spark.

The filter only spares work: what it lets through wrongly is found out by the
caller's exact count or join.  Above ``MAX_BITS`` it gets fuller and spares less."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 bits for each key, within these bounds (the largest filter has 16 MB).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27


def bits_for(keys: int) -> int:
    """The filter's size: a power of two, so that places are masks."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * keys - 1).bit_length()))


def build(hashes: DataFrame, column: str, keys: int) -> np.ndarray:
    """The filter's 64-bit words for the hashes (bigint) of ``column``.  The words
    are made by an aggregation and at most ``MAX_BITS / 64`` of them reach the driver."""
    bits = bits_for(keys)
    mask = F.lit(bits - 1).cast("bigint")
    h = F.col(column)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("place"))
    words = (places.groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("ones")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("ones").to_numpy().view(np.uint64)
    return out


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash (uint64) whether it may be in the filter."""
    mask = np.uint64(len(words) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found
