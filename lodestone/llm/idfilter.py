"""Fixed-size Bloom filters over 64-bit hashes, to spare most rows a shuffle.

The filter is a bitmap of at most 2**25 bits (4 MB): that is the proven bound
of what is sent to the driver and broadcast, whatever the number of keys. Past
its capacity it only lets more rows through; a join always follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25


def bloom_bitmap(keys: DataFrame, key: str, bits: int = BITS):
    """Broadcast bitmap over ``keys[key]`` (BIGINT hashes, nulls ignored)."""
    import numpy as np

    spark = keys.sparkSession
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.where(F.col(key).isNotNull())
        .select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = words.toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast((bits, bitmap.view(np.uint64)))


def may_contain(bitmap, key: Column) -> Column:
    """True where the bitmap may hold the hash; null hashes are never held."""

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        import numpy as np

        bits, words = bitmap.value
        there = h.notna().to_numpy()
        at = h.fillna(0).to_numpy(np.int64) & ((1 << bits) - 1)
        hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series((hit == 1) & there)

    return probe(key)
