"""A bit for each hash of a set, of fixed size whatever the set's: what has no bit isn't in the set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Bits; a broadcast of BITS / 8 bytes.
BITS = 1 << 26


def make(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """The sieve of a column of 64-bit hashes, sent to all tasks: bits / 8 bytes."""
    spot = hashes.select(F.col(column).bitwiseAND(bits - 1).alias("b"))
    words = spot.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, int(b & 63))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(max(bits // 64, 1), np.int64)
    got = words.toArrow()  # bits / 64 rows at most, 16 bytes each
    out[got["w"].to_numpy()] = got["m"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def passes(sieve: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have a bit."""
    words = np.frombuffer(sieve, np.uint64)
    spot = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def may_have(sieve: Broadcast, column: Column) -> Column:
    """Whether a column's hash has a bit; only this column goes through Python."""

    @pandas_udf("boolean")
    def has(x: pd.Series) -> pd.Series:
        return pd.Series(passes(sieve.value, x.to_numpy(np.int64)))

    return has(column)
