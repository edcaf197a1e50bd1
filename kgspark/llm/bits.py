"""A table of bits of fixed size that tells which hashes may be wanted: it has false positives, never false negatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  #: 2^26 bits are 8 MB, whatever the number of hashes


def bit_table(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The table of the hashes in column `h`, by their upper `bits` bits.

    Spark sets the bits, 64 in a row; at most 2^(bits - 6) such rows reach the driver.
    """
    slot = F.shiftrightunsigned("h", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    got = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return table


def among(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash may be among those of the table."""
    slot = h >> np.uint64(64 - 6 - (len(table) - 1).bit_length())
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
