"""A set of 64-bit hashes as a filter of a fixed number of bits.

Whatever the number of hashes, the filter has one size, so it can be sent to
every task. It holds every hash it was built from; of others it lets through
(1 - exp(-4 n / bits)) ** 4 for n hashes: one in a billion at 100,000 hashes and
the default size, 2 in 10,000 at two million.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
PROBES = 4


def build(hashes: DataFrame, column: str, bits: int = BITS) -> bytes:
    """The filter of a column of longs; at most bits / 64 combined rows reach the one task that packs them."""
    shift, mask = bits.bit_length() - 1, F.lit(bits - 1)
    c = F.col(column)
    low, high = c.bitwiseAND(mask), F.shiftrightunsigned(c, shift).bitwiseAND(mask).bitwiseOR(F.lit(1))
    places: list[Column] = [(low + high * i).bitwiseAND(mask) for i in range(PROBES)]
    words = (
        hashes.select(F.explode(F.array(*places)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
    )

    def pack(batches):
        out = np.zeros(bits // 64, np.int64)
        for b in batches:
            out[b.column("w").to_numpy()] = b.column("v").to_numpy()
        yield pa.record_batch([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["v"])

    rows = words.coalesce(1).mapInArrow(pack, "v binary").collect()
    return zlib.decompress(rows[0]["v"]) if rows else bytes(bits // 8)


def holds(data: bytes, h: int, bits: int = BITS) -> bool:
    """Whether the filter lets a hash (signed 64 bits) through."""
    mask = bits - 1
    at = h & mask
    if not data[at >> 3] >> (at & 7) & 1:
        return False  # most end here
    step = ((h & 0xFFFFFFFFFFFFFFFF) >> (bits.bit_length() - 1)) & mask | 1
    for _ in range(PROBES - 1):
        at = at + step & mask
        if not data[at >> 3] >> (at & 7) & 1:
            return False
    return True
