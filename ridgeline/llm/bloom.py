"""A Bloom filter over a column of longs, built on the executors and broadcast: twelve bits a key or more, as far as 8 MB
(5 million keys) go; beyond that it lets more and more through.

It only saves work: who uses it must get right results from a filter that lets everything through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.kernels import mix

LEAST_BITS, MOST_BITS = 20, 26
_PARTS = 128


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(np.ascontiguousarray(keys).view(np.uint64))
    return np.stack([((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 18, 36)])


def packed(keys: DataFrame) -> np.ndarray:
    """Packed bits (a power of two of them) of the only column of ``keys``."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (12 * keys.count()).bit_length()))

    def fill(batches):
        held = np.zeros(bits, bool)
        for b in batches:
            held[slots(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        parts = np.packbits(held).reshape(_PARTS, -1)
        for k in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], ["k", "bits"])

    def merge(key, table):
        got = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(got).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8).reshape(_PARTS, -1)
    for row in keys.mapInArrow(fill, "k int, bits binary").groupBy("k").applyInArrow(merge, "k int, bits binary").collect():  # 128 rows
        out[row.k] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter, given its packed bits."""
    at = slots(keys, len(bits) * 8)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
