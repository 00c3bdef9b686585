"""A Bloom filter of bounded size, built by Spark tasks and merged with ``bit_or``.

It only spares a shuffle of rows that cannot match: an answer "maybe" is always followed by an exact
join.  With more items than it has room for it lets more rows through and stays right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 4
#: Upper bound of the filter: 2**25 bits are 4 MB.
MAX_BITS = 25


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix64(keys), mix64(~keys.astype(np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(k) * b) & np.uint64((1 << bits) - 1) for k in range(PROBES)])


def build(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The filter of the one long column of ``keys``, as 64-bit words."""
    bits = min(MAX_BITS, max(10, int(n_keys * 12).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            at = _positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
            np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(own[used].view(np.int64))], ["i", "w"])

    merged = keys.mapInArrow(words, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[merged["i"].to_numpy()] = merged["w"].to_numpy().view(np.uint64)
    return out


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is certainly not in the filter."""
    at = _positions(keys, int(len(words) * 64).bit_length() - 1)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
