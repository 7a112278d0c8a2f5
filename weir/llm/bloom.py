"""A prefilter sized by the number of keys: which rows may belong to a set of 64-bit keys. What passes is still joined exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and the most bits (as powers of two) that a filter has. Beyond the most, more rows pass.
PER_KEY, LEAST, MOST = 10, 17, 28


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = len(words).bit_length() + 5

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _places(np.asarray(keys, np.int64), self.bits):
            out &= ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(32))) * np.uint64(odd)
        yield (x >> np.uint64(64 - bits)).astype(np.int64)


def size_for(count: int) -> int:
    """The bits, as a power of two, of a filter of about count keys."""
    return min(max((PER_KEY * count).bit_length(), LEAST), MOST)


def bits_of(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """(w, bits): the words of the filter that keys touch, and their bits."""
    at = np.unique(np.concatenate(list(_places(keys, bits))))
    w, first = np.unique(at >> 6, return_index=True)
    one = np.uint64(1) << (at & 63).astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(w), pa.array((np.bitwise_or.reduceat(one, first) if len(w) else one).view(np.int64))], ["w", "bits"])


def gather(parts: DataFrame, bits: int) -> Bloom:
    """The filter of (w, bits) rows. At most 2 ** (MOST - 6) rows of two longs reach the driver."""
    t = parts.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[t.column("w").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return Bloom(words)


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield bits_of(batch.column(0).to_numpy(), bits)


def of_keys(keys: DataFrame, count: int) -> Bloom:
    """The filter of a frame of one long column without nulls that has about count rows."""
    bits = size_for(count)
    return gather(keys.mapInArrow(partial(_set_bits, bits=bits), "w long, bits long"), bits)
