"""A set of 64-bit values as a bit filter of fixed size, built by Spark and sent with tasks.

The filter says yes to every value of the set and to few others; how many others grows as it fills.
Callers use it where a wrong yes costs time and never a result. Its size is SIZE bits at any number
of values, so it is a broadcast of a proven bound; only its words with a bit are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix, signed

LOG_SIZE = 26
PROBES = 2
SIZE = 1 << LOG_SIZE


def _places(values: np.ndarray) -> list[np.ndarray]:
    h = mix(values)
    return [((h >> U64(32 * k)) & U64(SIZE - 1)).astype(np.int64) for k in range(PROBES)]


class BitFilter:
    def __init__(self, word: np.ndarray, mask: np.ndarray):
        self.word, self.mask, self._table = word, mask, None

    def __getstate__(self):
        return self.word, self.mask

    def __setstate__(self, state):
        self.__init__(*state)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each value may be in the set."""
        if not len(self.word):
            return np.zeros(len(values), dtype=bool)
        if self._table is None:
            words = np.zeros(SIZE // 64, dtype=np.int64)
            words[self.word] = self.mask
            self._table = words.view(np.uint8)
        out = np.ones(len(values), dtype=bool)
        for place in _places(values):
            out &= (self._table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
        return out


def bit_filter(values: DataFrame) -> BitFilter:
    """Filter of the only column (long) of values; at most SIZE / 64 rows come to the driver."""

    def run(batches):
        for batch in batches:
            place = np.concatenate(_places(batch.column(0).to_numpy().view(U64)))
            yield pa.RecordBatch.from_arrays([pa.array((place >> 6).astype(np.int32)), pa.array(signed(U64(1) << (place & 63).astype(U64)))], names=["word", "mask"])

    got = values.mapInArrow(run, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    return BitFilter(got.column(0).to_numpy(), got.column(1).to_numpy())
