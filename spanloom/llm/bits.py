"""A broadcast filter of bounded size: which rows of a table are worth working on where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (8 MB).
FILTER_BITS = 1 << 26


class Bits:
    """A filter over pairs of numbers that holds all it was made of: three bits each among FILTER_BITS at most, whatever their number.

    A full filter lets more through than it was made of: work that is done in vain, and does no harm.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
        """(3, n): the pairs' places among ``size`` bits, a power of two."""
        with np.errstate(over="ignore"):
            x = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            return np.stack([(x * np.uint64(2 * k + 3) >> np.uint64(30)) & np.uint64(size - 1) for k in range(3)])

    @classmethod
    def of(cls, pairs: DataFrame) -> Bits:
        """The filter of a frame of two columns of long without nulls."""
        size = min(FILTER_BITS, 1 << max(10, (16 * pairs.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(cls.places(*(c.to_numpy() for c in batch.columns), size))
                masks = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])

        words = pairs.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = np.zeros(size // 64, np.int64)
        out[words["word"].to_numpy()] = words["mask"].to_numpy()
        return cls(out.view(np.uint64))

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.places(one, two, 64 * len(self.words))
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)
